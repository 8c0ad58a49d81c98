"""Symbols and top-level variables of source files. Plain functions, used by the operators in batches."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from weftmark.functions.text import lines_of


@dataclass(frozen=True)
class Symbol:
    """A class, method, function, variable, interface, type alias or enum; `parent` is a method's class."""

    name: str
    parent: str
    signature: str
    code: str

    @property
    def label(self) -> str:
        return f"{self.parent}.{self.name}" if self.parent else self.name


@dataclass(frozen=True)
class Extraction:
    symbols: list[Symbol]
    variables: list[str]
    error: str | None = None


# -- Python


def _python(source: str) -> Extraction:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        return Extraction(*_python_lines(source), f"{type(e).__name__}: {e}")
    lines = lines_of(source, ends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line.encode()))
    raw = source.encode()

    def at(line: int, col: int) -> int:
        return starts[line - 1] + col

    def text(a: int, b: int) -> str:
        return raw[a:b].decode("utf-8", "replace")

    def symbol(node: ast.AST, parent: str, decorated: bool) -> Symbol:
        first = min([(node.lineno, node.col_offset), *((d.lineno, d.col_offset - 1) for d in node.decorator_list)]) if decorated else (node.lineno, node.col_offset)
        body = node.body[0]
        begin = min([(body.lineno, body.col_offset), *((d.lineno, d.col_offset - 1) for d in getattr(body, "decorator_list", []))])
        start, end = at(*first), at(node.end_lineno, node.end_col_offset)
        own = at(node.lineno, node.col_offset)
        return Symbol(node.name, parent, text(own, at(*begin)).strip(), text(start, end))

    kinds = (ast.FunctionDef, ast.AsyncFunctionDef)
    first, functions = [], []

    def walk(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                first.append(symbol(child, "", False))
                first.extend(symbol(m, child.name, True) for m in child.body if isinstance(m, kinds))
            elif isinstance(child, kinds) and not isinstance(node, ast.ClassDef):
                functions.append(symbol(child, "", False))
            walk(child)

    walk(tree)
    variables = [
        text(at(n.lineno, n.col_offset), at(n.end_lineno, n.end_col_offset)).strip()
        for n in tree.body
        if isinstance(n, (ast.Assign, ast.AnnAssign)) and (isinstance(n, ast.Assign) or n.value is not None or n.annotation)
    ]
    return Extraction(first + functions, variables)


_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)", re.M)


def _python_lines(source: str) -> tuple[list[Symbol], list[str]]:
    """Symbols by line and indent, for files that don't parse."""
    lines = lines_of(source, ends=True)
    first, functions, stack = [], [], []
    for i, line in enumerate(lines):
        m = _DEF.match(line)
        if not m:
            continue
        indent = len(m[1].expandtabs())
        while stack and stack[-1][0] >= indent:
            stack.pop()
        end = i + 1
        while end < len(lines) and (not lines[end].strip() or len(lines[end].expandtabs()) - len(lines[end].expandtabs().lstrip()) > indent):
            end += 1
        head = i
        while head < end - 1 and not lines[head].split("#")[0].rstrip().endswith(":"):
            head += 1
        parent = stack[-1][1] if m[2] == "def" and stack and stack[-1][2] == "class" else ""
        s = Symbol(m[3], parent, "".join(lines[i : head + 1]).strip(), "".join(lines[i:end]).strip())
        (functions if m[2] == "def" and not parent else first).append(s)
        stack.append((indent, m[3], m[2]))
    variables = [x.strip() for x in lines if re.match(r"[A-Za-z_]\w*\s*(:[^=]+)?=[^=]", x)]
    return first + functions, variables


# -- TypeScript and JavaScript


# Names whose top-level calls are no symbols.
STOP_CALLS = frozenset(
    "require console expect describe test it beforeEach afterEach beforeAll afterAll Object Array String Number Boolean "
    "Symbol Promise Map Set Error process window document".split()
)

_SCRIPT_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))"
    r"|(?P<text>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?)"
    r"|(?P<name>[#A-Za-z_$][\w$]*)"
    r"|(?P<op>=>|[^\sA-Za-z_$])"
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


def script_tokens(source: str) -> list[Token]:
    """Names, texts and single-character operators of a script, without comments and white space."""
    out, at = [], 0
    while at < len(source):
        last = out[-1].text if out else ""
        if source[at] == "/" and (not out or last in "(,=:[!&|?{};+-*%<>~^" or last in ("return", "=>", "typeof", "case")):
            if m := _REGEX.match(source, at):
                out.append(Token("text", m[0], at, m.end()))
                at = m.end()
                continue
        m = _SCRIPT_TOKEN.match(source, at)
        if not m:
            at += 1
            continue
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], at, m.end()))
        at = m.end()
    return out


_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class _Script:
    """A scanner over tokens that knows brackets and statements, and nothing of types."""

    def __init__(self, source: str) -> None:
        self.source, self.tokens = source, script_tokens(source)
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.text in _OPEN and t.kind == "op":
                stack.append(i)
            elif t.text in _CLOSE and t.kind == "op" and stack:
                self.match[stack.pop()] = i
        for i in stack:
            self.match[i] = len(self.tokens) - 1

    def text(self, a: int, b: int) -> str:
        """The source from token a to token b, both included."""
        return self.source[self.tokens[a].start : self.tokens[min(b, len(self.tokens) - 1)].end]

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].text in texts and self.tokens[i].kind != "text"

    def name(self, i: int) -> str | None:
        return self.tokens[i].text if i < len(self.tokens) and self.tokens[i].kind == "name" else None

    def body(self, i: int, stop: int) -> int | None:
        """The `{` that opens a declaration's body: the first outside brackets that isn't part of a type."""
        angle, after_colon = 0, False
        while i < stop:
            t = self.tokens[i]
            if t.kind == "op":
                if t.text == "<":
                    angle += 1
                elif t.text == ">" and angle:
                    angle -= 1
                elif t.text == ":":
                    after_colon = True
                elif t.text == "{":
                    if angle or (after_colon and self.is_(i - 1, ":", "|", "&")):
                        i = self.match[i]
                    else:
                        return i
                elif t.text in "([":
                    i = self.match[i]
                elif t.text == ";":
                    return None
            i += 1
        return None

    def statement(self, i: int, stop: int) -> int:
        """The last token of the statement that begins at token i."""
        line_end = False
        while i < stop:
            t = self.tokens[i]
            if t.kind == "op" and t.text == ";":
                return i
            if t.kind == "op" and t.text in _OPEN:
                i = self.match[i]
            line_end = i + 1 < stop and "\n" in self.source[self.tokens[i].end : self.tokens[i + 1].start]
            if line_end and not self.is_(i, ",", "=", "(", "=>", "+", "-", "*", "/", "?", ":", "&", "|", ".", "<") and not self.is_(
                i + 1, ".", ",", "=", "+", "-", "*", "/", "?", ":", "&", "|", "(", ")", "]", "}", "=>", ";"
            ):
                return i
            if i + 1 < stop and self.is_(i + 1, ";"):
                return i + 1
            i += 1
        return max(i - 1, 0)


def _script(source: str) -> Extraction:
    s = _Script(source)
    first: list[Symbol] = []
    functions: list[Symbol] = []
    extra: list[Symbol] = []
    variables: list[str] = []

    def members(name: str, a: int, b: int) -> Iterator[Symbol]:
        """Methods of a class body between the braces a and b."""
        i = a + 1
        while i < b:
            if s.is_(i, ";"):
                i += 1
                continue
            start = i
            while s.is_(i, "@"):  # decorators belong to no signature
                i += 2
                while s.is_(i, "."):
                    i += 2
                i = s.match[i] + 1 if s.is_(i, "(") else i
            begin, j, called = i, i, None
            while j < b and not s.is_(j, ";", "=", "{"):
                if s.is_(j, "("):
                    called = j
                    break
                if j > i and not s.is_(j, "<", ">", ",") and "\n" in source[s.tokens[j - 1].end : s.tokens[j].start] and not s.is_(j - 1, "*"):
                    break
                j = s.match[j] + 1 if s.is_(j, "[") else j + 1
            if called is not None:
                k = called - 1
                if s.is_(k, ">"):
                    while k > begin and not s.is_(k, "<"):
                        k -= 1
                    k -= 1
                body = s.body(called, b)
                label = s.name(k)
                end_head = s.match[called]
                gap = source[s.tokens[end_head].end : s.tokens[body].start] if body is not None else "\n;"
                if body is not None and label and ";" not in gap:
                    if not label.startswith("#"):
                        yield Symbol(label, name, source[s.tokens[begin].start : s.tokens[body].start].strip(), s.text(begin, s.match[body]))
                    i = s.match[body] + 1
                    continue
            i = max(s.statement(start, b) + 1, start + 1)

    def patterns(i: int) -> list[str]:
        """Names bound by the object or array pattern at token i."""
        out, b = [], s.match[i]
        j = i + 1
        while j < b:
            if s.is_(j, "{", "["):
                out += patterns(j)
                j = s.match[j]
            elif s.name(j) and not s.is_(j + 1, ":") and not s.is_(j - 1, "="):
                out.append(s.name(j))
            j += 1
        return out

    def walk(a: int, b: int, top: bool) -> None:
        i = a
        while i < b:
            t = s.tokens[i]
            exported = i
            while s.is_(i, "export", "default", "declare", "abstract", "async") and i + 1 < b:
                i += 1
            t = s.tokens[i]
            lead = i - 1 if i > exported and s.is_(i - 1, "async", "abstract") else i
            done = None
            if s.is_(i, "class") and s.name(i + 1) and not s.is_(i - 1, "."):
                body = s.body(i + 1, b)
                if body is not None:
                    end = s.match[body]
                    first.append(Symbol(s.name(i + 1), "", source[s.tokens[lead].start : s.tokens[body].start].strip(), s.text(lead, end)))
                    first.extend(members(s.name(i + 1), body, end))
                    walk(body + 1, end, False)
                    done = end
            elif s.is_(i, "function") and not s.is_(i - 1, "."):
                n = i + 2 if s.is_(i + 1, "*") else i + 1
                body = s.body(n, b)
                if body is not None:
                    end = s.match[body]
                    if s.name(n) and (exported < i or i == a or not s.is_(i - 1, "=", "(", ",", ":", "=>", "return")):
                        functions.append(Symbol(s.name(n), "", source[s.tokens[lead].start : s.tokens[body].start].strip(), s.text(lead, end)))
                    walk(body + 1, end, False)
                    done = end
            elif s.is_(i, "interface", "enum", "namespace", "module") and s.name(i + 1) and (body := s.body(i + 1, b)) is not None:
                end = s.match[body]
                if s.is_(i, "interface", "enum"):
                    lead = i - 1 if s.is_(i, "enum") and s.is_(i - 1, "const") else i
                    extra.append(Symbol(s.name(i + 1), "", source[s.tokens[lead].start : s.tokens[body].start].strip(), s.text(lead, end)))
                else:
                    walk(body + 1, end, False)
                done = end
            elif s.is_(i, "type") and s.name(i + 1) and s.is_(i + 2, "=", "<"):
                end = s.statement(i, b)
                extra.append(Symbol(s.name(i + 1), "", s.text(i, end).strip(), s.text(i, end)))
                done = end
            elif s.is_(i, "const", "let", "var") and not s.is_(i + 1, "enum") and (s.name(i + 1) or s.is_(i + 1, "{", "[")):
                end = s.statement(i, b)
                if top:
                    variables.append(s.text(exported, end).strip())
                walk(i + 1, end, False)
                done = end
            elif top and s.name(i) and exported == i and not s.is_(i, "import", "if", "for", "while", "return", "switch", "try", "throw", "new", "await"):
                end, j = s.statement(i, b), i + 1
                while s.is_(j, ".") and s.name(j + 1):
                    j += 2
                # a call of a name or of one member of a name
                if s.is_(j, "(") and j - i <= 3 and s.match[j] >= end - 1 and t.text not in STOP_CALLS:
                    whole = s.text(i, s.match[j])
                    shown = s.text(i, end)
                    extra.append(Symbol(t.text, "", shown.strip(), shown if s.is_(end, ";") else whole))
                walk(i + 1, end, False)
                done = end
            i = (done if done is not None else i) + 1

    walk(0, len(s.tokens), True)
    return Extraction(first + functions + extra, variables)


EXTRACTORS: dict[str, Callable[[str], Extraction]] = {"python": _python, "typescript": _script, "javascript": _script}


def extract(source: bytes | str, language: str) -> Extraction:
    """Symbols of a source: classes with their methods, then functions, then the rest; and its top-level variables.

    A file that can't be parsed still gives what its lines show, with the error beside it.
    """
    text = source.decode("utf-8", "replace") if isinstance(source, (bytes, bytearray, memoryview)) else source
    return EXTRACTORS[language](text)

"""Markdown block structure: which lines are headings. Plain functions, used by the operators in batches."""

from __future__ import annotations

import re

_NEWLINE = re.compile(r"\r\n|\r|\n")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])( {1,4})(?=\S)")
_RULE = re.compile(r" {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
_RAW = re.compile(r" {0,3}<(?:(script|pre|style|textarea)(?=[\s>]|$)|(!--)|(\?)|(!\[CDATA\[)|(![A-Za-z]))", re.I)
_TAG = re.compile(
    r" {0,3}</?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div"
    r"|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main"
    r"|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title"
    r"|tr|track|ul)(?=[\s/>]|$)",
    re.I,
)
_CODE_LABEL = re.compile(r"^`[^`]+`$")


def lines_of(text: str) -> list[str]:
    """Lines as the block parser counts them: only CR, LF and CRLF end one."""
    lines = _NEWLINE.split(text)
    return lines[:-1] if lines and lines[-1] == "" else lines


def _inner(line: str) -> tuple[str, bool]:
    """A line without quote and list markers, and whether there were any."""
    inside = False
    while True:
        m = _QUOTE.match(line) or (None if _RULE.match(line) else _ITEM.match(line))
        if not m:
            return line, inside
        line, inside = line[m.end() :], True


def _raw_end(m: re.Match) -> str:
    return f"</{m[1].lower()}>" if m[1] else "-->" if m[2] else "?>" if m[3] else "]]>" if m[4] else ">"


def parse_headings(text: str) -> list[tuple[int, str, int, int]]:
    """(level, text, first line, line after) of every ATX and setext heading, also in quotes and list items.

    Lines in code fences, indented code and raw HTML are no headings.
    """
    out: list[tuple[int, str, int, int]] = []
    fence = end = ""
    to_blank = False
    paragraph: list[str] = []
    start, para_inside = 0, False
    for i, raw in enumerate(lines_of(text)):
        line, inside = _inner(raw)
        if fence:
            close = line.strip()
            if close and set(close) == {fence[0]} and len(close) >= len(fence) and not line.startswith("    "):
                fence = ""
            continue
        if end:
            if end in line.lower():
                end = ""
            continue
        if to_blank:
            to_blank = bool(line.strip())
            continue
        if not line.strip():
            paragraph = []
            continue
        if not paragraph and (line.startswith("    ") or line.startswith("\t")):
            continue
        if m := _FENCE.match(line):
            fence, paragraph = m[1], []
            continue
        if m := _RAW.match(line):
            paragraph = []
            if _raw_end(m) not in line[m.end() :].lower():
                end = _raw_end(m)
            continue
        if _TAG.match(line):
            paragraph, to_blank = [], True
            continue
        if m := _ATX.match(line):
            paragraph = []
            out.append((len(m[1]), (m[2] or "").strip(), i, i + 1))
            continue
        if paragraph and inside == para_inside and (m := _UNDERLINE.match(line)):
            out.append((1 if m[1][0] == "=" else 2, "\n".join(x.strip() for x in paragraph), start, i + 1))
            paragraph = []
            continue
        if _RULE.match(line):
            paragraph = []
            continue
        if not paragraph or inside and not (para_inside and _QUOTE.match(raw)):
            paragraph, start, para_inside = [line], i, inside
        else:
            paragraph.append(line)
    return out


def is_code_label(heading: str) -> bool:
    return bool(_CODE_LABEL.match(heading.strip()))


def split_sections(text: str) -> list[tuple[int, str, str, int, int, int]]:
    """(ordinal, heading, body, first heading line, first body line, line after) of each section.

    A section ends at the next heading of any level; headings that are only a code label don't split, and what
    stands before the first heading belongs to no section.
    """
    lines = lines_of(text)
    kept = [h for h in parse_headings(text) if not is_code_label(h[1])]
    ends = [h[2] for h in kept[1:]] + [len(lines)]
    return [(n, h, "\n".join(lines[le:e]).strip(), ls, le, e) for n, ((_, h, ls, le), e) in enumerate(zip(kept, ends))]


def get_section(text: str, heading: str) -> str:
    """The body of the first section with this heading, or an empty string."""
    return next((s[2] for s in split_sections(text) if s[1] == heading), "")


def replace_section(text: str, heading: str, body: str) -> str:
    """The text with another body for the first section with this heading; unchanged without such a heading."""
    found = next((s for s in split_sections(text) if s[1] == heading), None)
    if found is None:
        return text
    pieces = [m.end() for m in _NEWLINE.finditer(text)]
    starts = [0, *pieces]

    def at(line: int) -> int:
        return starts[line] if line < len(starts) else len(text)

    head = text[at(found[3]) : at(found[4])]
    if head and not head.endswith(("\n", "\r")):
        head += "\n"
    return text[: at(found[3])] + head + "\n" + body + "\n\n" + text[at(found[5]) :]

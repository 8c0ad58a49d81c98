"""Small files on the driver: atomic writes and ignore rules."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path


def atomic_write(path: Path, content: str) -> None:
    """Writes a text so that readers see the old or the new one, never a part."""
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        Path(temp).unlink(missing_ok=True)
        raise


@dataclass(frozen=True)
class Rule:
    """A line of an ignore file: what it matches, and whether it takes back an earlier match."""

    matches: re.Pattern
    negated: bool


def _glob(pattern: str) -> str:
    """The regular expression of a path pattern with `*`, `?`, `[...]` and `**`."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.+", i + 3
        elif pattern[i] == "*":
            while i < len(pattern) and pattern[i] == "*":
                i += 1
            out += "[^/]*"
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end].replace("\\", r"\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif pattern[i] == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return out


def parse_rules(lines: Iterable[str]) -> list[Rule]:
    """Rules of an ignore file; blank lines and comments are none."""
    rules = []
    for line in lines:
        text = line.rstrip("\r\n")
        text = text if text.endswith("\\ ") else text.rstrip(" ")
        if not text or text.startswith("#"):
            continue
        negated = text.startswith("!")
        text = text[1:] if negated else text.removeprefix("\\") if text[:2] in ("\\!", "\\#") else text
        folder = text.endswith("/")
        text = text.rstrip("/")
        if not text:
            continue
        anchored = "/" in text
        body = _glob(text.removeprefix("/"))
        # a match covers everything below it; a pattern for folders needs something below
        rules.append(Rule(re.compile(("" if anchored else "(?:.*/)?") + body + ("/.*" if folder else "(?:/.*)?"), re.S), negated))
    return rules


def ignored(rules: list[Rule], path: str) -> bool:
    """Whether the last rule that matches a path, relative to the rules' folder, leaves it ignored."""
    return next((not r.negated for r in reversed(rules) if r.matches.fullmatch(path)), False)


class IgnoreTree:
    """The ignore files of a tree: a path is ignored if those of the root or of any folder above it say so."""

    def __init__(self, root: str | Path, nested: bool = True) -> None:
        self.root, self.nested = Path(root), nested
        self.known: dict[str, list[Rule]] = {}

    def rules(self, folder: str) -> list[Rule]:
        if folder not in self.known:
            try:
                lines = (self.root / folder / ".gitignore").read_text(encoding="utf-8").split("\n")
            except (OSError, ValueError):
                lines = []
            self.known[folder] = parse_rules(lines)
        return self.known[folder]

    def ignores(self, path: str, is_dir: bool = False) -> bool:
        """Whether a path relative to the root is ignored; each file speaks for itself, none undoes another."""
        shown = path + "/" if is_dir else path
        if ignored(self.rules(""), shown.rstrip("/")) or (is_dir and ignored(self.rules(""), shown)):
            return True
        if self.nested:
            parts = path.split("/")
            for n in range(1, len(parts)):
                folder, rest = "/".join(parts[:n]), "/".join(parts[n:])
                if ignored(self.rules(folder), rest) or (is_dir and ignored(self.rules(folder), rest + "/")):
                    return True
        return False

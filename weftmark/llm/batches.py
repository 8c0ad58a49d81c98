"""How many texts a worker handles at once."""

from __future__ import annotations

from collections.abc import Iterator

#: Characters of texts handled at once; a longer text is handled alone.
CHARS = 4_000_000


def slices(texts: list[str | None], rows: int, chars: int = CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most `rows` texts and, unless it is one text, about `chars` characters."""
    lo = n = 0
    for hi, t in enumerate(texts):
        if hi > lo and (hi - lo >= rows or n + len(t or "") > chars):
            yield lo, hi
            lo, n = hi, 0
        n += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)

"""Cutting oversized texts at topic boundaries found by lexical cohesion."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.operators.versions import SECTION_KEY, current_versions

PIECES = (
    "file_path string, heading string, chunk_index int, piece int, n_pieces int, start int, "
    "overlap int, text string"
)

_WORD = re.compile(r"[^\W\d_]{2,}")
#: A gap after a blank line, after a line, and after a sentence (with the quotes and brackets that close it).
_GAP = re.compile(r"(?P<par>\n[^\S\n]*\n\s*)|(?P<line>\n[^\S\n]*)|[.!?…]+[\"'”’)\]]*(?P<end>\s+)|[。！？]+[」』）]*(?P<cjk>)")
_FENCE = re.compile(r"^[^\S\n]*(```|~~~)", re.M)
_SPACE = re.compile(r"\s+")
#: The order of kinds among gaps of one depth: paragraphs first, lines within code fences last.
_BONUS = {"par": 0.2, "end": 0.0, "cjk": 0.0, "line": 0.0, "code": -0.5}


def _gaps(text: str) -> tuple[list[int], list[float]]:
    """Positions where a piece may begin, with the bonus of their kind."""
    fences = [m.start() for m in _FENCE.finditer(text)]
    at, bonus = [], []
    for m in _GAP.finditer(text):
        kind = m.lastgroup
        if 0 < m.end() < len(text):
            inside = bisect_right(fences, m.end() - 1) % 2 == 1
            at.append(m.end())
            bonus.append(_BONUS["code" if inside and kind != "par" else kind] - 0.3 * (inside and kind == "par"))
    return at, bonus


def cohesion_depths(text: str, gaps: list[int], block: int = 40) -> np.ndarray:
    """How deep the lexical similarity dips at each gap (text tiling).

    The words in the `block` words before and after a gap are compared by the cosine of their counts; the
    depth of a gap is how far the similarity climbs from it to the nearest peak on either side, added up.
    """
    ids: dict[str, int] = {}
    starts, words = [], []
    for m in _WORD.finditer(text):
        starts.append(m.start())
        words.append(ids.setdefault(m.group().lower(), len(ids)))
    if not gaps or not words:
        return np.zeros(len(gaps))
    pad = np.concatenate([np.full(block, -1), np.asarray(words), np.full(block, -2)])
    at = np.searchsorted(np.asarray(starts), np.asarray(gaps)) + block
    near = np.arange(block)
    sims = np.empty(len(gaps))
    for i in range(0, len(gaps), 256):
        left, right = pad[at[i : i + 256, None] - 1 - near], pad[at[i : i + 256, None] + near]

        def equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).sum((1, 2))

        sims[i : i + 256] = equal(left, right) / np.sqrt(np.maximum(equal(left, left) * equal(right, right), 1))
    # the climb to the nearest peak: a running maximum that starts anew wherever the similarity falls
    def climb(s: np.ndarray) -> np.ndarray:
        peak = np.empty(len(s))
        for j in range(len(s)):
            peak[j] = peak[j - 1] if j and s[j - 1] >= s[j] else s[j]
        return peak - s

    return climb(sims) + climb(sims[::-1])[::-1]


def _hard(text: str, low: int, high: int) -> int:
    """The last position in (low, high] that parts neither a word, if any can be kept, nor a combined character."""
    spaces = [m.end() for m in _SPACE.finditer(text, low + 1, high) if m.end() < high or text[high - 1].isspace()]
    if spaces:
        return spaces[-1]
    at = high
    while at > low + 1 and at < len(text) and (unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1] == "‍"):
        at -= 1
    return at if at > low + 1 else high


def split_text(text: str, limit: int = 2000, overlap: int = 200) -> list[tuple[int, int, str]]:
    """(start, overlap, piece) of a text: pieces of at most `limit` characters, in order.

    A piece is what lies between two cuts, with the `overlap` characters before it at most, from a gap or a
    word on. Cuts are the deepest gaps of lexical cohesion among those that leave a piece of at least half
    the room, of equally deep ones those between paragraphs, then the last; where a window has no gap, the cut is at the last white space, and without that at the limit.
    A text within the limit is one piece. Without the overlaps the pieces make up the text again.
    """
    if len(text) <= limit:
        return [(0, 0, text)]
    gaps, bonus = _gaps(text)
    depth, kind = cohesion_depths(text, gaps), np.asarray(bonus)
    out, cut = [], 0
    while cut < len(text):
        back = 0
        if out and overlap:
            low = cut - overlap
            g = bisect_left(gaps, low)
            if g < len(gaps) and gaps[g] < cut:
                back = cut - gaps[g]
            else:
                m = _SPACE.search(text, max(low - 1, 0), cut)
                back = cut - m.end() if m and low <= m.end() < cut else overlap
        room = limit - back
        if len(text) - cut <= room:
            end = len(text)
        else:
            lo, hi = bisect_left(gaps, cut + room // 2), bisect_right(gaps, cut + room)
            if lo < hi:
                best = lo + int(np.lexsort((np.arange(hi - lo), kind[lo:hi], depth[lo:hi]))[-1])
                end = gaps[best]
            else:
                end = _hard(text, cut + room // 2, cut + room)
        out.append((cut - back, back, text[cut - back : end]))
        cut = end
    return out


def _split_batches(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, heading, chunk, content in pdf.itertuples(index=False, name=None):
                chunk = None if chunk is None or chunk != chunk else int(chunk)
                pieces = split_text(content, limit, overlap)
                yield pd.DataFrame(
                    [(path, heading, chunk, i, len(pieces), s, o, t) for i, (s, o, t) in enumerate(pieces)],
                    columns=["file_path", "heading", "chunk_index", "piece", "n_pieces", "start", "overlap", "text"],
                ).astype({"chunk_index": "Int32"})

    return run


def oversized(sections: DataFrame, limit: int = 2000) -> DataFrame:
    """Key and content of the current versions longer than `limit` code points.

    Which version is current is found on lengths and hashes; only long contents, which are few, are shuffled.
    """
    slim = sections.select(
        *SECTION_KEY, "committed_at", "seen_at", F.length("content").alias("_n"), F.xxhash64("content").alias("_h")
    )
    long = current_versions(slim, ("_n", "_h")).where(F.col("_n") > limit)
    texts = sections.where(F.length("content") > limit).select(
        *[F.col(k).alias(f"_{k}") for k in SECTION_KEY], "content", F.xxhash64("content").alias("_th")
    )
    same = F.col("_h") == F.col("_th")
    for k in SECTION_KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return long.join(texts, same).groupBy(*SECTION_KEY).agg(F.min("content").alias("content"))


def split_oversized(sections: DataFrame, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """The pieces of all current versions whose content exceeds `limit` characters, numbered from 0.

    `start` is where a piece begins in the content, `overlap` how many of its first characters the piece
    before it holds too. Null, empty and short contents have no piece; a key counts once however often it was
    delivered; null key parts are values; an empty table gives no row. Texts are split one at a time, so a
    very long one costs memory of its own size only.
    """
    return oversized(sections, limit).mapInPandas(_split_batches(limit, overlap), PIECES)

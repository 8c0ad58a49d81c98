"""Passages of held-out items inside a corpus: CGK embedding, bit-sampling LSH, verification by alignment."""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.llm.batches import slices

_TAG = re.compile(r"<[/!]?[A-Za-z][^<>]{0,200}>")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\[nrt](?![a-z])|%([0-9A-Fa-f]{2})")
# Letters of scripts written without spaces (kana, Han, Thai, Lao, Khmer, Myanmar) are words of one letter each.
_ALONE = "\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f"
_RUN = re.compile(f"[{_ALONE}]|[^\\W_{_ALONE}]+")
_LETTER = re.compile(f"[{_ALONE}]")
_NOT_WORD = {i: " " for i in range(128) if not chr(i).isalnum()} | {i: chr(i).lower() for i in range(65, 91)}
_STOP = re.compile(r"[.!?:;\n]+(?:\s|$)")

#: Windows walked at once, which bounds the memory that a very long text takes.
WALKED = 1 << 16

#: Words of texts, once for each of their items, whose meetings are held at once; a longer text meets its items one by one.
MET = 1 << 22

#: Ids of a token outside the items' vocabulary, of the padding after a window, and of a masked item token.
UNKNOWN, PAD, MASKED = 0, 1, 2

#: Words of a text aligned at once, bits of the places that a table's keys are hashed to, and an odd multiplier of keys.
SEGMENT, PLACES, MIX = 8192, 20, np.int64(0x5851F42D4C957F2D)


def _unescape(m: re.Match) -> str:
    if m[1]:
        return chr(int(m[1], 16))
    return chr(int(m[2], 16)) if m[2] and int(m[2], 16) < 128 else " "


def fold(text: str) -> list[str]:
    """The words of a text without case, punctuation, spacing, markup, escaping and Unicode forms.

    A word is a run of letters and digits, or one letter of a script written without spaces. Tags, character references and escapes are undone, format
    characters (zero-width spaces, soft hyphens) and combining marks dropped, compatibility forms replaced.
    """
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text or "%" in text:
        text = _ESCAPE.sub(_unescape, text)
    if text.isascii():
        return text.translate(_NOT_WORD).split()
    text = unicodedata.normalize("NFKD", text).casefold()
    for c in set(text):
        if not c.isascii() and unicodedata.category(c) in ("Mn", "Cf"):
            text = text.replace(c, "")
    return text.translate(_NOT_WORD).split() if text.isascii() else _RUN.findall(text)


def stock_sentences(texts: list[str], p: Params) -> frozenset[tuple[str, ...]]:
    """The folded sentences, of three words or more, that more than `p.stock` of the distinct texts hold."""
    distinct = {tuple(fold(t)): t for t in texts}
    seen = Counter(s for t in distinct.values() for s in {tuple(fold(x)) for x in _STOP.split(t)} if len(s) > 2)
    least = max(3, p.stock * len(distinct))
    return frozenset(s for s, n in seen.items() if n > least)


@dataclass(frozen=True)
class Params:
    """All sizes are in words.

    A passage leaks if item words in aligned spans make up `share` of the item's own words (those outside
    stock sentences); the share asked for is a third, less what altered words at the ends of a passage hide.
    A stock sentence is one that more than `stock` of the distinct items hold.
    """

    share: float = 0.32
    windows: tuple[tuple[int, int], ...] = ((24, 6), (48, 8), (96, 12), (288, 24))  #: least own words of an item, its window
    sample: tuple[tuple[int, int], ...] = ((6, 4), (8, 6), (12, 8), (24, 10))  #: steps that a table samples, by window
    edits: int = 6  #: windows with at most one foreign word in so many are looked up
    walks: int = 4  #: random walks
    tables: int = 5  #: samples of each walk
    kept: float = 0.5  #: share of a passage's words in runs of three that alignment is tried for
    stock: float = 0.04
    span: int = 6  #: words of the shortest aligned span
    least: int = 8  #: words of the shortest passage of an item that has more
    whole: int = 12  #: an item of fewer words must be there whole, but for one word
    seed: int = 20240229


class Table:
    """Keys and their owners, sorted, behind a table of the places that keys are hashed to."""

    def __init__(self, keys: np.ndarray, owners: np.ndarray) -> None:
        both = np.unique(np.stack([keys, owners], 1), axis=0) if len(keys) else np.zeros((0, 2), np.int64)
        self.owners = both[:, 1].copy()
        self.keys, first = np.unique(both[:, 0], return_index=True)
        self.first = np.append(first, len(both))
        self.held = np.zeros(1 << PLACES, bool)
        self.held[self._place(self.keys)] = True

    @staticmethod
    def _place(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PLACES)).view(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which keys the table may have; none that it has is left out."""
        return self.held[self._place(keys)]

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in `keys`, owners) of every match."""
        some = np.flatnonzero(self.has(keys))
        if not len(some):
            return some, some
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        same = self.keys[at] == keys[some]
        some, lo, n = some[same], self.first[at[same]], np.diff(self.first)[at[same]]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(some, n), self.owners[np.repeat(lo, n) + inner]


@dataclass
class Range:
    """Where an alignment is sought: item words from `top` to `bottom`, words of the text from `lo` to `hi`."""

    top: int
    bottom: int
    lo: int
    hi: int
    at: np.ndarray | None  #: places in the item of the runs of three that are shared here, None for spans without any
    span: tuple[int, ...] = ()  #: the best alignment once it is known: -score, ends and starts in item and text, edits

    def kind(self) -> tuple[int, int]:
        """Ranges of about the same size are aligned side by side."""
        n = self.bottom - self.top
        return n >> 5 if n > 31 else (n >> 3) - 4, self.hi - self.lo

    def without(self, mine: np.ndarray) -> bool:
        """Whether anything is left to align with, now that item words are masked."""
        self.span = ()
        if self.at is not None:
            self.at = self.at[mine[self.at[:, None] + np.arange(3)].min(1) > MASKED]
            if len(self.at):
                self.top, self.bottom = int(self.at[0]), int(self.at[-1]) + 3
        return self.at is None or len(self.at) > 0


@dataclass
class Meeting:
    """A text and an item that share runs of words."""

    item: int
    text: np.ndarray  #: the parts of the text around the runs, each after an unknown word
    words: np.ndarray  #: places of the item's words in runs, or of all if runs may be broken
    ranges: list[Range]


@dataclass
class Index:
    """Items in LSH tables, by windows of a size that goes by the item's; built once per worker from the items alone.

    Each run of an item's own words that holds its window is in the tables of that size. Items too small for any
    window, and runs shorter than it, are looked up exactly, by the runs of words that no admitted edit breaks.
    """

    items: list[tuple[int, str]]
    p: Params = field(default_factory=Params)
    stock: frozenset[tuple[str, ...]] | None = None

    def __post_init__(self) -> None:
        p = self.p
        words = [(i, fold(t or "")) for i, t in self.items]
        words = [(i, w) for i, w in words if w]
        self.ids = np.array([i for i, _ in words], np.int64)
        vocabulary: dict[str, int] = {}
        for _, w in words:
            for x in w:
                vocabulary.setdefault(x, len(vocabulary) + 3)
        self.vocabulary = vocabulary
        self.size = len(vocabulary) + 3
        if self.stock is None:
            self.stock = stock_sentences([t or "" for _, t in self.items], p)
        masks = self._masks([w for _, w in words])
        self.tokens = []
        for (_, w), mask in zip(words, masks):
            t = np.array([vocabulary[x] for x in w], np.int64)
            t[mask] = MASKED
            self.tokens.append(t)
        self.own = np.array([int((t != MASKED).sum()) for t in self.tokens], np.int64)
        # letters of scripts without spaces say about half as much as words
        self.spans = [p.span * (2 if sum(map(bool, map(_LETTER.match, w))) * 2 > len(w) else 1) for _, w in words]
        self.need = np.array([self._needed(int(n)) for n in self.own], np.float64)
        self.spans = [min(s, max(1, int(np.ceil(n)))) for s, n in zip(self.spans, self.need)]
        # runs of own words, of two for small items
        self.runs = []
        for t, own in zip(self.tokens, self.own):
            ok = (t[:-1] != MASKED) & (t[1:] != MASKED)
            pair = t[:-1] * self.size + t[1:]
            if own < p.windows[0][0]:
                self.runs.append(np.unique(pair[ok]))
            else:
                self.runs.append(np.unique(pair[:-1][ok[:-1] & ok[1:]] * self.size + t[2:][ok[:-1] & ok[1:]]))
        # runs of three own words at each place of all items
        flat = np.concatenate([x for t in self.tokens for x in (t, [MASKED, MASKED])]).astype(np.int64) if self.tokens else np.zeros(0, np.int64)
        self.begin = np.cumsum([0, *(len(t) + 2 for t in self.tokens)])
        places = self._threes(flat)
        self.threes = Table(self._triples(flat)[places], places)
        own = [np.unique(t[t > MASKED]) + k * self.size for k, t in enumerate(self.tokens)]
        words_of = np.concatenate(own) if own else np.zeros(0, np.int64)
        self.words = Table(words_of, np.zeros(len(words_of), np.int64))
        self.small = self.own < p.windows[0][0]
        self.wide = np.array([bool(few) or s < 6 for few, s in zip(self.small, self.spans)], bool)
        self._tables()

    def _needed(self, own: int) -> float:
        """Item words that spans must cover."""
        p = self.p
        if own < p.whole:
            return float(own - (own > 4))
        return max(p.share * own, min(p.least, own))

    def _masks(self, words: list[list[str]]) -> list[np.ndarray]:
        """Which words of each item belong to a stock sentence."""
        lengths = sorted({len(s) for s in self.stock})
        masks = []
        for w in words:
            mask = np.zeros(len(w), bool)
            for n in lengths:
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) in self.stock:
                        mask[i : i + n] = True
            masks.append(mask)
        return masks

    def _runs(self, tokens: np.ndarray) -> list[tuple[int, int]]:
        """Start and end of the runs of own words."""
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (tokens != MASKED).astype(np.int8), [0]])))
        return list(zip(edge[::2].tolist(), edge[1::2].tolist()))

    def _gram(self, own: int, run: int) -> int:
        """Words in a row that a run shares with a text, whatever edits are admitted."""
        if own < 5:
            return min(own, run)
        return min(run, own // 2, 4 if own < self.p.whole else 3)

    def _tables(self) -> None:
        """Places of items in tables: CGK windows by size, and runs of words by length."""
        p, rng = self.p, np.random.default_rng(self.p.seed)
        flat = np.concatenate([x for t in self.tokens for x in (t, [MASKED])]).astype(np.int64) if self.tokens else np.zeros(0, np.int64)
        at, windows, grams = 0, {}, {}
        for k, t in enumerate(self.tokens):
            size = max((w for least, w in p.windows if self.own[k] >= least), default=0)
            for i, j in self._runs(t):
                if size and j - i >= size:
                    windows.setdefault(size, []).extend((at + s, k) for s in range(i, j - size + 1))
                else:
                    g = self._gram(int(self.own[k]), j - i)
                    grams.setdefault(g, []).extend((at + s, k) for s in range(i, j - g + 1))
            at += len(t) + 1
        self.sizes = sorted(windows)
        samples = dict(p.sample)
        steps = 2 * max(self.sizes, default=0)
        self.bits = rng.integers(0, 2, (p.walks, steps, self.size), np.uint8)
        self.bits[..., PAD] = 1
        self.value = rng.integers(-(2**62), 2**62, self.size, np.int64)
        self.weight = np.random.default_rng([p.seed, 1]).integers(-(2**62), 2**62, steps, np.int64) | 1  # apart, or the samples would be others
        self.chosen = {
            w: [[set(rng.choice(2 * w, samples[w], replace=False).tolist()) for _ in range(p.tables)] for _ in range(p.walks)] for w in self.sizes
        }
        flat = self.padded(flat)
        self.tables: dict[int, list[Table]] = {}
        for w in self.sizes:
            starts, owner = (np.array(x, np.int64) for x in zip(*windows[w]))
            self.tables[w] = [Table(keys, owner) for _, _, keys in self.embed(flat, starts, [w])]
        self.grams: dict[int, Table] = {}
        for g, places in grams.items():
            starts, owner = (np.array(x, np.int64) for x in zip(*places))
            self.grams[g] = Table(self.runs_of(flat, starts, g), owner)

    def embed(self, tokens: np.ndarray, starts: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(size, table, keys) of the windows of `sizes` at `starts` of padded tokens.

        A walk goes over the words with one random bit per step and word saying whether to move on, and copies
        the word it stands on at each step, twice as many steps as the window has words; an edit sets two walks
        apart only until they meet again, so the Hamming distance of copies is bounded by the edits. A table
        samples some positions of the copy. The walk of a small window is the beginning of that of a large one.
        """
        p = self.p
        for walk in range(p.walks):
            at = starts.astype(np.int64)
            keys = {(w, t): np.zeros(len(starts), np.int64) for w in sizes for t in range(p.tables)}
            for step in range(2 * max(sizes)):
                now = tokens.take(at)
                uses = [keys[w, t] for w in sizes for t in range(p.tables) if step in self.chosen[w][walk][t]]
                if uses:
                    value = self.value.take(now)
                    value *= self.weight[step]
                    for key in uses:
                        key += value
                at += self.bits[walk, step].take(now)
            for (w, t), k in keys.items():
                yield w, walk * p.tables + t, k

    def runs_of(self, tokens: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """The keys of the runs of `n` words at `starts` of padded tokens."""
        keys = np.zeros(len(starts), np.int64)
        for i in range(n):
            keys *= MIX
            keys += self.value[tokens[starts + i]]
        return keys

    def padded(self, tokens: np.ndarray) -> np.ndarray:
        """Tokens with as many paddings as a walk can run over their end."""
        return np.concatenate([tokens, np.full(2 * max([2, *self.sizes]), PAD)]).astype(np.int64)

    def encode(self, words: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, UNKNOWN) for w in words], np.int64)

    def candidates(self, tokens: np.ndarray, text_of: np.ndarray, texts: int) -> np.ndarray:
        """Which items (columns) any table finds for which texts (rows); `text_of` is -1 between texts."""
        found = np.zeros((texts, len(self.ids)), bool)

        def mark(starts: np.ndarray, keys: np.ndarray, table: Table) -> None:
            rows, owners = table.look(keys)
            found[text_of[starts[rows]], owners] = True

        unknown = np.concatenate([[0], np.cumsum(tokens == UNKNOWN)])
        padded = self.padded(tokens)
        # a window with more foreign words than edits is near no item's; texts may end inside a window
        near = np.zeros(len(tokens), bool)
        for w in self.sizes:
            ends = np.minimum(np.arange(len(tokens)) + w, len(tokens))
            near |= unknown[ends] - unknown[:-1] <= w // self.p.edits
        starts = np.flatnonzero(near & (text_of >= 0))
        for at in range(0, len(starts), WALKED):
            some = starts[at : at + WALKED]
            for w, t, keys in self.embed(padded, some, self.sizes):
                mark(some, keys, self.tables[w][t])
        known = np.flatnonzero((text_of >= 0) & (tokens > MASKED)) if self.grams else []
        for at in range(0, len(known), WALKED):
            some = known[at : at + WALKED]
            for g, table in self.grams.items():
                mark(some, self.runs_of(padded, some, g), table)
        return found

    def _triples(self, tokens: np.ndarray) -> np.ndarray:
        return (tokens[:-2] * self.size + tokens[1:-1]) * self.size + tokens[2:]

    def _threes(self, tokens: np.ndarray) -> np.ndarray:
        """Where three words in a row are known and not masked."""
        known = tokens > MASKED
        return np.flatnonzero(known[:-2] & known[1:-1] & known[2:])

    def enough(self, tokens: np.ndarray, items: np.ndarray) -> list[Meeting]:
        """Of `items`, those that share enough runs of three words with the text to hold what is needed."""
        row = np.zeros(len(items), np.int64)
        return [x for x in self.meetings(tokens, row, row, row + len(tokens), items) if x]

    def meetings(
        self, tokens: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray, sift: bool = True
    ) -> list[Meeting | None]:
        """For pairs, in order, of a text `tokens[begin:end]`, the `row`th, and an item what they share; with `sift` None if that isn't enough.

        An edit takes at most three words from runs of three, itself and a run of two beside it, so that a passage with
        one edit in eight words keeps five in eight of its words in them; `kept` leaves room for pieces.
        Small items, which a single edit can leave without such a run, all pass.
        """
        pairs, n = len(item), len(self.ids)
        out: list[Meeting | None] = [None] * pairs
        if not pairs:
            return out
        pair_of = np.full((int(row.max()) + 1) * n, -1)
        pair_of[row * n + item] = np.arange(pairs)
        text_of = np.full(len(tokens), -1)
        for x in np.unique(row, return_index=True)[1].tolist():
            text_of[begin[x] : end[x]] = row[x]
        # every place of a text that has a run of an item it is paired with, and the item's places
        some = self._threes(tokens)
        some = some[text_of[some] >= 0]
        keys, got = self._triples(tokens)[some], [(np.zeros(0, np.int64),) * 3]
        for lo in range(0, len(some), WALKED):
            hit, place = self.threes.look(keys[lo : lo + WALKED])
            hit = some[lo + hit]
            pair = pair_of[text_of[hit] * n + np.searchsorted(self.begin, place, "right") - 1]
            mine = np.flatnonzero(pair >= 0)
            got.append((pair[mine], hit[mine], place[mine]))
        pair, hit, place = (np.concatenate(x) for x in zip(*got))
        total = int(self.begin[-1])
        key = np.sort(pair * total + place)
        pair_at, at = np.divmod(key[np.diff(key, prepend=-1) > 0], total)
        # the item's words in runs: a run has as many as are before the next one begins, three at most
        words = np.minimum(np.diff(at, append=total), 3)
        words[:-1][pair_at[1:] != pair_at[:-1]] = 3
        words[-1:] = 3
        held = np.bincount(pair_at, words, pairs)
        passed = (held >= self.p.kept * self.need[item]) | self.small[item] if sift else np.ones(pairs, bool)
        some = passed[pair_at]
        pair_at, at, words = pair_at[some], at[some], words[some]
        of_pair = np.concatenate([[0], np.cumsum(words)])[np.searchsorted(pair_at, np.arange(pairs + 1))]
        at = np.repeat(at - self.begin[item[pair_at]] - np.cumsum(words) + words, words) + np.arange(words.sum())
        # the parts of texts around runs; what a passage has beyond them is parted from them by edits, so a span's length to either side holds it
        mine = (passed & ~self.wide[item])[pair]
        pair, hit, place = pair[mine], hit[mine], place[mine]
        order = np.lexsort((hit, pair))
        pair, hit, place = pair[order], hit[order], place[order]
        reach = self.p.span + 3
        lo, hi = np.maximum(hit - reach, begin[pair]), np.minimum(hit + 3 + reach, end[pair])
        new = np.ones(len(hit), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (lo[1:] > hi[:-1])
        part, first = np.cumsum(new) - 1, np.flatnonzero(new)
        lo, hi, pair_part = lo[first], hi[np.append(first, len(hit))[1:] - 1], pair[first]
        size = hi - lo + 1
        ends = np.cumsum(size)
        flat = tokens[np.arange(size.sum()) + np.repeat(lo - 1 - (ends - size), size)]
        flat[ends - size] = UNKNOWN
        hit += (ends - size + 1 - lo)[part]
        cut = np.searchsorted(pair_part, np.arange(pairs + 1))
        bounds = np.concatenate([[0], ends])[cut]
        # spans lie where scores may be above zero, from either side, if every word of the item's matches and others cost an edit
        score = np.where(self.words.has(np.repeat(item[pair_part] * self.size, size) + flat), 1, -2)
        score[bounds[:-1][cut[1:] > cut[:-1]]] = -2 * len(flat) - 2
        live = _above_zero(score) & _above_zero(score[::-1])[::-1]
        group = np.cumsum(live & ~np.concatenate([[False], live[:-1]]))[hit]
        for _ in range(2):
            group = _parted(_parted(group, place, hit), hit, place)
        # ranges, and the one alignment of those that are a single run
        order = np.argsort(group * total + place, kind="stable")
        group, pair, hit, place = group[order], pair[order], hit[order], place[order] - self.begin[item[pair[order]]]
        new = np.flatnonzero(np.diff(group, prepend=-1))
        ranges: list[list[Range]] = [[] for _ in range(pairs)]
        if len(new):
            of, text_at = pair[new], hit - bounds[pair]
            top, bottom = place[new], np.maximum.reduceat(place, new) + 3
            lo, hi = np.minimum.reduceat(text_at, new), np.maximum.reduceat(text_at, new) + 3
            n = np.diff(new, append=len(group))
            single = (np.minimum.reduceat(place - text_at, new) == np.maximum.reduceat(place - text_at, new)) & (n == bottom - top - 2)
            for x, i, j, *where, run in zip(*(x.tolist() for x in (of, new, new + n, top, bottom, lo, hi, single))):
                ranges[x].append(Range(*where, place[i:j], (where[0] - where[1], where[1], where[3], where[0], where[2], 0) if run else ()))
        for x in np.flatnonzero(passed).tolist():
            k = int(item[x])
            words = at[of_pair[x] : of_pair[x + 1]]
            if self.wide[k]:
                text = self.near(tokens[begin[x] : end[x]], k)
                out[x] = Meeting(k, text, np.arange(len(self.tokens[k])) if self.small[k] else words, [Range(0, len(self.tokens[k]), 0, len(text), None)])
            else:
                out[x] = Meeting(k, flat[bounds[x] : bounds[x + 1]], words, ranges[x])
        return out

    def near(self, tokens: np.ndarray, item: int) -> np.ndarray:
        """The parts of a text around runs of the item's words; what lies between is cut to one unknown word.

        The runs are of three words, or of two for a small item. `meetings` does the same for many other items at once.
        """
        n = 2 if self.small[item] else 3
        own = self.runs[item]
        if not len(own) or len(tokens) < n:  # an item of single words
            return tokens
        run = tokens[:-1] * self.size + tokens[1:] if n == 2 else self._triples(tokens)
        hit = np.flatnonzero(own[np.minimum(np.searchsorted(own, run), len(own) - 1)] == run)
        reach, end = self.p.span + n, len(tokens)
        keep = np.bincount(np.maximum(hit - reach, 0), minlength=end + 1) - np.bincount(np.minimum(hit + n + reach, end), minlength=end + 1)
        inside = np.cumsum(keep[:-1]) > 0
        first = inside & ~np.concatenate([[False], inside[:-1]])
        at = np.flatnonzero(inside)
        return np.insert(tokens[at], np.flatnonzero(first[at]), UNKNOWN)

    def shares(self, pairs: list[tuple[np.ndarray, int]]) -> list[float]:
        """For (text, item) pairs, the share of the item's own words in spans aligned with the text, 0 if too small."""
        one = np.zeros(1, np.int64)
        return self.aligned([self.meetings(t, one, one, one + len(t), one + k, sift=False)[0] for t, k in pairs])

    def aligned(self, met: list[Meeting], most: int = 1 << 21) -> list[float]:
        """The share of each item's own words in spans aligned with the text, 0 if too small.

        Spans are found one after another by local alignment, each time without the item words of the spans
        before, and extended over trimmed ends, until the share asked for is reached or no span is left.

        An edit costs what two matches gain, so the best alignment begins and ends with a run of three matches if there
        is any, and else, with its ends, is shorter than any span. So spans are sought in the ranges of a meeting only,
        from the first to the last of the runs of three there, unless spans of less than six words count. A range
        whose item words aren't taken by a span keeps its best alignment.
        """
        p = self.p
        mine = [self.tokens[x.item].copy() for x in met]
        covered, own = np.zeros(len(met)), np.maximum(1, self.own[[x.item for x in met]])
        ranges: list[list[Range]] = []
        for m, t in zip(met, mine):
            # a long range is aligned in segments that overlap by more than any span, so none is lost
            step = SEGMENT - 4 * len(t)
            ranges.append([])
            for r in m.ranges:
                cut = not r.span and r.hi - r.lo > SEGMENT and step > 0
                ranges[-1] += [replace(r, lo=i, hi=min(i + SEGMENT, r.hi)) for i in range(r.lo, r.hi - 4 * len(t), step)] if cut else [r]
        todo = [x for x, r in enumerate(ranges) if r]
        while todo:
            work: list[tuple[int, Range]] = []
            for x in todo:
                least = max((-r.span[0] for r in ranges[x] if r.span), default=0)
                work += [(x, r) for r in ranges[x] if not r.span and min(r.bottom - r.top, r.hi - r.lo) >= least]
            work.sort(key=lambda w: w[1].kind())
            at = 0
            while at < len(work):
                end, tall, wide = at, 0, 0
                while end < len(work) and end - at < 4096:
                    r = work[end][1]
                    more = max(tall, r.bottom - r.top), max(wide, r.hi - r.lo)
                    if end > at and (end + 1 - at) * (more[0] + 1) * (more[1] + 1) > most:
                        break
                    (tall, wide), end = more, end + 1
                some, at = work[at:end], end
                spans = _spans([mine[x][r.top : r.bottom] for x, r in some], [met[x].text[r.lo : r.hi] for x, r in some])
                for (_, r), (score, i0, i1, j0, j1, edits) in zip(some, spans):
                    r.span = (-score, i1 + r.top, j1 + r.lo, i0 + r.top, j0 + r.lo, edits)
            left = []
            for x in todo:
                k = met[x].item
                # of equal ones the first by its end, as if item and text were aligned as a whole
                _, i1, j1, i0, j0, edits = min(r.span for r in ranges[x] if r.span)
                i0, i1 = extended(mine[x].tolist(), met[x].text.tolist(), i0, i1, j0, j1, edits)
                if i1 - i0 >= self.spans[k]:
                    covered[x] += int((mine[x][i0:i1] != MASKED).sum())
                    mine[x][i0:i1] = MASKED
                    if covered[x] < self.need[k] <= covered[x] + (mine[x][met[x].words] != MASKED).sum() / p.kept:
                        ranges[x] = [r for r in ranges[x] if r.bottom <= i0 or r.top >= i1 or r.without(mine[x])]
                        if ranges[x]:
                            left.append(x)
            todo = left
        return np.where(covered >= self.need[[x.item for x in met]], covered / own, 0.0).tolist()


def _above_zero(score: np.ndarray) -> np.ndarray:
    """Where the sum of scores, which starts anew at zero whenever it would fall below, is above zero."""
    total = np.cumsum(score)
    return total > np.minimum.accumulate(np.concatenate([[0], total]))[:-1]


def _parted(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Groups of shared runs of three, at places `a` and `b`, parted where no alignment gets over a gap in `a`.

    An alignment over a gap matches at most as many words as its group has in `b`, three of them beyond the gap
    and three before it. Words of the gap that don't match cost two each, and the sum stays above zero.
    """
    if not len(group):
        return group
    order = np.lexsort((a, group))
    group, a, b = group[order], a[order], b[order]
    new = np.diff(group, prepend=-1) != 0
    first = np.flatnonzero(new)
    extent = (np.maximum.reduceat(b, first) - np.minimum.reduceat(b, first) + 3)[np.cumsum(new) - 1]
    gap = np.diff(a, prepend=0) - 3
    out = np.empty_like(group)
    out[order] = np.cumsum(new | (gap > 0) & (2 * gap >= 3 * extent - 15)) - 1
    return out


def local_alignments(a: list[np.ndarray], b: list[np.ndarray], edit: int = 2) -> list[tuple[int, int, int]]:
    """For each i (score, start, end) of the span of a[i] in its best local alignment with b[i].

    A match counts 1, an edit -`edit`.
    """
    return [found[:3] for found in _spans(a, b, edit)]


def extended(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int, edits: int) -> tuple[int, int]:
    """The span a[i0:i1], aligned with b[j0:j1], with the ends that local alignment trims.

    An altered word with fewer than three matching ones beyond it costs more than they gain. Each end grows
    over one edit at a time, where words match beyond it, as long as the span has about one edit in eight words.
    """
    if i1 <= i0:
        return i0, i1

    def run(i: int, j: int, step: int) -> int:
        n = 0
        while 0 <= i < len(a) and 0 <= j < len(b) and a[i] == b[j] and a[i] > MASKED:
            i, j, n = i + step, j + step, n + 1
        return n

    more = True
    while more:
        more = False
        for step in (1, -1):
            i, j = (i1, j1) if step > 0 else (i0 - 1, j0 - 1)
            ways = []
            for di, dj in ((1, 1), (1, 0), (0, 1)):  # altered, dropped, added
                if di and not (0 <= i < len(a) and a[i] > MASKED):
                    continue
                n = run(i + step * di, j + step * dj, step)
                if n and edits + 1 <= -(-(i1 - i0 + di + n) // 8):
                    ways.append((n, di, dj))
            if ways:
                n, di, dj = max(ways)
                edits, more = edits + 1, True
                if step > 0:
                    i1, j1 = i1 + di + n, j1 + dj + n
                else:
                    i0, j0 = i0 - di - n, j0 - dj - n
    return i0, i1


#: Room for the scores of one alignment at a time, by kind of number.
_scores: dict[type, np.ndarray] = {}


def _spans(a: list[np.ndarray], b: list[np.ndarray], edit: int = 2) -> list[tuple[int, int, int, int, int, int]]:
    """(score, start and end in a[i], start and end in b[i], edits) of local_alignments."""
    n, m, wide = max(map(len, a)), max(map(len, b)), len(a)
    kind = np.int8 if min(n, m) < 120 else np.int16 if n < 2**14 else np.int32
    # pairs lie side by side, so that each step over a row is one over all pairs
    word = np.int16 if max(int(x.max(initial=0)) for x in (*a, *b)) < 2**15 else np.int32
    left, right = np.full((wide, n), MASKED, word), np.full((wide, m), UNKNOWN, word)
    unmasked = np.ones((wide, n), kind)
    for k, (x, y) in enumerate(zip(a, b)):
        left[k, : len(x)], right[k, : len(y)] = x, y
        unmasked[k, : len(x)] = x > MASKED
    left, right, unmasked = (np.ascontiguousarray(x.T) for x in (left, right, unmasked))
    ends = (~unmasked.all(1)).tolist()
    size = wide * (n + 1) * (m + 1)
    if kind not in _scores or len(_scores[kind]) < size:
        _scores[kind] = np.empty(size, kind)
    score = _scores[kind][:size].reshape(n + 1, m + 1, wide)
    score[0] = 0
    loss, gain = kind(-edit), kind(1 + edit)
    row, step, same = np.zeros((m + 1, wide), kind), np.zeros((m, wide), kind), np.zeros((m, wide), bool)
    for i in range(1, n + 1):
        up, now = score[i - 1], score[i]
        np.equal(right, left[i - 1], out=same)
        if kind is np.int8:
            np.multiply(same.view(np.int8), gain, out=step)
        else:
            np.copyto(step, same)
            step *= gain
        step += up[:-1]
        np.maximum(step, up[1:], out=step)
        step += loss
        np.maximum(step, 0, out=row[1:])
        if ends[i - 1]:
            row *= unmasked[i - 1]  # a masked word ends every span
        # up to three words of the text skipped at once; more of them part two spans
        np.add(row[:-1], loss, out=step)
        np.maximum(row[1:], step, out=row[1:])
        np.add(row[:-2], 2 * loss, out=step[1:])
        now[:2] = row[:2]
        np.maximum(row[2:], step[1:], out=now[2:])
    # the first place, row by row, of the highest score
    tops = score.max(1)
    rows, high = tops.argmax(0).tolist(), tops.max(0).tolist()
    at, out = memoryview(score), []
    for k, (i, top) in enumerate(zip(rows, high)):
        x, y = a[k].tolist(), b[k].tolist()
        j = int(score[i, :, k].argmax())
        last, stop, s, edits = i, j, top, 0
        while i and j and s > 0:
            match = 1 if x[i - 1] == y[j - 1] else -edit
            edits += 1
            if s == at[i - 1, j - 1, k] + match:
                i, j, edits = i - 1, j - 1, edits - (match == 1)
            elif s == at[i - 1, j, k] - edit:
                i -= 1
            else:
                j -= 1
            s = at[i, j, k]
        out.append((top, i, last, j, stop, edits))
    return out


_indexes: dict[bytes, Index] = {}


def index(items: list[tuple[int, str]], p: Params, stock: frozenset[tuple[str, ...]]) -> Index:
    """One index per block of items and worker process."""
    name = hashlib.sha256(repr((items, p)).encode("utf-8", "surrogatepass")).digest()
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = Index(items, p, stock)
    return _indexes[name]


def leaks(texts: list[str | None], ix: Index) -> list[tuple[int, int, float]]:
    """(row, item id, share) of every leak in the texts."""
    get, gap = ix.vocabulary.get, [UNKNOWN] * (2 * max(ix.sizes, default=1))
    flat: list[int] = []
    begins, ends = [], []
    for t in texts:
        begins.append(len(flat))
        if t:
            flat.extend(map(get, fold(t), repeat(UNKNOWN)))
        ends.append(len(flat))
        flat += gap  # no window spans two texts
    tokens = np.array(flat, np.int64)
    text_of = np.full(len(tokens), -1)
    for row, (i, j) in enumerate(zip(begins, ends)):
        text_of[i:j] = row
    row, item = np.nonzero(ix.candidates(tokens, text_of, len(texts)))
    begin, end = np.array(begins, np.int64)[row], np.array(ends, np.int64)[row]
    out, words, lo = [], np.cumsum(end - begin), 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(words, MET + (words[lo - 1] if lo else 0), "right")))
        at = begin[lo]
        met = ix.meetings(tokens[at : end[hi - 1]], row[lo:hi] - row[lo], begin[lo:hi] - at, end[lo:hi] - at, item[lo:hi])
        rows, met = [r for r, x in zip(row[lo:hi].tolist(), met) if x], [x for x in met if x]
        out += [(r, int(ix.ids[x.item]), s) for r, x, s in zip(rows, met, ix.aligned(met)) if s > 0]
        lo = hi
    return out


def find_leaks(
    documents: DataFrame, items: DataFrame, params: Params = Params(), block: int = 2000, rows: int = 1024
) -> DataFrame:
    """(doc_id, item_id, share) for every document that holds an item's text or passages of a third of it.

    Of an item of fewer than 12 words outside stock sentences all must be there, but for one if it has five or more;
    of any other a third and at least 8 words. In scripts without spaces a letter counts as a word.

    Items are a query set: they reach the workers in blocks of `block`, each block one pass over the
    documents, so neither a block's index nor anything else grows with either table. Null and empty texts
    and items have no leak; of an item listed twice both ids come out; each document row counts, and a
    repeated doc_id with the same text gives each pair once. Without items or documents there is no row.
    Texts are searched whole. There is no shuffle but that for distinct pairs.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id bigint, share double"
    slim = documents.select("doc_id", "text").where(F.length("text") > 0)
    chosen = items.select(F.col("item_id").cast("bigint"), "text").where(F.length("text") > 0)
    stock = _stock_of(chosen, params)

    def search(mine: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ix = index(mine, params, stock)
            for pdf in batches:
                ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
                for lo, hi in slices(texts, rows):
                    got = leaks(texts[lo:hi], ix)
                    yield pd.DataFrame([(ids[lo + r], i, s) for r, i, s in got], columns=["doc_id", "item_id", "share"])

        return slim.mapInPandas(run, schema)

    out, mine = None, []
    for r in chosen.orderBy("item_id", "text").toLocalIterator():
        mine.append((r[0], r[1]))
        if len(mine) == block:
            out, mine = (search(mine) if out is None else out.unionByName(search(mine))), []
    if mine or out is None:
        out = search(mine) if out is None else out.unionByName(search(mine))
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def _stock_of(items: DataFrame, p: Params) -> frozenset[tuple[str, ...]]:
    """Stock sentences of all items, counted once, whatever block an item falls in.

    A sentence held by more than `p.stock` of the items can be one of at most 1 / `p.stock` times an item's
    sentences, so few come to the driver.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(" ".join(fold(t)), sorted({" ".join(w) for x in _STOP.split(t) if len(w := fold(x)) > 2})) for t in pdf["text"]]
            yield pd.DataFrame(out, columns=["folded", "sentences"])

    folded = items.select("text").mapInPandas(split, "folded string, sentences array<string>")
    distinct = folded.groupBy("folded").agg(F.first("sentences").alias("sentences"))
    n = distinct.count()
    counts = distinct.select(F.explode("sentences").alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    return frozenset(tuple(r["s"].split(" ")) for r in counts.where(F.col("n") > max(3.0, p.stock * n)).collect())

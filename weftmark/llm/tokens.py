"""Encoding of texts by a public byte-level BPE vocabulary, merged in padded numpy matrices."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.llm.batches import slices

#: Folder of the public vocabulary files, and the file read from it.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

# The published pre-tokenization pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for texts that are all ASCII.
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"

#: Rows of a matrix are padded to the next of these lengths; longer words take the heap.
BUCKETS = (2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128)
ROWS = 4096
NONE = np.int32(2**31 - 1)


class Encoder:
    """Merges of one vocabulary, with the encodings of the words seen by this worker.

    `limit` bounds the words remembered; beyond it all are forgotten. It changes time, never results.
    """

    def __init__(self, path: str, limit: int = 400_000) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, merged = [], []
        for word, rank in ranks.items():
            for i in range(1, len(word)):
                a, b = ranks.get(word[:i]), ranks.get(word[i:])
                if a is not None and b is not None:
                    keys.append((a << 20) | b)
                    merged.append(rank)
        self._build(np.array(keys, np.int64), np.array(merged, np.int32))
        self.pairs = dict(zip(keys, merged))
        self.limit = limit
        self.wide = regex.compile(PATTERN).findall
        self.ascii = re.compile(ASCII_PATTERN, re.ASCII).findall
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.lengths = np.zeros(0, np.int32)
        self.offsets = np.zeros(0, np.int64)
        self.store = np.zeros(0, np.int32)

    # -- hashed pair lookup: open addressing, all probes of a round at once

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _build(self, keys: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = left[self.keys[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            taken = free[first]
            self.keys[at[taken]], self.values[at[taken]] = keys[taken], merged[taken]
            left = np.setdiff1d(left, taken, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged id of each pair, NONE where there is none or where `b` is padding (-1)."""
        keys = (a.astype(np.int64) << 20) | b
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], NONE)
        more = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        for _ in range(self.probes):
            if not len(more):
                break
            at[more] = (at[more] + 1) & self.mask
            seen = self.keys[at[more]]
            hit = seen == keys[more]
            out[more[hit]] = self.values[at[more[hit]]]
            more = more[~hit & (seen >= 0)]
        out[b < 0] = NONE
        return out

    # -- merging

    def merge(self, ids: np.ndarray) -> np.ndarray:
        """Merges rows of a matrix padded with -1: every row its leftmost pair of least rank, each round.

        Rows without a pair leave the matrix (compaction); the result has the shape of the input.
        """
        done = ids.copy()
        n, width = ids.shape
        if not n or width < 2:
            return done
        rows = np.arange(n)
        ranks = self.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        while True:
            best = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), best]
            live = least != NONE
            if not live.all():
                done[rows[~live]] = -1
                done[rows[~live], : ids.shape[1]] = ids[~live]
                rows, ids, ranks, best, least = rows[live], ids[live], ranks[live], best[live], least[live]
                if not len(rows):
                    return done
            cols = np.arange(ids.shape[1] - 1)
            each = np.arange(len(rows))
            take = cols + (cols > best[:, None])
            ids = np.take_along_axis(ids, take, 1)
            ids[each, best] = least
            if ids.shape[1] < 2:
                done[rows] = -1
                done[rows, :1] = ids
                return done
            ranks = np.take_along_axis(ranks, take[:, :-1], 1)
            before = np.maximum(best - 1, 0)
            has = best > 0
            ranks[each[has], before[has]] = self.lookup(ids[each[has], before[has]], ids[each[has], best[has]])
            after = np.minimum(best, ids.shape[1] - 2)
            ranks[each, after] = self.lookup(ids[each, after], ids[each, after + 1])

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges for one long word, by a heap of pairs over a linked list."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := pairs.get((ids[i] << 20) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, j = heapq.heappop(heap)
            if ids[i] < 0 or after[i] != j or ids[j] < 0 or pairs.get((ids[i] << 20) | ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := pairs.get((r << 20) | ids[k])) is not None:
                    heapq.heappush(heap, (x, i, k))
            if (h := before[i]) >= 0 and (x := pairs.get((ids[h] << 20) | r)) is not None:
                heapq.heappush(heap, (x, h, i))
        return [x for x in ids if x >= 0]

    def _encode_words(self, words: list[str]) -> None:
        """Appends the encodings of new words to the store, in the order of the words."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[np.ndarray | None] = [None] * len(raw)
        lengths = np.zeros(len(raw), np.int32)
        bucket = np.searchsorted(BUCKETS, sizes)
        flat = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for k in np.unique(bucket):
            mine = np.flatnonzero(bucket == k)
            if k == len(BUCKETS):
                for i in mine.tolist():
                    out[i] = np.asarray(self.merge_long(raw[i]), np.int32)
                    lengths[i] = len(out[i])
                continue
            width = np.arange(BUCKETS[k])
            for at in range(0, len(mine), ROWS):
                part = mine[at : at + ROWS]
                inside = width < sizes[part, None]
                ids = np.where(inside, flat[np.minimum(starts[part, None] + width, len(flat) - 1)], -1).astype(np.int32)
                ids = self.merge(ids)
                lengths[part] = (ids >= 0).sum(1)
                for i, row, n in zip(part.tolist(), ids, lengths[part].tolist()):
                    out[i] = row[:n]
        offsets = np.cumsum(np.concatenate([[len(self.store)], lengths[:-1].astype(np.int64)])) if len(raw) else []
        self.lengths = np.concatenate([self.lengths, lengths])
        self.offsets = np.concatenate([self.offsets, np.asarray(offsets, np.int64)])
        self.store = np.concatenate([self.store, *[x for x in out if x is not None]])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text i are ids[offsets[i]:offsets[i + 1]]; none for null and empty texts."""
        if len(self.codes) > self.limit:
            self.forget()
        counts, words = np.zeros(len(texts) + 1, np.int64), []
        for i, t in enumerate(texts):
            if t:
                words += self.ascii(t) if t.isascii() else self.wide(t)
            counts[i + 1] = len(words)
        codes = self.codes
        new = [w for w in dict.fromkeys(words) if w not in codes]
        for w in new:
            codes[w] = len(codes)
        if new:
            self._encode_words(new)
        each = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
        lengths = self.lengths[each].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.store[np.repeat(self.offsets[each] - ends[:-1], lengths) + np.arange(ends[-1])]
        return ends[counts], ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per vocabulary and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_texts(
    documents: DataFrame,
    tokenizers: str = TOKENIZERS,
    vocabulary: str = VOCABULARY,
    id: str = "doc_id",
    text: str = "text",
    rows: int = 512,
) -> DataFrame:
    """(id, ids): the token ids of every text, without special tokens.

    Strings that look like special tokens are ordinary text. Null and empty texts give an empty list. Every
    input row gives one row, repeated ids and texts included; an empty table gives none; other columns are
    pruned. There is no shuffle. Texts are encoded `rows` at a time; a very long one costs memory in
    proportion to itself. The vocabulary file must be at the same path on all executors.
    """
    path = f"{tokenizers}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts, rows):
                part = batch.slice(lo, hi - lo)
                offsets, ids = own.encode(texts[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id, "ids"])

    kind = documents.schema[id].dataType.simpleString()
    return documents.select(id, F.col(text)).mapInArrow(run, f"`{id}` {kind}, ids array<int>")

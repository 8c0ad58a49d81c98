"""Filling fixed-capacity containers with whole items by multiway differencing."""

from __future__ import annotations

import hashlib
import heapq
from bisect import insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.functions.text import blank_to_null
from weftmark.operators.versions import SECTION_KEY, current_versions

CONTAINER = (
    "container_id string, n_items int, used int, "
    "items array<struct<file_path:string,heading:string,chunk_index:int,piece:int,content:string>>"
)


def differencing(sizes: Sequence[int], k: int) -> list[list[int]]:
    """Splits items into `k` windows of near-equal sums (Karmarkar-Karp, multiway).

    A partial partition is a list of at most k window sums, the windows it lacks being empty. The two whose
    spreads are greatest are merged with their windows in opposite order, largest with smallest, until one
    partition is left. Only sums and the merge tree are kept; members are read from the tree at the end. Ties
    are broken by age, so equal input gives equal output.
    """
    n = len(sizes)
    if k == 1 or not n:
        return [list(range(n))] + [[] for _ in range(k - 1)]
    # a partition is (sum, node) of its windows that aren't empty, ascending
    heap = [(-int(size), i, [(int(size), i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    left, right, age = [], [], n
    while len(heap) > 1:
        a, b = sorted((heapq.heappop(heap)[2], heapq.heappop(heap)[2]), key=len, reverse=True)
        both = max(0, len(a) + len(b) - k)
        new = b[both:]
        for (x, p), (y, q) in zip(a[:both], reversed(b[:both])):
            new.append((x + y, n + len(left)))
            left.append(p)
            right.append(q)
        a = a[both:]
        if len(new) == 1:
            insort(a, new[0])
        else:
            a = sorted(a + new)
        heapq.heappush(heap, ((a[0][0] if len(a) == k else 0) - a[-1][0], age, a))
        age += 1
    windows = []
    for _, node in reversed(heap[0][2]):
        members, stack = [], [node]
        while stack:
            x = stack.pop()
            if x < n:
                members.append(x)
            else:
                stack += (left[x - n], right[x - n])
        windows.append(sorted(members))
    return windows + [[] for _ in range(k - len(windows))]


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that any packing needs (the bound of Martello and Toth over all thresholds)."""
    if not sizes:
        return 0
    best, s = 0, sorted(sizes, reverse=True)
    total = np.concatenate([[0], np.cumsum(s)])
    a = np.asarray(s)
    for t in {0, *[x for x in s if 2 * x <= capacity]}:
        big = int(np.searchsorted(-a, -(capacity - t), side="left"))  # > capacity - t
        half = int(np.searchsorted(-a, -(capacity / 2), side="left"))  # > capacity / 2
        low = int(np.searchsorted(-a, -t, side="right"))  # >= t
        room = (half - big) * capacity - (total[half] - total[big])
        best = max(best, half + max(0, -(-int(total[low] - total[half] - room) // capacity)))
    return best


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most `capacity`, as few as found, each item of `sizes` (all <= capacity) in one of them.

    The items are differenced into as many windows as any packing needs. Windows within capacity whose unused
    space is small are closed, as long as closing them doesn't raise the number that the rest needs; the rest,
    of windows over capacity or with much unused space, is differenced anew. The unused space allowed doubles
    whenever no window can be closed. When a sixteenth of a container isn't enough either, capacity is exceeded
    whatever is closed: the window count rises by one and the rest is differenced anew, until every window fits.
    Every item gets its window from differencing.
    """
    pool, closed, slack = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), [], max(1, capacity // 200)
    need = lower_bound([sizes[i] for i in pool], capacity)
    while pool:
        windows = [[pool[i] for i in w] for w in differencing([sizes[i] for i in pool], need) if w]
        sums = [sum(sizes[i] for i in w) for w in windows]
        if max(sums) <= capacity:
            closed, pool = closed + windows, []
            break
        good = [w for w, used in zip(windows, sums) if capacity - slack <= used <= capacity]
        gone = {i for w in good for i in w}
        rest = [i for i in pool if i not in gone]
        if good and lower_bound([sizes[i] for i in rest], capacity) <= need - len(good):
            closed, pool, need = closed + good, rest, need - len(good)
        elif slack <= capacity // 16:
            slack *= 2
        else:
            need, slack = need + 1, max(1, capacity // 200)
    return closed


def _pack_batches(capacity: int, shard: int):
    def containers(rows: list[tuple]) -> pd.DataFrame:
        out = []
        for window in pack([len(r[4]) for r in rows], capacity):
            items = [rows[i] for i in window]
            name = "\x1f".join(map(str, items[0][:4]))
            out.append(
                (
                    hashlib.sha256(name.encode("utf-8", "surrogatepass")).hexdigest()[:32],
                    len(items),
                    sum(len(r[4]) for r in items),
                    [dict(zip(("file_path", "heading", "chunk_index", "piece", "content"), r)) for r in items],
                )
            )
        return pd.DataFrame(out, columns=["container_id", "n_items", "used", "items"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for pdf in batches:
            for path, heading, chunk, content in pdf.itertuples(index=False, name=None):
                chunk = None if chunk is None or chunk != chunk else int(chunk)
                for piece, at in enumerate(range(0, len(content), capacity)):
                    rows.append((path, heading, chunk, piece, content[at : at + capacity]))
                if len(rows) >= shard:
                    yield containers(rows)
                    rows = []
        if rows:
            yield containers(rows)

    return run


def fill_containers(sections: DataFrame, capacity: int = 2000, shard: int = 2048) -> DataFrame:
    """Containers of at most `capacity` characters holding the contents of all current versions, whole.

    One row per container: `container_id` (a hash of its first item's key, the same in every run over the
    same layout of the input), `n_items`, `used` characters, and `items` with key, piece number and content.
    A content longer than `capacity` is cut every `capacity` characters; all other contents have one piece, 0.
    Null, empty and blank contents are in no container; equal contents of different keys are different items;
    rows repeated identically count once; null key parts are values. An empty table gives no container.

    The only shuffle is that of the current versions, by key. Each task packs its sorted rows in shards of
    about `shard` items as they come, so memory doesn't grow with the data and no task holds a large group;
    a retried task gives the same containers.
    """
    current = current_versions(sections, ("content",))
    items = current.where(blank_to_null(F.col("content")).isNotNull()).select(*SECTION_KEY, "content")
    return items.mapInPandas(_pack_batches(capacity, shard), CONTAINER)

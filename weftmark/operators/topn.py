"""The N best items of every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows kept per group, as a multiple of `n`, before items are told apart; more repeats than that go the long way.
SPARE = 2

#: Sets of groups of which it is remembered whether one of them must go the long way.
SETS = 1024


def top_n(
    scored: DataFrame, n: int = 5, group: str = "key", item: str = "file", score: str = "rerank_scores", spare: int = SPARE
) -> DataFrame:
    """Up to `n` rows (group, item, score, rank) of every group, best first.

    An item counts once per group, with its highest score; of equal scores the item first in byte order wins.
    A null or NaN score is none, and a row without group or item is no candidate, so groups without a scored
    item don't come out. -0.0 equals 0.0. An empty table gives an empty result; other columns are pruned.

    The `spare` * `n` best rows of a group are found by row_number and a rank filter, whose group limit stands
    before the only shuffle and after it, so of a group of any size each task sends that many rows at most. A
    group has its answer if those rows are all it has, or hold `n` different items: no other row can be better.
    Groups for which neither holds, as their best rows are repeats of a few items, are computed from all their
    rows, together with the few groups of the same set: items are reduced to their highest score before they are
    shuffled, by group and item, and ranked then. Which way a group goes doesn't change its rows.
    """
    rows = scored.where(
        F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)
    ).select(group, item, (F.col(score) + F.lit(0.0)).alias(score))
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(item).asc())
    whole, most = Window.partitionBy(group), max(1, spare) * n
    head = rows.withColumn("_row", F.row_number().over(w)).where(F.col("_row") <= most)
    items = head.groupBy(group, item).agg(F.max(score).alias(score), F.max("_row").alias("_row"))
    ranked = (
        items.withColumn("rank", F.row_number().over(w))
        .withColumn("_items", F.count("*").over(whole))
        .withColumn("_rows", F.max("_row").over(whole))
    )
    set_of = F.pmod(F.xxhash64(group), F.lit(SETS))
    unanswered = (F.col("_rows") == most) & (F.col("_items") < n)
    # at most SETS numbers; mostly none, and then no row goes the long way
    sets = ranked.where(unanswered).agg(F.collect_set(set_of)).scalar()
    # `_rows` keeps this filter above the shuffle, which the query for `sets` shares
    near = ranked.where((F.col("rank") <= n) & ~F.array_contains(sets, F.when(F.col("_rows") > 0, set_of)))
    best = rows.where(F.array_contains(sets, set_of)).groupBy(group, item).agg(F.max(score).alias(score))
    far = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return near.select(group, item, score, "rank").unionByName(far)

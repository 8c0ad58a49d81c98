"""The current version of every keyed row of a feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SECTION_KEY = ("file_path", "heading", "chunk_index")


def current_versions(
    feed: DataFrame,
    columns: Sequence[str] = ("hash",),
    key: Sequence[str] = SECTION_KEY,
    version: str = "committed_at",
    delivered: str = "seen_at",
) -> DataFrame:
    """One row per key: that with the latest `version`, whenever it was delivered.

    Returns key and `columns`; other columns of the feed, whatever their names, are pruned at the scan.
    Ties on `version` go to the latest `delivered`, then to the greatest hash of the wanted columns, so that
    equal input gives equal output; rows repeated identically count once. A null version is older than any
    other. Null key parts are values like others. An empty feed gives an empty result.

    The rank filter becomes a group limit before the shuffle, so a key with very many versions sends one row
    per partition.
    """
    keep = list(dict.fromkeys([*key, *columns]))
    order = [F.col(version).desc_nulls_last(), F.col(delivered).desc_nulls_last(), F.xxhash64(*columns).desc()]
    w = Window.partitionBy(*key).orderBy(*order)
    return (
        feed.select(*dict.fromkeys([*keep, version, delivered]))
        .withColumn("_rank", F.row_number().over(w))
        .where(F.col("_rank") == 1)
        .select(*keep)
    )

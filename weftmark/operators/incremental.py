"""Reuse of the previous result by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("doc_file", "heading", "chunk_index")


def last_per_key(cached: DataFrame, order: str | None = None) -> DataFrame:
    """The cached row of each key that was written last (`order`), else that with the greatest content."""
    by = [F.col(order).desc_nulls_last()] if order else []
    w = Window.partitionBy(*KEY).orderBy(*by, F.col("hash").desc_nulls_last(), F.col("files").desc_nulls_last())
    return cached.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def detect_changes(chunks: DataFrame, cached: DataFrame, skip_cache: bool = False, order: str | None = None) -> DataFrame:
    """`chunks` with `unchanged` and the cached `files`.

    A chunk is unchanged if its key is cached with the same hash, where two null hashes are the same. With
    `skip_cache` all are changed. Cached keys that are no longer there vanish.
    """
    if skip_cache:
        return chunks.withColumn("unchanged", F.lit(False)).withColumn("files", F.array().cast("array<string>"))
    old = last_per_key(cached, order).select(
        *[F.col(k).alias(f"_{k}") for k in KEY], F.col("hash").alias("_hash"), F.col("files").alias("files"), F.lit(True).alias("_there")
    )
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
    joined = chunks.drop("files").join(old, on, "left")
    same = F.coalesce("_there", F.lit(False)) & F.col("hash").eqNullSafe(F.col("_hash"))
    files = F.when(same, F.coalesce("files", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return joined.withColumn("unchanged", same).withColumn("files", files).drop(*[f"_{k}" for k in KEY], "_hash", "_there")


def resolve_from_cache(detected: DataFrame) -> DataFrame:
    """All sections with the files that are cached for them, for the run in which nothing changed."""
    return detected.select(*KEY, "hash", "files", "unchanged")


def merge_unchanged(detected: DataFrame) -> DataFrame:
    """Results of unchanged chunks: their cached files, a TRUE verdict for each, and no scores."""
    verdicts = F.transform("files", lambda f: F.struct(F.concat(F.lit("file:"), f).alias("target_id"), F.lit(True).alias("is_match")))
    return detected.where("unchanged").select(
        *KEY, "hash", "files", verdicts.alias("classifications"), F.create_map().cast("map<string,double>").alias("scores")
    )

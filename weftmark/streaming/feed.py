"""A feed of section versions as a stream: the current version of each key, kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from weftmark.operators.versions import SECTION_KEY, current_versions


def read_feed(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def upsert_current(spark: SparkSession, target: str, columns: tuple[str, ...]) -> Callable[[DataFrame, int], None]:
    """A batch function that merges new versions into a table, generation by generation.

    A generation is a complete table named by its batch, so a batch that runs again after a failure writes
    the same generation from the one before it, and readers never see a part.
    """
    fields = tuple(dict.fromkeys([*SECTION_KEY, *columns, "committed_at", "seen_at"]))

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.select(*fields)
        if number > 0:
            new = spark.read.parquet(f"{target}/generation={number - 1}").select(*fields).unionByName(new)
        current_versions(new, fields).write.mode("overwrite").parquet(f"{target}/generation={number}")

    return merge


def maintain_current(feed: DataFrame, target: str, checkpoint: str, columns: tuple[str, ...] = ("hash",)) -> StreamingQuery:
    """Runs through what has arrived and stops; late and repeated deliveries change nothing that is newer."""
    spark = feed.sparkSession
    writer = feed.writeStream.foreachBatch(upsert_current(spark, target.rstrip("/"), columns))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

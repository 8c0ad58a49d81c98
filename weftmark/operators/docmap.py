"""The stored result: which files each section chunk is linked to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftmark.operators.incremental import KEY

_FILES = "array<string>"

#: Layout of the stored JSON.
SCHEMA = (
    "codebase_sha string, mappings array<struct<doc_file:string, sections:array<struct<"
    "heading:string, chunk_index:int, hash:string, files:array<string>>>>>"
)


def matched_files(classifications: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """(key, files) of the pairs judged TRUE, in byte order, without the `file:` prefix of their ids."""
    name = F.regexp_replace("target_id", "^file:", "")
    return (
        classifications.where("is_match")
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(name)).alias("files"))
    )


def attach_files(sections: DataFrame, files: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """All sections with their files; a section without a result has none."""
    return sections.drop("files").join(files.select(*key, "files"), list(key), "left").withColumn(
        "files", F.coalesce("files", F.array().cast(_FILES))
    )


def fill_missing(candidates: DataFrame, results: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Every candidate key with its files; a key whose judge gave none or failed has an empty list."""
    return attach_files(candidates.select(*key).distinct(), results, key)


def build(sections: DataFrame) -> DataFrame:
    """One row per document: (doc_file, sections), the sections in order of heading and chunk, files in order."""
    one = F.struct("heading", "chunk_index", "hash", F.array_sort(F.coalesce("files", F.array().cast(_FILES))).alias("files"))
    return sections.groupBy("doc_file").agg(F.array_sort(F.collect_list(one)).alias("sections"))


def flatten(mappings: DataFrame) -> DataFrame:
    """(doc_file, heading, chunk_index, hash, files) of rows (doc_file, sections)."""
    return mappings.select("doc_file", F.explode("sections").alias("s")).select("doc_file", "s.*")


def links(rows: DataFrame) -> DataFrame:
    """The edge list (doc_file, heading, chunk_index, file_path)."""
    return rows.select(*KEY, F.explode("files").alias("file_path"))


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(rows, codebase_sha) of a stored map. Missing hash is null, missing files are none, missing chunk is 0.

    Broken JSON raises when the rows are used.
    """
    whole = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    sha = whole.select(F.coalesce("codebase_sha", F.lit(""))).first()
    rows = flatten(whole.select(F.explode("mappings").alias("m")).select("m.*"))
    return (
        rows.withColumn("chunk_index", F.coalesce("chunk_index", F.lit(0))).withColumn("files", F.coalesce("files", F.array().cast(_FILES))),
        sha[0] if sha else "",
    )


def first_chunk(rows: DataFrame) -> DataFrame:
    """Of every (doc_file, heading) the row with the least chunk index."""
    w = Window.partitionBy("doc_file", "heading").orderBy("chunk_index")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def rename_files(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """`rows` with renamed files under their new names, in place and without removing repeats.

    `renames(old_path, path)` is joined on the exploded links and the lists are put together again by position,
    so neither table has to be small. Of two new names the least counts.
    """
    new = renames.groupBy("old_path").agg(F.min("path").alias("_new"))
    flat = rows.select(*KEY, F.posexplode("files").alias("_pos", "_file")).join(new, F.col("_file") == F.col("old_path"), "left")
    again = flat.groupBy(*KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_new", "_file").alias("f")))), lambda s: s["f"]).alias("_files")
    )
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in KEY]
    joined = rows.alias("l").join(again.alias("r"), same, "left")
    keep = [F.col(f"l.{c}") for c in rows.columns if c != "files"]
    return joined.select(*keep, F.coalesce("r._files", "l.files").alias("files"))


def remove_files(rows: DataFrame, removed: DataFrame, all_chunks: bool = False) -> DataFrame:
    """`rows` without the files of `removed(doc_file, heading, path)`.

    Only the first chunk of a section loses them, or with `all_chunks` every chunk.
    """
    gone = removed.groupBy("doc_file", "heading").agg(F.collect_set("path").alias("_gone"))
    w = Window.partitionBy("doc_file", "heading").orderBy("chunk_index")
    ranked = rows.withColumn("_r", F.row_number().over(w)).join(gone, ["doc_file", "heading"], "left")
    hit = F.col("_gone").isNotNull() & (F.lit(all_chunks) | (F.col("_r") == 1))
    left = F.when(hit, F.filter("files", lambda f: ~F.array_contains(F.col("_gone"), f))).otherwise(F.col("files"))
    return ranked.withColumn("files", left).select(*rows.columns)


def refresh_hashes(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """`rows` with the hashes of the sections as they are now, in all chunks of a section."""
    new = sections.groupBy("doc_file", "heading").agg(F.min_by("hash", "chunk_index").alias("_hash"))
    return rows.join(new, ["doc_file", "heading"], "left").withColumn("hash", F.coalesce("_hash", "hash")).select(*rows.columns)


def report(rows: DataFrame) -> DataFrame:
    """One row: sections, documents, links and sections without a link."""
    return rows.agg(
        F.count("*").alias("total_sections"),
        F.countDistinct("doc_file").alias("doc_files"),
        F.coalesce(F.sum(F.size("files")), F.lit(0)).alias("total_links"),
        F.count_if(F.size("files") == 0).alias("unlinked"),
    )

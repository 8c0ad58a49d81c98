"""What changed between two snapshots of the code, and which sections that makes stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmark.session import stored


def parse_name_status(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, change_type, old_path) of tab-separated name-status lines.

    D, M and R are kept; other letters, blank lines and lines without a path give no row.
    """
    p = F.split(column, "\t")
    letter, n = F.substring(p[0], 1, 1), F.size(p)
    kind = F.when(letter == "D", "deleted").when(letter == "M", "modified").when((letter == "R") & (n >= 3), "renamed")
    rows = lines.where(n >= 2).select(
        F.when(letter == "R", F.try_element_at(p, F.lit(3))).otherwise(F.try_element_at(p, F.lit(2))).alias("path"),
        kind.alias("change_type"),
        F.when(letter == "R", F.try_element_at(p, F.lit(2))).alias("old_path"),
    )
    return rows.where(F.col("change_type").isNotNull() & F.col("path").isNotNull())


def snapshot_diff(base: DataFrame, head: DataFrame, renames: bool = True, similar: float | None = None) -> DataFrame:
    """(path, change_type, old_path) between two tables (file_path, content).

    Contents are compared by hash, so only hashes are shuffled. A path that is gone and whose content is
    found under new paths is renamed to each of them; of several gone paths with one content the least is
    the old one, and the others are deleted. Added files give no row. With `similar`, paths that are still gone and
    new are compared by `similar_renames`, so that a file which was renamed and edited is renamed too.
    """
    b = base.select(F.col("file_path").alias("_b"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("_bh"))
    h = head.select(F.col("file_path").alias("_h"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("_hh"))
    both = b.join(h, F.col("_b") == F.col("_h"), "full_outer")
    none = F.lit(None).cast("string")
    modified = both.where(F.col("_b").isNotNull() & F.col("_h").isNotNull() & (F.col("_bh") != F.col("_hh"))).select(
        F.col("_b").alias("path"), F.lit("modified").alias("change_type"), none.alias("old_path")
    )
    gone = both.where(F.col("_h").isNull()).select("_b", "_bh")
    if not renames:
        return modified.unionByName(gone.select(F.col("_b").alias("path"), F.lit("deleted").alias("change_type"), none.alias("old_path")))
    new = both.where(F.col("_b").isNull()).select(F.col("_h"), F.col("_hh"))
    oldest = gone.groupBy("_bh").agg(F.min("_b").alias("_old"))
    renamed = new.join(oldest, F.col("_hh") == F.col("_bh")).select(
        F.col("_h").alias("path"), F.lit("renamed").alias("change_type"), F.col("_old").alias("old_path")
    )
    if similar is not None:
        used = renamed.select(F.col("path").alias("_p"), F.col("old_path").alias("_o"))
        left = base.join(gone.select(F.col("_b").alias("file_path")), "file_path", "left_semi").join(used.select(F.col("_o").alias("file_path")), "file_path", "left_anti")
        fresh = head.join(new.select(F.col("_h").alias("file_path")), "file_path", "left_semi").join(used.select(F.col("_p").alias("file_path")), "file_path", "left_anti")
        edited = similar_renames(left, fresh, similar)
        renamed = renamed.unionByName(edited.select("path", F.lit("renamed").alias("change_type"), "old_path"))
    deleted = gone.join(renamed.select("old_path").distinct(), F.col("_b") == F.col("old_path"), "left_anti").select(
        F.col("_b").alias("path"), F.lit("deleted").alias("change_type"), none.alias("old_path")
    )
    return modified.unionByName(renamed).unionByName(deleted)


def shingles(content: Column, words: int = 5) -> Column:
    """The distinct runs of `words` words of a text, hashed; a shorter text is one run, a blank one none."""
    w = F.filter(F.split(content, r"\s+"), lambda x: x != "")
    n = F.greatest(F.size(w) - (words - 1), F.lit(1))
    # shifted copies side by side, each split once; a lambda would split the text for each run
    beside = F.arrays_zip(*[F.slice(w, F.lit(i + 1), F.greatest(F.size(w) - i, F.lit(0))).alias(f"w{i}") for i in range(words)])
    runs = F.transform(F.slice(beside, F.lit(1), n), lambda r: F.xxhash64(F.concat_ws(" ", *[r[f"w{i}"] for i in range(words)])))
    return F.when(F.size(w) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def similar_renames(gone: DataFrame, new: DataFrame, least: float = 0.8, words: int = 5) -> DataFrame:
    """(path, old_path, similarity): for each of `new(file_path, content)` the most similar of `gone`, if similar enough.

    Similarity is that of the sets of runs of `words` words (Jaccard), ties go to the least old path; null and blank
    contents resemble nothing. Candidates share one of the rarest runs of either: of a set of n, at most
    n - ceil(least * n) + 1 runs have to be looked up for no similar pair to be lost, and as they are the rarest, a
    run that many files hold is looked up by few of them.
    """

    def sets(df: DataFrame, side: str) -> DataFrame:
        s = df.select(F.col("file_path").alias(side), shingles(F.col("content"), words).alias(f"{side}_set"))
        return s.where(F.size(f"{side}_set") > 0).withColumn(f"{side}_n", F.size(f"{side}_set"))

    a, b = stored(sets(gone, "old")), stored(sets(new, "new"))  # read three times each
    flat = a.select(F.lit("old").alias("side"), F.col("old").alias("name"), F.col("old_n").alias("n"), F.explode("old_set").alias("run")).unionByName(
        b.select(F.lit("new").alias("side"), F.col("new").alias("name"), F.col("new_n").alias("n"), F.explode("new_set").alias("run"))
    )
    often = flat.groupBy("run").agg(F.count("*").alias("often"))
    w = Window.partitionBy("side", "name").orderBy("often", "run")
    rare = flat.join(often, "run").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1)
    left = rare.where("side = 'old'").select("run", F.col("name").alias("old"), F.col("n").alias("old_n"))
    right = rare.where("side = 'new'").select("run", F.col("name").alias("new"), F.col("n").alias("new_n"))
    near = (F.col("old_n") >= F.lit(least) * F.col("new_n")) & (F.col("new_n") >= F.lit(least) * F.col("old_n"))
    pairs = left.join(right, "run").where(near).select("old", "new").distinct()
    both = pairs.join(a, "old").join(b, "new").withColumn("_shared", F.size(F.array_intersect("old_set", "new_set")))
    found = both.select("new", "old", (F.col("_shared") / (F.col("old_n") + F.col("new_n") - F.col("_shared"))).alias("similarity")).where(F.col("similarity") >= least)
    best = Window.partitionBy("new").orderBy(F.col("similarity").desc(), "old")
    return found.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(F.col("new").alias("path"), F.col("old").alias("old_path"), "similarity")


def stale_sections(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """(doc_file, heading, chunk_index, changed_files) of every chunk linked to a path of `changed(path)`."""
    flat = rows.select("doc_file", "heading", "chunk_index", F.explode("files").alias("_file"))
    hits = flat.join(changed.select(F.col("path").alias("_file")).distinct(), "_file", "left_semi")
    return hits.groupBy("doc_file", "heading", "chunk_index").agg(F.array_sort(F.collect_set("_file")).alias("changed_files"))


def section_changes(rows: DataFrame, changes: DataFrame, distinct: bool = False) -> DataFrame:
    """(doc_file, heading, path, change_type, old_path): each change once for every chunk linked to its path.

    A renamed file is looked up under both names, and counts once for a chunk. With `distinct`, once for a
    section.
    """
    flat = rows.select("doc_file", "heading", "chunk_index", F.explode("files").alias("_file"))
    names = changes.select(
        "path", "change_type", "old_path",
        F.explode(F.when((F.col("change_type") == "renamed") & F.col("old_path").isNotNull(), F.array("path", "old_path")).otherwise(F.array("path"))).alias("_file"),
    )
    hits = flat.join(names, "_file").select("doc_file", "heading", "chunk_index", "path", "change_type", "old_path").distinct()
    hits = hits.drop("chunk_index")
    return hits.distinct() if distinct else hits


def section_groups(hits: DataFrame) -> DataFrame:
    """(doc_file, heading, changes) with the changes of a section in order, repeats kept."""
    one = F.struct("path", "change_type", "old_path")
    return hits.groupBy("doc_file", "heading").agg(F.array_sort(F.collect_list(one)).alias("changes"))

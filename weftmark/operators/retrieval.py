"""Scores of sections against files, and the cutoff that leaves candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmark.functions.text import basename


def tokens(text: Column, n: int = 1) -> Column:
    """Distinct lower-case words between single spaces, or runs of `n` of them."""
    words = F.filter(F.split(F.lower(text), " "), lambda w: w != "")
    runs = words
    for i in range(1, n):  # shifted copies side by side: each word list is made once, not once per run
        shifted = F.slice(words, i + 1, F.greatest(F.size(words), F.lit(0)))
        runs = F.zip_with(runs, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
    words = F.filter(runs, lambda r: r.isNotNull()) if n > 1 else words
    return F.array_distinct(words)


def lexical_scores(queries: DataFrame, files: DataFrame, query_id: str, file_id: str, text: str = "text", n: int = 1) -> DataFrame:
    """Which share of a query's tokens a file holds, for all pairs that share one.

    An equi-join on tokens instead of all pairs: with a floor above 0, pairs that share nothing can't be
    candidates. Equal texts are scored once: tokens are joined per distinct file text and the scores brought
    to the files after. A token of a query that most files hold is split by AQE's skew join.
    """
    q = queries.where(F.col(text).isNotNull()).select(F.col(query_id), tokens(F.col(text), n).alias("_t"))
    q = q.withColumn("_n", F.size("_t")).where("_n > 0").select(query_id, "_n", F.explode("_t").alias("_token"))
    named = files.where(F.col(text).isNotNull()).select(F.col(file_id), F.sha2(text, 256).alias("_text"), F.col(text).alias("_body"))
    once = named.groupBy("_text").agg(F.min("_body").alias("_body"))
    f = once.select("_text", F.explode(tokens(F.col("_body"), n)).alias("_token"))
    hits = q.join(f, "_token").groupBy(query_id, "_text", "_n").agg(F.count("*").alias("_hits"))
    scored = hits.select(query_id, "_text", (F.col("_hits").cast("double") / F.col("_n").cast("double")).alias("score"))
    return scored.join(named.select(file_id, "_text"), "_text").select(query_id, file_id, "score")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, in double precision; null where one has no length."""

    def dot(x: Column, y: Column) -> Column:
        both = F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double"))
        return F.aggregate(both, F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def floor_and_gap(scores: DataFrame, key: Sequence[str], file: str, floor: float = 0.5, gap: float = 0.15) -> DataFrame:
    """The best files of each key: scores of at least `floor`, best first, up to the first drop of more than `gap`.

    A null score is 0. Equal scores are ordered by file. Arithmetic is that of doubles.
    """
    w = Window.partitionBy(*key).orderBy(F.col("score").desc(), F.col(file).asc())
    drop = F.coalesce(F.lag("score").over(w) - F.col("score") > F.lit(float(gap)), F.lit(False)).cast("int")
    return (
        scores.withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0)))
        .where(F.col("score") >= F.lit(float(floor)))
        .withColumn("_drop", drop)
        .withColumn("_drops", F.sum("_drop").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("rank", F.row_number().over(w))
        .where("_drops = 0")
        .drop("_drop", "_drops")
    )


def candidates(
    files: DataFrame, scores: DataFrame, key: Sequence[str], file: str = "file_path",
    floor: float = 0.5, gap: float = 0.15, failed: DataFrame | None = None,
) -> DataFrame:
    """(key, file, fallback) pairs to be judged, without rank.

    A section whose scores are all below the floor has none, as has one without any score: with a scorer that
    leaves out pairs of score 0 it is one that shares nothing with any file. Only keys of `failed`, those the
    scorer gave up on, are paired with every file; they are the exception, and `fallback` tells them.
    """
    kept = floor_and_gap(scores, key, file, floor, gap).select(*key, file).withColumn("fallback", F.lit(False))
    kept = kept.join(files.select(file).distinct(), file, "left_semi").select(*key, file, "fallback")
    if failed is None:
        return kept
    every = failed.select(*key).distinct().join(files.select(file).distinct(), F.lit(True))
    return kept.unionByName(every.select(*key, file, F.lit(True).alias("fallback")))


def request_batches(pairs: DataFrame, key: Sequence[str], file: str, size: int = 1000) -> DataFrame:
    """`pairs` with the number of the scoring request each belongs to: `size` files in a request."""
    w = Window.partitionBy(*key).orderBy(file)
    return pairs.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))


def rerank_query(heading: Column, doc_file: Column, content: Column) -> Column:
    """The text that a scoring model gets for a section. Its wording and layout are fixed values."""
    head = F.concat(F.lit("Search for code implementing: "), heading, F.lit(" (in "), basename(doc_file), F.lit(")"))
    return F.when(F.coalesce(content, F.lit("")) == "", head).otherwise(F.concat(head, F.lit("\n\nContext:\n"), content))


def rerank_document(file: Column, signatures: Column, variables: Column, max_signatures: int = 100, max_variables: int = 30) -> Column:
    """The text that a scoring model gets for a file. Its layout is a fixed value."""

    def block(title: str, items: Column, n: int) -> Column:
        some = F.slice(F.coalesce(items, F.array().cast("array<string>")), 1, n)
        listed = F.array_join(F.transform(some, lambda s: F.concat(F.lit("- "), s)), "\n")
        return F.when(F.size(some) > 0, F.concat(F.lit(f"{title}:\n"), listed))

    return F.concat_ws(
        "\n\n", F.concat(F.lit("File: "), file), block("Signatures", signatures, max_signatures), block("Variables", variables, max_variables)
    )


def signature_map(symbols: DataFrame, order: Sequence[str]) -> DataFrame:
    """(file_path, signatures): per file, in `order`, each signature with the first two non-blank body lines.

    The body is the code after the signature, where the code begins with it. Symbols without signature are
    left out.
    """
    code = F.regexp_replace(F.col("code"), r"(?U)^\s+|\s+$", "")
    body = F.when(F.startswith(code, F.col("signature")), F.substring(code, F.length("signature") + 1, F.length(code)))
    lines = F.slice(F.filter(F.split(F.coalesce(body, F.lit("")), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?U)\s+", "") != ""), 1, 2)
    # the body is stripped before it is cut into lines: its first line loses its indent
    lines = F.transform(lines, lambda x, i: F.when(i == 0, F.regexp_replace(x, r"(?U)^\s+", "")).otherwise(x))
    entry = F.concat_ws("\n", F.col("signature"), lines)
    rows = symbols.where(F.coalesce("signature", F.lit("")) != "").withColumn("_entry", entry)
    return rows.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct(*order, "_entry"))).alias("_s")).select(
        "file_path", F.transform("_s", lambda s: s["_entry"]).alias("signatures")
    )


def collected_signatures(symbols: DataFrame) -> DataFrame:
    """`symbols` that say something: signature, else name; `body_sample` only where there is code."""
    sig, code = F.coalesce("signature", F.lit("")), F.coalesce("code", F.lit(""))
    return symbols.where((sig != "") | (code != "")).select(
        "file_path", "name", F.when(sig != "", sig).otherwise(F.col("name")).alias("signature"), F.when(code != "", code).alias("body_sample")
    )

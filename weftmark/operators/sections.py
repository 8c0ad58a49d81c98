"""Documents to hashed section chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmark.functions.markdown import parse_headings, replace_section, split_sections
from weftmark.functions.text import section_hash, strip

SECTIONS = "doc_file string, ordinal int, heading string, content string, line_start int, line_end int"
HEADINGS = "doc_file string, ordinal int, level int, text string, line_start int, line_end int"

#: Counts the tokens of a text, as a column.
TokenCount = Callable[[Column], Column]


def estimate_tokens(text: Column) -> Column:
    """A token for every four bytes, rounded up: no vocabulary needed. A byte-level token covers a byte at least."""
    return F.ceil(F.octet_length(text) / 4)


def count_words(text: Column) -> Column:
    """Words between single spaces; a counter that SQL can repeat."""
    return F.size(F.split(text, " "))


def headings(docs: DataFrame) -> DataFrame:
    """One row per heading of `docs(doc_file, text)`; a null text has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (f, n, *h) for f, t in pdf.itertuples(index=False, name=None) if t for n, h in enumerate(parse_headings(t))
            ]
            yield pd.DataFrame(rows, columns=["doc_file", "ordinal", "level", "text", "line_start", "line_end"])

    return docs.select("doc_file", "text").mapInPandas(run, HEADINGS)


def sections(docs: DataFrame) -> DataFrame:
    """One row per section of `docs(doc_file, text)`, in order; the text before the first heading is in none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (f, n, h, body, ls, e)
                for f, t in pdf.itertuples(index=False, name=None)
                if t
                for n, h, body, ls, _, e in split_sections(t)
            ]
            yield pd.DataFrame(rows, columns=["doc_file", "ordinal", "heading", "content", "line_start", "line_end"])

    return docs.select("doc_file", "text").mapInPandas(run, SECTIONS)


def paragraphs(content: Column) -> Column:
    """The non-blank paragraphs of a text, each without white space around it."""
    return F.filter(F.transform(F.split(strip(content), r"\n\s*\n"), strip), lambda p: p != "")


def _fold(parts: Column, limit: int, size: Callable[[Column], Column], extra: int, joint: str) -> Column:
    """Fills strings with `parts`, in order: one is closed when the next part would exceed `limit`."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).cast("bigint").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        n = size(x).cast("bigint")
        full = acc["open"].isNotNull() & (acc["n"] + n > limit)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | acc["open"].isNull(), x).otherwise(F.concat(acc["open"], F.lit(joint), x)).alias("open"),
            (F.when(full, F.lit(0)).otherwise(acc["n"]) + n + extra).alias("n"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    return F.aggregate(parts, start, step, finish)


def pack_sentences(paragraph: Column, max_tokens: int, tokens: TokenCount = estimate_tokens) -> Column:
    """A paragraph over `max_tokens` as runs of whole sentences within it; a longer sentence stays whole."""
    packed = _fold(F.split(paragraph, r"(?<=[.!?])\s+"), max_tokens, tokens, 0, " ")
    return F.when(tokens(paragraph) <= max_tokens, F.array(paragraph)).otherwise(packed)


def merge_paragraphs(
    parts: Column, max_length: int = 2000, max_tokens: int = 8000, tokens: TokenCount = estimate_tokens
) -> Column:
    """Paragraphs joined by blank lines into chunks of about `max_length` characters."""
    split = F.flatten(F.transform(parts, lambda p: pack_sentences(p, max_tokens, tokens)))
    return _fold(split, max_length, F.length, 2, "\n\n")


def chunks(
    secs: DataFrame, max_length: int = 2000, max_tokens: int = 8000, tokens: TokenCount = estimate_tokens
) -> DataFrame:
    """Chunks (doc_file, heading, chunk_index, hash, content) of sections.

    The hash is the section's, so all its chunks change together. An empty section has its heading as content,
    and none if that is empty too. Chunks of a repeated heading are numbered on within the document.
    """
    parts = paragraphs(F.coalesce("content", F.lit("")))
    made = F.when(F.size(parts) > 0, merge_paragraphs(parts, max_length, max_tokens, tokens)).when(
        F.col("heading") != "", F.array("heading")
    )
    w = Window.partitionBy("doc_file", "heading").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return (
        secs.withColumn("hash", section_hash(F.col("heading"), F.coalesce("content", F.lit(""))))
        .withColumn("_chunks", made)
        .where(F.col("_chunks").isNotNull())
        .withColumn("_before", F.coalesce(F.sum(F.size("_chunks")).over(w), F.lit(0)))
        .select("doc_file", "ordinal", "heading", "hash", "_before", F.posexplode("_chunks").alias("_pos", "content"))
        .select(
            "doc_file", "heading", (F.col("_before") + F.col("_pos")).cast("int").alias("chunk_index"), "hash", "content"
        )
    )


def point_lookup(secs: DataFrame, heading: str) -> DataFrame:
    """(doc_file, content) of the first section with this heading in every document that has one."""
    return (
        secs.where(F.col("heading") == heading).groupBy("doc_file").agg(F.min_by("content", "ordinal").alias("content"))
    )


def splice(docs: DataFrame, bodies: DataFrame) -> DataFrame:
    """`docs(doc_file, text)` with the bodies of `bodies(doc_file, heading, body)` put in, in order of heading.

    Bodies are grouped per document first; one document's bodies are a bounded group. Documents without a
    body keep their text.
    """
    grouped = bodies.groupBy("doc_file").agg(F.array_sort(F.collect_list(F.struct("heading", "body"))).alias("_bodies"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, text, new in pdf.itertuples(index=False, name=None):
                for b in new if new is not None else ():
                    if text is not None and b["body"] is not None:
                        text = replace_section(text, b["heading"], b["body"])
                out.append((name, text))
            yield pd.DataFrame(out, columns=["doc_file", "text"])

    return docs.select("doc_file", "text").join(grouped, "doc_file", "left").mapInPandas(run, "doc_file string, text string")


def preprocess_stats(chunk_rows: DataFrame, files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """One row: sections, documents, files and symbols counted. An empty path is no document."""
    a = chunk_rows.agg(F.count("*").alias("sections"), F.countDistinct(F.when(F.col("doc_file") != "", F.col("doc_file"))).alias("docs"))
    b = files.agg(F.countDistinct("file_path").alias("files"))
    c = symbols.agg(F.count("*").alias("symbols")) if symbols is not None else None
    # each side is one row
    one = a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k")
    if c is not None:
        one = one.join(c.withColumn("_k", F.lit(1)), "_k")
    return one.drop("_k")

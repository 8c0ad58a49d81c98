"""Queries of the operators for training data, with SQL where SQL can express them."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark.llm.abuse import THRESHOLD, abuse_rates, score_abuse
from weftmark.llm.handwritten import score_files
from weftmark.llm.leakage import find_leaks
from weftmark.llm.packing import fill_containers
from weftmark.llm.splitting import split_oversized
from weftmark.llm.tokens import TOKENIZERS, VOCABULARY, encode_texts
from weftmark.session import table

_CURRENT = """SELECT file_path, heading, chunk_index, content FROM sections
  QUALIFY row_number() OVER (PARTITION BY file_path, heading, chunk_index
    ORDER BY committed_at DESC NULLS LAST, seen_at DESC NULLS LAST) = 1"""


def p1_containers(spark: SparkSession, base: str) -> DataFrame:
    return fill_containers(table(spark, base, "sections"))


def p1_keys(spark: SparkSession, base: str) -> DataFrame:
    """Every key with the characters of it that are in containers: SQL knows how many there must be."""
    items = fill_containers(table(spark, base, "sections")).select(F.explode("items").alias("i")).select("i.*")
    return items.groupBy("file_path", "heading", "chunk_index").agg(
        F.count("*").alias("pieces"), F.sum(F.length("content")).alias("chars")
    )


def p3_pieces(spark: SparkSession, base: str) -> DataFrame:
    return split_oversized(table(spark, base, "sections"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    pieces = split_oversized(table(spark, base, "sections"))
    return pieces.where(F.col("piece") == 0).select("file_path", "heading", "chunk_index")


def p3_texts(spark: SparkSession, base: str) -> DataFrame:
    """What the pieces of a key make up without their overlaps: SQL knows the content."""
    bare = F.expr("substring(text, overlap + 1)")
    one = F.struct("piece", bare.alias("t"), F.length("text").alias("n"), "overlap")
    rows = split_oversized(table(spark, base, "sections")).groupBy("file_path", "heading", "chunk_index").agg(F.array_sort(F.collect_list(one)).alias("r"))
    within = F.forall("r", lambda r: (r["n"] <= 2000) & (r["overlap"] <= 200))
    return rows.select("file_path", "heading", "chunk_index", F.md5(F.array_join(F.transform("r", lambda r: r["t"]), "")).alias("text"), within.alias("within"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    scored, _ = score_files(table(spark, base, "code_elements"))
    return scored.where(F.col("score") > 0).select("file_path")


def p4_scores(spark: SparkSession, base: str) -> DataFrame:
    return score_files(table(spark, base, "code_elements"))[0]


def p6_ids(spark: SparkSession, base: str) -> DataFrame:
    return encode_texts(table(spark, base, "documents"))


def p6_texts(spark: SparkSession, base: str) -> DataFrame:
    """The texts that the ids of all documents stand for: SQL knows them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(f"{TOKENIZERS}/{VOCABULARY}", "rb") as f:
            words = {int(rank): base64.b64decode(word) for word, rank in map(bytes.split, f)}
        for pdf in batches:
            pdf["text"] = [b"".join(words[i] for i in ids).decode("utf-8") for ids in pdf.pop("ids")]
            yield pdf

    texts = encode_texts(table(spark, base, "documents")).mapInPandas(run, "doc_id bigint, text string")
    return texts.select("doc_id", F.md5("text").alias("text"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return find_leaks(table(spark, base, "documents"), table(spark, base, "benchmark")).select("doc_id", "item_id")


def p8_scores(spark: SparkSession, base: str) -> DataFrame:
    return score_abuse(table(spark, base, "documents"))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return p8_scores(spark, base).where(F.col("score") >= THRESHOLD).select("doc_id")


def p8_rates(spark: SparkSession, base: str) -> DataFrame:
    return abuse_rates(p8_scores(spark, base))


QUERIES = {
    "p1_containers": p1_containers,
    "p1_keys": p1_keys,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_texts": p3_texts,
    "p4_found": p4_found,
    "p4_scores": p4_scores,
    "p6_ids": p6_ids,
    "p6_texts": p6_texts,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_rates": p8_rates,
    "p8_scores": p8_scores,
}

ORACLE = {
    "p1_keys": f"""WITH cur AS ({_CURRENT})
SELECT file_path, heading, chunk_index, CAST(ceil(length(content) / 2000.0) AS BIGINT) AS pieces,
  length(content) AS chars FROM cur WHERE regexp_matches(content, '[^\\s]')""",
    "p3_found": f"""WITH cur AS ({_CURRENT})
SELECT file_path, heading, chunk_index FROM cur WHERE length(content) > 2000""",
    "p6_texts": "SELECT doc_id, md5(coalesce(text, '')) AS text FROM documents",
    "p3_texts": f"""WITH cur AS ({_CURRENT})
SELECT file_path, heading, chunk_index, md5(content) AS text, TRUE AS within FROM cur WHERE length(content) > 2000""",
}

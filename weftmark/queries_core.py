"""Queries of the core operators for incremental processing and top-N, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftmark.operators.ledger import stale_keys
from weftmark.operators.topn import top_n
from weftmark.session import table


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return stale_keys(*(table(spark, base, t) for t in ("sections", "doc_map", "analysis_runs")))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return top_n(table(spark, base, "candidate_results"), 5).select("key", "file")


QUERIES = {"p2_found": p2_found, "p5_found": p5_found}

ORACLE = {
    "p2_found": r"""
WITH norm AS (SELECT file_path, heading, chunk_index, committed_at, seen_at,
    nullif(regexp_replace(lower(trim(hash, chr(32) || chr(9) || chr(10) || chr(13))), '^sha-?256\s*[:=]\s*', ''), '') AS digest FROM sections),
cur AS (SELECT * FROM norm QUALIFY row_number() OVER (PARTITION BY file_path, heading, chunk_index
    ORDER BY committed_at DESC NULLS LAST, seen_at DESC NULLS LAST, digest DESC) = 1),
rec AS (SELECT m.doc_file, m.heading, m.chunk_index,
    nullif(regexp_replace(lower(trim(m.hash, chr(32) || chr(9) || chr(10) || chr(13))), '^sha-?256\s*[:=]\s*', ''), '') AS digest
  FROM doc_map m WHERE m.run_id IN (SELECT run_id FROM analysis_runs WHERE status = 'succeeded')
  QUALIFY row_number() OVER (PARTITION BY m.doc_file, m.heading, m.chunk_index
    ORDER BY m.run_id DESC, m.written_at DESC NULLS LAST) = 1)
SELECT c.file_path, c.heading, c.chunk_index FROM cur c LEFT JOIN rec r
  ON c.file_path IS NOT DISTINCT FROM r.doc_file AND c.heading IS NOT DISTINCT FROM r.heading
  AND c.chunk_index IS NOT DISTINCT FROM r.chunk_index
WHERE (c.digest = r.digest) IS NOT TRUE
""",
    "p5_found": """
WITH best AS (SELECT key, file, max(rerank_scores) AS s FROM candidate_results
  WHERE rerank_scores IS NOT NULL AND NOT isnan(rerank_scores) AND key IS NOT NULL AND file IS NOT NULL GROUP BY key, file)
SELECT key, file FROM best QUALIFY row_number() OVER (PARTITION BY key ORDER BY s DESC, file) <= 5
""",
}

"""The catalogue of core queries: one per group of operators, each with the SQL that gives the same rows.

Inputs are derived from the tables by expressions that both engines share. Markdown is made of the lines of
documents, whole, every fourth line a heading; the SQL knows the sections without parsing. Each operator on Markdown
has a second query over the texts of documents as they are, with default limits and without SQL, which can't parse
Markdown; likewise the lexical scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark.functions.text import digest
from weftmark.operators import changes as ch
from weftmark.operators import docmap
from weftmark.operators import ledger
from weftmark.operators import retrieval as rt
from weftmark.operators import rewriting as rw
from weftmark.operators import sections as sec
from weftmark.operators.incremental import KEY, detect_changes, merge_unchanged, resolve_from_cache
from weftmark.operators.symbols import extracted
from weftmark.operators.versions import current_versions
from weftmark.plans.providers import ThresholdJudge
from weftmark.sources.tree import by_folder
from weftmark.config import Config
from weftmark.session import table

# -- inputs


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\r\n|\r|\n"), lambda x: x.rlike("[^ \t]"))


def _markdown(spark: SparkSession, base: str) -> DataFrame:
    """Every line of every text, whole: each is a paragraph between two words of its own, every fourth a heading."""
    docs = table(spark, base, "documents").where("text IS NOT NULL")
    marked = F.transform(_lines(F.col("text")), lambda x, i: F.concat(F.when(i % 4 == 0, "## L ").otherwise("L "), x, F.lit(" .")))
    return docs.select(F.col("doc_id").cast("string").alias("doc_file"), F.array_join(marked, "\n\n").alias("text"))


_MD = """md AS (SELECT CAST(doc_id AS VARCHAR) AS doc_file, list_transform(list_filter(regexp_split_to_array(text, '\r\n|\r|\n'),
    lambda x: regexp_matches(x, '[^ \t]')), lambda x: 'L ' || x || ' .') AS ls FROM documents WHERE text IS NOT NULL),
  ln AS (SELECT doc_file, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM md),
  sec AS (SELECT doc_file, CAST(i // 4 AS INTEGER) AS ordinal, max(CASE WHEN i % 4 = 0 THEN line END) AS heading,
    coalesce(string_agg(CASE WHEN i % 4 <> 0 THEN line END, chr(10) || chr(10) ORDER BY i), '') AS content,
    coalesce(list(line ORDER BY i) FILTER (WHERE i % 4 <> 0), []) AS parts FROM ln GROUP BY ALL)"""


def _current(spark: SparkSession, base: str, *columns: str) -> DataFrame:
    return current_versions(table(spark, base, "sections"), columns).withColumnRenamed("file_path", "doc_file")


_CUR = """cur AS (SELECT file_path AS doc_file, heading, chunk_index, hash, content FROM sections
  QUALIFY row_number() OVER (PARTITION BY file_path, heading, chunk_index ORDER BY committed_at DESC NULLS LAST, seen_at DESC NULLS LAST) = 1)"""


def _cached(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "doc_map").select(*KEY, "hash", "files", "run_id")


_OLD = """old AS (SELECT doc_file, heading, chunk_index, hash, coalesce(files, []) AS files FROM doc_map
  QUALIFY row_number() OVER (PARTITION BY doc_file, heading, chunk_index ORDER BY run_id DESC NULLS LAST, hash DESC NULLS LAST, files DESC NULLS LAST) = 1)"""

_DETECTED = f"""{_CUR}, {_OLD}, det AS (SELECT c.doc_file, c.heading, c.chunk_index, c.hash,
    o.doc_file IS NOT NULL AND c.hash IS NOT DISTINCT FROM o.hash AS unchanged,
    CASE WHEN o.doc_file IS NOT NULL AND c.hash IS NOT DISTINCT FROM o.hash THEN o.files ELSE [] END AS files
  FROM cur c LEFT JOIN old o ON c.doc_file = o.doc_file AND c.heading = o.heading AND c.chunk_index = o.chunk_index)"""


def _detected(spark: SparkSession, base: str) -> DataFrame:
    return detect_changes(_current(spark, base, "hash"), _cached(spark, base), order="run_id")


def _scores(spark: SparkSession, base: str) -> DataFrame:
    got = table(spark, base, "candidate_results")
    good = got.where("rerank_scores IS NOT NULL AND NOT isnan(rerank_scores)")
    return good.groupBy("key", F.col("file").alias("file_path")).agg(F.max("rerank_scores").alias("score"))


_SCORES = """sc AS (SELECT key, file AS file_path, max(rerank_scores) AS score FROM candidate_results
  WHERE rerank_scores IS NOT NULL AND NOT isnan(rerank_scores) GROUP BY ALL)"""

_GAP = f"""{_SCORES}, fl AS (SELECT *, lag(score) OVER w - score > CAST(0.15 AS DOUBLE) AS brk, row_number() OVER w AS rank FROM sc
    WHERE score >= CAST(0.5 AS DOUBLE) WINDOW w AS (PARTITION BY key ORDER BY score DESC, file_path)),
  kept AS (SELECT key, file_path, score, rank FROM fl QUALIFY sum(CASE WHEN brk THEN 1 ELSE 0 END)
    OVER (PARTITION BY key ORDER BY score DESC, file_path ROWS UNBOUNDED PRECEDING) = 0)"""


def _files(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "code_elements").where("startswith(id, 'file:')")
    return rows.groupBy("file_path").agg(F.max("code").alias("content"))


_FILES = """fs AS (SELECT file_path, max(code) AS content FROM code_elements WHERE starts_with(id, 'file:') GROUP BY ALL)"""


def _snapshots(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    f, n = _files(spark, base), F.length("file_path") + F.length(F.coalesce("content", F.lit("")))
    head = f.where(n % 13 != 0).select(
        F.when(n % 17 == 0, F.concat(F.lit("moved/"), F.col("file_path"))).otherwise(F.col("file_path")).alias("file_path"),
        F.when(n % 7 == 0, F.concat(F.coalesce("content", F.lit("")), F.lit(" edited"))).otherwise(F.col("content")).alias("content"),
    )
    return f.where(n % 11 != 0), head


_CHANGES = f"""{_FILES}, num AS (SELECT *, length(file_path) + length(coalesce(content, '')) AS n FROM fs),
  b AS (SELECT file_path, sha256(coalesce(content, '')) AS h FROM num WHERE n % 11 <> 0),
  hd AS (SELECT CASE WHEN n % 17 = 0 THEN 'moved/' || file_path ELSE file_path END AS file_path,
    sha256(CASE WHEN n % 7 = 0 THEN coalesce(content, '') || ' edited' ELSE coalesce(content, '') END) AS h FROM num WHERE n % 13 <> 0),
  gone AS (SELECT * FROM b WHERE file_path NOT IN (SELECT file_path FROM hd)),
  oldest AS (SELECT h, min(file_path) AS old_path FROM gone GROUP BY h),
  ren AS (SELECT hd.file_path AS path, 'renamed' AS change_type, o.old_path FROM hd JOIN oldest o USING (h) WHERE hd.file_path NOT IN (SELECT file_path FROM b)),
  chg AS (SELECT b.file_path AS path, 'modified' AS change_type, CAST(NULL AS VARCHAR) AS old_path FROM b JOIN hd USING (file_path) WHERE b.h <> hd.h
    UNION ALL SELECT * FROM ren
    UNION ALL SELECT file_path, 'deleted', NULL FROM gone WHERE file_path NOT IN (SELECT old_path FROM ren))"""


def _changes(spark: SparkSession, base: str) -> DataFrame:
    return ch.snapshot_diff(*_snapshots(spark, base))


def _rows(spark: SparkSession, base: str) -> DataFrame:
    """The last stored row of each chunk."""
    from weftmark.operators.incremental import last_per_key

    return last_per_key(_cached(spark, base), "run_id").select(*KEY, "hash", F.coalesce("files", F.array().cast("array<string>")).alias("files"))


def _hits(spark: SparkSession, base: str) -> DataFrame:
    return ch.section_changes(_rows(spark, base), _changes(spark, base))


_HITS = f"""{_OLD}, {_CHANGES}, fl AS (SELECT DISTINCT doc_file, heading, chunk_index, unnest(files) AS f FROM old),
  nm AS (SELECT *, path AS f FROM chg UNION ALL SELECT *, old_path FROM chg WHERE change_type = 'renamed'),
  hits AS (SELECT doc_file, heading, path, change_type, old_path FROM (SELECT DISTINCT doc_file, heading, chunk_index, path, change_type, old_path
    FROM fl JOIN nm USING (f)))"""

_FOLD = """list_reduce({parts}, lambda acc, x: CASE WHEN acc.open IS NOT NULL AND acc.n + {size} > {limit}
    THEN {{'done': list_append(acc.done, acc.open), 'open': x.open, 'n': {size} + {extra}}}
    ELSE {{'done': acc.done, 'open': CASE WHEN acc.open IS NULL THEN x.open ELSE acc.open || {joint} || x.open END, 'n': acc.n + {size} + {extra}}} END,
    {{'done': CAST([] AS VARCHAR[]), 'open': CAST(NULL AS VARCHAR), 'n': CAST(0 AS BIGINT)}})"""


def _fold_sql(parts: str, size: str, limit: int, extra: int, joint: str) -> str:
    """A greedy fill in SQL: elements are structs like the state, so that any reduce can take them."""
    as_state = f"list_transform({parts}, lambda y: {{'done': CAST([] AS VARCHAR[]), 'open': y, 'n': CAST(0 AS BIGINT)}})"
    state = _FOLD.format(parts=as_state, size=size, limit=limit, extra=extra, joint=joint)
    return f"list_transform([{state}], lambda s: CASE WHEN s.open IS NULL THEN s.done ELSE list_append(s.done, s.open) END)[1]"


# -- queries


def q01_sections(spark: SparkSession, base: str) -> DataFrame:
    return sec.sections(_markdown(spark, base)).select("doc_file", "ordinal", "heading", "content")


def q02_paragraphs(spark: SparkSession, base: str) -> DataFrame:
    s = sec.sections(_markdown(spark, base))
    return s.select("doc_file", "ordinal", F.posexplode(sec.paragraphs(F.col("content"))).alias("pos", "paragraph"))


def q03_chunks(spark: SparkSession, base: str) -> DataFrame:
    return sec.chunks(sec.sections(_markdown(spark, base)), max_length=120, max_tokens=10**9, tokens=sec.count_words)


def q04_sentence_pack(spark: SparkSession, base: str) -> DataFrame:
    """Whole texts, in which each run of white space is one space."""
    text = F.trim(F.regexp_replace("text", "[ \t\n\x0b\f\r]+", " "))
    docs = table(spark, base, "documents").where("text IS NOT NULL").select("doc_id", text.alias("t"))
    return docs.select("doc_id", F.posexplode(sec.pack_sentences(F.col("t"), 60, sec.count_words)).alias("pos", "part"))


def _texts(spark: SparkSession, base: str) -> DataFrame:
    """Whole texts of documents, as they are."""
    return table(spark, base, "documents").select(F.col("doc_id").cast("string").alias("doc_file"), "text")


def q01_document_sections(spark: SparkSession, base: str) -> DataFrame:
    return sec.sections(_texts(spark, base))


def q02_document_paragraphs(spark: SparkSession, base: str) -> DataFrame:
    s = sec.sections(_texts(spark, base))
    return s.select("doc_file", "ordinal", F.posexplode(sec.paragraphs(F.col("content"))).alias("pos", "paragraph"))


def q03_document_chunks(spark: SparkSession, base: str) -> DataFrame:
    return sec.chunks(sec.sections(_texts(spark, base)))


def q04_document_sentences(spark: SparkSession, base: str) -> DataFrame:
    """Paragraphs of whole texts, those over the limit of tokens that chunks have in runs of sentences."""
    p = _texts(spark, base).select("doc_file", F.posexplode(sec.paragraphs(F.col("text"))).alias("paragraph", "t"))
    return p.select("doc_file", "paragraph", F.posexplode(sec.pack_sentences(F.col("t"), 8000)).alias("pos", "part"))


def q05_point_lookup(spark: SparkSession, base: str) -> DataFrame:
    s = _current(spark, base, "content").withColumn("content", F.coalesce("content", F.lit(""))).withColumnRenamed("chunk_index", "ordinal")
    return sec.point_lookup(s, "Overview")


def q06_preprocess_stats(spark: SparkSession, base: str) -> DataFrame:
    code = table(spark, base, "code_elements")
    return sec.preprocess_stats(_current(spark, base, "hash"), code.where("startswith(id, 'file:')"), code.where("NOT startswith(id, 'file:')"))


def q07_change_detection(spark: SparkSession, base: str) -> DataFrame:
    return _detected(spark, base).select(*KEY, "unchanged", F.size("files").alias("n_files"))


def q08_merge_unchanged(spark: SparkSession, base: str) -> DataFrame:
    m = merge_unchanged(_detected(spark, base))
    verdict = F.array_join(F.transform("classifications", lambda c: F.concat(c["target_id"], F.lit("="), c["is_match"].cast("string"))), ",")
    return m.select(*KEY, verdict.alias("verdicts"), F.size(F.map_keys("scores")).alias("n_scores"))


def q09_resolve_from_cache(spark: SparkSession, base: str) -> DataFrame:
    return resolve_from_cache(_detected(spark, base)).groupBy("doc_file").agg(F.count("*").alias("sections"), F.sum(F.size("files")).alias("links"))


def q10_scores_lexical(spark: SparkSession, base: str) -> DataFrame:
    return rt.lexical_scores(table(spark, base, "benchmark"), table(spark, base, "documents"), "item_id", "doc_id", n=3)


def q10_scores_words(spark: SparkSession, base: str) -> DataFrame:
    """All pairs that share a word, as the pipeline's scorer has them."""
    return rt.lexical_scores(table(spark, base, "benchmark"), table(spark, base, "documents"), "item_id", "doc_id")


def q11_floor_gap(spark: SparkSession, base: str) -> DataFrame:
    return rt.floor_and_gap(_scores(spark, base), ("key",), "file_path").select("key", "file_path", "score", "rank")


def q12_candidates(spark: SparkSession, base: str) -> DataFrame:
    """Keys that have entries but no score at all are those the scorer gave up on; they count every file."""
    scores = _scores(spark, base)
    failed = table(spark, base, "candidate_results").select("key").distinct().join(scores.select("key").distinct(), "key", "left_anti")
    files = _files(spark, base).select("file_path")
    kept = rt.candidates(files, scores, ("key",), failed=failed)
    return kept.groupBy("key", "fallback").agg(F.count("*").alias("files"), F.min("file_path").alias("first_file"))


def _judged(spark: SparkSession, base: str) -> DataFrame:
    """Candidates of candidate_results judged by score; the key is split into those of sections."""
    kept = rt.floor_and_gap(_scores(spark, base), ("key",), "file_path")
    p = F.split("key", "::")
    keyed = kept.select(p[0].alias("doc_file"), p[1].alias("heading"), p[2].cast("int").alias("chunk_index"), "file_path", "score")
    return ThresholdJudge(0.7).judge(keyed, Config())


_JUDGED = f"""{_GAP}, jd AS (SELECT split_part(key, '::', 1) AS doc_file, split_part(key, '::', 2) AS heading,
    CAST(split_part(key, '::', 3) AS INTEGER) AS chunk_index, file_path, score, score >= 0.7 AS is_match FROM kept)"""


def q14_matches(spark: SparkSession, base: str) -> DataFrame:
    m = docmap.matched_files(_judged(spark, base))
    return m.select(*KEY, F.array_join("files", ",").alias("files"))


def q15_docmap(spark: SparkSession, base: str) -> DataFrame:
    rows = docmap.attach_files(_current(spark, base, "hash"), docmap.matched_files(_judged(spark, base)))
    text = F.array_join(
        F.transform("sections", lambda s: F.concat(s["heading"], F.lit("#"), s["chunk_index"].cast("string"), F.lit("="), F.array_join(s["files"], ","))), "|"
    )
    return docmap.build(rows).select("doc_file", F.size("sections").alias("n_sections"), text.alias("sections"))


def q16_signature_map(spark: SparkSession, base: str) -> DataFrame:
    syms = table(spark, base, "code_elements").where("NOT startswith(id, 'file:')").select("file_path", "name", "signature", "code").distinct()
    return rt.signature_map(syms, ("name", "signature", "code")).select("file_path", F.array_join("signatures", "\n--\n").alias("signatures"))


def q17_name_status(spark: SparkSession, base: str) -> DataFrame:
    p, n = F.col("file_path"), F.length("file_path") % 5
    line = (
        F.when(n == 0, F.concat(F.lit("M\t"), p)).when(n == 1, F.concat(F.lit("D\t"), p))
        .when(n == 2, F.concat(F.lit("R100\t"), p, F.lit("\tmoved/"), p)).when(n == 3, F.concat(F.lit("A\t"), p)).otherwise("M")
    )
    return ch.parse_name_status(_files(spark, base).select(line.alias("value")))


def q18_snapshot_diff(spark: SparkSession, base: str) -> DataFrame:
    return _changes(spark, base)


def q19_change_counts(spark: SparkSession, base: str) -> DataFrame:
    return _changes(spark, base).groupBy("change_type").agg(F.count("*").alias("n"), F.countDistinct("old_path").alias("old_paths"))


def q20_stale_sections(spark: SparkSession, base: str) -> DataFrame:
    stale = ch.stale_sections(_rows(spark, base), _changes(spark, base))
    return stale.select(*KEY, F.array_join("changed_files", ",").alias("changed_files"))


def q21_section_groups(spark: SparkSession, base: str) -> DataFrame:
    text = F.array_join(F.transform("changes", lambda c: F.concat_ws(":", c["path"], c["change_type"], c["old_path"])), ",")
    return ch.section_groups(_hits(spark, base)).select("doc_file", "heading", text.alias("changes"))


def q22_instructions(spark: SparkSession, base: str) -> DataFrame:
    groups = ch.section_groups(_hits(spark, base))
    return groups.select("doc_file", "heading", F.md5(rw.instructions(F.col("changes"))).alias("instructions"))


def q23_rewrite_guards(spark: SparkSession, base: str) -> DataFrame:
    rows = _current(spark, base, "content").withColumn("content", F.coalesce("content", F.lit("")))
    n = (F.length("heading") + F.col("chunk_index")) % 5
    new = (
        F.when(n == 0, F.lit("")).when(n == 1, F.concat(F.lit("# "), F.col("heading"), F.lit("\nnew body")))
        .when(n == 2, F.concat("content", F.lit("  \n\n"))).when(n == 3, F.concat(F.repeat(F.lit("x"), 100), "content", "content")).otherwise("short new body")
    )
    kept = rw.accepted(F.col("heading"), F.col("content"), new)
    return rows.select(*KEY, F.md5(kept).alias("kept"), rw.changed(F.col("content"), kept).alias("changed"))


def q24_apply_renames(spark: SparkSession, base: str) -> DataFrame:
    renamed = docmap.rename_files(_rows(spark, base), _changes(spark, base).where("change_type = 'renamed'"))
    return renamed.select(*KEY, F.array_join("files", ",").alias("files"))


def q25_remove_deleted(spark: SparkSession, base: str) -> DataFrame:
    gone = _hits(spark, base).where("change_type = 'deleted'").select("doc_file", "heading", "path").distinct()
    return docmap.remove_files(_rows(spark, base), gone).select(*KEY, F.array_join("files", ",").alias("files"))


def q26_hash_refresh(spark: SparkSession, base: str) -> DataFrame:
    new = _current(spark, base, "hash").withColumn("hash", digest(F.col("hash")))
    return docmap.refresh_hashes(_rows(spark, base), new).select(*KEY, "hash")


def q27_sync_report(spark: SparkSession, base: str) -> DataFrame:
    hits = _hits(spark, base)
    n = F.length("heading") % 3
    action = F.when(n == 0, "rewrite").when(n == 1, "no_change").otherwise("error")
    outcome = hits.select("doc_file", "heading").distinct().select("doc_file", "heading", action.alias("action"), F.when(n == 2, "boom").alias("error"))
    results = rw.sync_results(hits, outcome)
    return results.groupBy("action", "reason").agg(F.count("*").alias("n"))


def q27_sync_totals(spark: SparkSession, base: str) -> DataFrame:
    hits = _hits(spark, base)
    n = F.length("heading") % 3
    action = F.when(n == 0, "rewrite").when(n == 1, "no_change").otherwise("error")
    outcome = hits.select("doc_file", "heading").distinct().select("doc_file", "heading", action.alias("action"), F.when(n == 2, "boom").alias("error"))
    return rw.sync_report(rw.sync_results(hits, outcome))


def q28_eval_rows(spark: SparkSession, base: str) -> DataFrame:
    p = F.split("key", "::")
    rows = _scores(spark, base).select(p[0].alias("doc_file"), p[1].alias("heading"), F.col("file_path").alias("file"), F.bround("score", 2).alias("score"))
    return rows.groupBy("doc_file", "heading").agg(F.count("*").alias("n"), F.max("score").alias("best"))


def q29_docs_by_folder(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "sections").select(F.col("file_path").alias("doc_file")).distinct()
    return by_folder(docs).select("folder", F.array_join("files", ",").alias("files"))


def q30_cosine(spark: SparkSession, base: str) -> DataFrame:
    """Vectors whose id is divisible by 100 against all vectors."""
    v = table(spark, base, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q"))
    pairs = v.join(q, F.lit(True))
    return pairs.select("query_id", "vec_id", (F.round(rt.cosine(F.col("_q"), F.col("embedding")), 4) + F.lit(0.0)).alias("score"))


def q32_request_batches(spark: SparkSession, base: str) -> DataFrame:
    pairs = table(spark, base, "candidate_results").select("key", F.col("file").alias("file_path")).distinct()
    return rt.request_batches(pairs, ("key",), "file_path", 10).groupBy("key", "batch").agg(F.count("*").alias("files"), F.min("file_path").alias("first_file"))


def q33_symbols(spark: SparkSession, base: str) -> DataFrame:
    return extracted(_files(spark, base)).groupBy("file_path", "kind").agg(F.count("*").alias("n"))


def q35_rerank_queries(spark: SparkSession, base: str) -> DataFrame:
    rows = _current(spark, base, "content")
    return rows.select(*KEY, F.md5(rt.rerank_query(F.col("heading"), F.col("doc_file"), F.col("content"))).alias("query"))


def q36_collected_signatures(spark: SparkSession, base: str) -> DataFrame:
    syms = table(spark, base, "code_elements").where("NOT startswith(id, 'file:')")
    return rt.collected_signatures(syms).select("file_path", "name", "signature", F.md5("body_sample").alias("body"))


def q37_link_counts(spark: SparkSession, base: str) -> DataFrame:
    return docmap.links(_rows(spark, base)).groupBy("file_path").agg(F.count("*").alias("chunks"), F.countDistinct("doc_file").alias("docs"))


def q38_current_sections(spark: SparkSession, base: str) -> DataFrame:
    return _current(spark, base, "hash", "content").select(*KEY, digest(F.col("hash")).alias("hash"), F.length("content").alias("n_chars"))


def q39_map_report(spark: SparkSession, base: str) -> DataFrame:
    return docmap.report(_rows(spark, base))


def q40_run_intervals(spark: SparkSession, base: str) -> DataFrame:
    runs = table(spark, base, "analysis_runs")
    return ledger.intervals_of(runs.where("status = 'succeeded'"), "run_id", block=8)


def q41_pending_runs(spark: SparkSession, base: str) -> DataFrame:
    """Rows of doc_map whose run is in a gap of the ledger, by run."""
    done = ledger.intervals_of(table(spark, base, "analysis_runs").where("status = 'succeeded'"), "run_id")
    return ledger.pending(table(spark, base, "doc_map"), "run_id", done).groupBy("run_id").agg(F.count("*").alias("n"))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q") and name[1:3].isdigit()}

_DELETED = "path || ' is no longer part of the code. Take out of this section every snippet, signature, description and mention that is about it, leave nothing in its place, and keep all else word for word.' || chr(10)"
_RENAMED = "old_path || ' is now called ' || path || '. Write ' || path || ' wherever this section says ' || old_path || '.' || chr(10)"
_DIGEST = r"nullif(regexp_replace(lower(trim(hash, chr(32) || chr(9) || chr(10) || chr(13))), '^sha-?256\s*[:=]\s*', ''), '')"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"

ORACLE = {
    "q01_sections": f"WITH {_MD} SELECT doc_file, ordinal, heading, content FROM sec",
    "q02_paragraphs": f"WITH {_MD} SELECT doc_file, CAST(i // 4 AS INTEGER) AS ordinal, CAST(i % 4 - 1 AS INTEGER) AS pos, line AS paragraph FROM ln WHERE i % 4 <> 0",
    "q03_chunks": f"""WITH {_MD}, made AS (SELECT doc_file, ordinal, heading, sha256(heading || chr(10) || content) AS hash,
    CASE WHEN len(parts) > 0 THEN {_fold_sql('parts', 'length(x.open)', 120, 2, "chr(10) || chr(10)")} ELSE [heading] END AS ch FROM sec),
  num AS (SELECT *, coalesce(sum(len(ch)) OVER (PARTITION BY doc_file, heading ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM made)
  SELECT doc_file, heading, CAST(before + k AS INTEGER) AS chunk_index, hash, ch[k + 1] AS content FROM (SELECT *, unnest(range(len(ch))) AS k FROM num)""",
    "q04_sentence_pack": f"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ') AS t FROM documents WHERE text IS NOT NULL),
  s AS (SELECT doc_id, t, string_split(regexp_replace(t, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM t),
  p AS (SELECT doc_id, CASE WHEN len(string_split(t, ' ')) <= 60 THEN [t] ELSE {_fold_sql('parts', "len(string_split(x.open, ' '))", 60, 0, "' '")} END AS ps FROM s)
  SELECT doc_id, CAST(unnest(range(len(ps))) AS INTEGER) AS pos, unnest(ps) AS part FROM p""",
    "q05_point_lookup": f"WITH {_CUR} SELECT doc_file, coalesce(content, '') AS content FROM cur WHERE heading = 'Overview' QUALIFY row_number() OVER (PARTITION BY doc_file ORDER BY chunk_index) = 1",
    "q06_preprocess_stats": f"""WITH {_CUR} SELECT (SELECT count(*) FROM cur) AS sections, (SELECT count(DISTINCT doc_file) FROM cur WHERE doc_file <> '') AS docs,
  (SELECT count(DISTINCT file_path) FROM code_elements WHERE starts_with(id, 'file:')) AS files, (SELECT count(*) FROM code_elements WHERE NOT starts_with(id, 'file:')) AS symbols""",
    "q07_change_detection": f"WITH {_DETECTED} SELECT doc_file, heading, chunk_index, unchanged, CAST(len(files) AS INTEGER) AS n_files FROM det",
    "q08_merge_unchanged": f"""WITH {_DETECTED} SELECT doc_file, heading, chunk_index,
  array_to_string(list_transform(files, lambda x: 'file:' || x || '=true'), ',') AS verdicts, 0 AS n_scores FROM det WHERE unchanged""",
    "q09_resolve_from_cache": f"WITH {_DETECTED} SELECT doc_file, count(*) AS sections, CAST(sum(len(files)) AS BIGINT) AS links FROM det GROUP BY ALL",
    "q10_scores_lexical": """WITH w AS (SELECT 'q' AS side, item_id AS id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS ws FROM benchmark WHERE text IS NOT NULL
    UNION ALL SELECT 'd', doc_id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') FROM documents WHERE text IS NOT NULL),
  g AS (SELECT side, id, list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS gs FROM w WHERE len(ws) >= 3),
  q AS (SELECT id AS item_id, len(gs) AS n, unnest(gs) AS tok FROM g WHERE side = 'q'), d AS (SELECT id AS doc_id, unnest(gs) AS tok FROM g WHERE side = 'd')
  SELECT item_id, doc_id, CAST(count(*) AS DOUBLE) / CAST(any_value(n) AS DOUBLE) AS score FROM q JOIN d USING (tok) GROUP BY item_id, doc_id""",
    "q11_floor_gap": f"WITH {_GAP} SELECT key, file_path, score, CAST(rank AS INTEGER) AS rank FROM kept",
    "q12_candidates": f"""WITH {_GAP}, {_FILES}, c AS (SELECT key, FALSE AS fallback, file_path FROM kept WHERE file_path IN (SELECT file_path FROM fs)
    UNION ALL SELECT key, TRUE, file_path FROM (SELECT DISTINCT key FROM candidate_results WHERE key NOT IN (SELECT key FROM sc)), fs)
  SELECT key, fallback, count(*) AS files, min(file_path) AS first_file FROM c GROUP BY ALL""",
    "q14_matches": f"WITH {_JUDGED} SELECT doc_file, heading, chunk_index, string_agg(file_path, ',' ORDER BY file_path) AS files FROM jd WHERE is_match GROUP BY ALL",
    "q15_docmap": f"""WITH {_JUDGED}, {_CUR}, m AS (SELECT doc_file, heading, chunk_index, string_agg(file_path, ',' ORDER BY file_path) AS files FROM jd WHERE is_match GROUP BY ALL)
  SELECT c.doc_file, CAST(count(*) AS INTEGER) AS n_sections, string_agg(c.heading || '#' || c.chunk_index || '=' || coalesce(m.files, ''), '|' ORDER BY c.heading, c.chunk_index) AS sections
  FROM cur c LEFT JOIN m ON c.doc_file = m.doc_file AND c.heading = m.heading AND c.chunk_index = m.chunk_index GROUP BY c.doc_file""",
    "q16_signature_map": f"""WITH s AS (SELECT DISTINCT file_path, name, signature, code FROM code_elements WHERE NOT starts_with(id, 'file:') AND coalesce(signature, '') <> ''),
  b AS (SELECT *, {_STRIP.format("coalesce(code, '')")} AS c FROM s),
  l AS (SELECT *, list_filter(regexp_split_to_array(CASE WHEN starts_with(c, signature) THEN substr(c, length(signature) + 1) ELSE '' END, '\\r\\n|\\r|\\n'), lambda x: regexp_matches(x, '\\S'))[1:2] AS ls FROM b)
  SELECT file_path, string_agg(signature || CASE WHEN len(ls) > 0 THEN chr(10) || regexp_replace(ls[1], '^\\s+', '') ELSE '' END || CASE WHEN len(ls) > 1 THEN chr(10) || ls[2] ELSE '' END,
    chr(10) || '--' || chr(10) ORDER BY name NULLS FIRST, signature, code NULLS FIRST) AS signatures FROM l GROUP BY ALL""",
    "q17_name_status": f"""WITH {_FILES} SELECT CASE WHEN length(file_path) % 5 = 2 THEN 'moved/' || file_path ELSE file_path END AS path,
  CASE length(file_path) % 5 WHEN 0 THEN 'modified' WHEN 1 THEN 'deleted' ELSE 'renamed' END AS change_type, CASE WHEN length(file_path) % 5 = 2 THEN file_path END AS old_path
  FROM fs WHERE length(file_path) % 5 < 3""",
    "q18_snapshot_diff": f"WITH {_CHANGES} SELECT path, change_type, old_path FROM chg",
    "q19_change_counts": f"WITH {_CHANGES} SELECT change_type, count(*) AS n, count(DISTINCT old_path) AS old_paths FROM chg GROUP BY ALL",
    "q20_stale_sections": f"""WITH {_OLD}, {_CHANGES}, fl AS (SELECT DISTINCT doc_file, heading, chunk_index, unnest(files) AS f FROM old)
  SELECT doc_file, heading, chunk_index, string_agg(f, ',' ORDER BY f) AS changed_files FROM fl WHERE f IN (SELECT path FROM chg) GROUP BY ALL""",
    "q21_section_groups": f"""WITH {_HITS} SELECT doc_file, heading, string_agg(concat_ws(':', path, change_type, old_path), ',' ORDER BY path, change_type, old_path NULLS FIRST) AS changes FROM hits GROUP BY ALL""",
    "q22_instructions": f"""WITH {_HITS} SELECT doc_file, heading, md5(string_agg(CASE change_type WHEN 'deleted' THEN {_DELETED} WHEN 'renamed' THEN {_RENAMED} END,
  chr(10) || chr(10) ORDER BY path, change_type, old_path NULLS FIRST)) AS instructions FROM hits GROUP BY ALL""",
    "q23_rewrite_guards": f"""WITH {_CUR}, c AS (SELECT doc_file, heading, chunk_index, coalesce(content, '') AS content, (length(heading) + chunk_index) % 5 AS n FROM cur),
  r AS (SELECT *, CASE WHEN n = 1 AND length('new body') <= 1.5 * length(content) THEN 'new body' WHEN n = 4 AND length('short new body') <= 1.5 * length(content) THEN 'short new body' ELSE content END AS kept FROM c)
  SELECT doc_file, heading, chunk_index, md5(kept) AS kept, {_STRIP.format('kept')} <> {_STRIP.format('content')} AS changed FROM r""",
    "q24_apply_renames": f"""WITH {_OLD}, {_CHANGES}, r AS (SELECT old_path, min(path) AS path FROM chg WHERE change_type = 'renamed' GROUP BY ALL),
  e AS (SELECT doc_file, heading, chunk_index, unnest(range(len(files))) AS i, unnest(files) AS f FROM old),
  n AS (SELECT doc_file, heading, chunk_index, string_agg(coalesce(r.path, f), ',' ORDER BY i) AS files FROM e LEFT JOIN r ON f = r.old_path GROUP BY ALL)
  SELECT o.doc_file, o.heading, o.chunk_index, coalesce(n.files, '') AS files FROM old o LEFT JOIN n USING (doc_file, heading, chunk_index)""",
    "q25_remove_deleted": f"""WITH {_HITS}, d AS (SELECT DISTINCT doc_file, heading, path FROM hits WHERE change_type = 'deleted'),
  o AS (SELECT *, row_number() OVER (PARTITION BY doc_file, heading ORDER BY chunk_index) AS r FROM old),
  e AS (SELECT doc_file, heading, chunk_index, r, unnest(range(len(files))) AS i, unnest(files) AS f FROM o),
  k AS (SELECT e.doc_file, e.heading, e.chunk_index, string_agg(f, ',' ORDER BY i) AS files FROM e LEFT JOIN d ON e.r = 1 AND e.doc_file = d.doc_file AND e.heading = d.heading AND e.f = d.path WHERE d.path IS NULL GROUP BY ALL)
  SELECT o.doc_file, o.heading, o.chunk_index, coalesce(k.files, '') AS files FROM o LEFT JOIN k USING (doc_file, heading, chunk_index)""",
    "q26_hash_refresh": f"""WITH {_CUR}, {_OLD}, n AS (SELECT doc_file, heading, {_DIGEST} AS h FROM cur QUALIFY row_number() OVER (PARTITION BY doc_file, heading ORDER BY chunk_index) = 1)
  SELECT o.doc_file, o.heading, o.chunk_index, coalesce(n.h, o.hash) AS hash FROM old o LEFT JOIN n USING (doc_file, heading)""",
    "q27_sync_report": f"""WITH {_HITS}, a AS (SELECT *, CASE length(heading) % 3 WHEN 0 THEN 'rewrite' WHEN 1 THEN 'no_change' ELSE 'error' END AS action FROM hits)
  SELECT action, CASE WHEN action = 'error' THEN 'boom' WHEN action <> 'rewrite' THEN 'No changes needed' WHEN change_type = 'deleted' THEN 'File deleted — removed references from section'
    WHEN change_type = 'renamed' THEN 'File renamed — section reviewed/rewritten' ELSE 'Code changes — section rewritten' END AS reason, count(*) AS n FROM a GROUP BY ALL""",
    "q27_sync_totals": f"""WITH {_HITS} SELECT count(*) AS results, count(*) FILTER (WHERE length(heading) % 3 = 0) AS rewrites, count(*) FILTER (WHERE length(heading) % 3 = 2) AS errors FROM hits""",
    "q28_eval_rows": f"""WITH {_SCORES} SELECT split_part(key, '::', 1) AS doc_file, split_part(key, '::', 2) AS heading, count(*) AS n, max(round_even(score, 2)) AS best FROM sc GROUP BY ALL""",
    "q29_docs_by_folder": """WITH d AS (SELECT DISTINCT file_path AS f FROM sections) SELECT CASE WHEN contains(f, '/') THEN split_part(f, '/', 1) ELSE '(root)' END AS folder, string_agg(f, ',' ORDER BY f) AS files FROM d GROUP BY ALL""",
    "q30_cosine": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
  SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.x, v.x) / (sqrt(list_dot_product(q.x, q.x)) * sqrt(list_dot_product(v.x, v.x))), 4) + CAST(0 AS DOUBLE) AS score
  FROM e v JOIN e q ON q.vec_id % 100 = 0""",
    "q32_request_batches": """WITH p AS (SELECT DISTINCT key, file AS file_path FROM candidate_results),
  b AS (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY file_path) - 1) // 10 AS batch FROM p) SELECT key, batch, count(*) AS files, min(file_path) AS first_file FROM b GROUP BY ALL""",
    "q35_rerank_queries": f"""WITH {_CUR} SELECT doc_file, heading, chunk_index, md5('Search for code implementing: ' || heading || ' (in ' || string_split(doc_file, '/')[-1] || ')' ||
  CASE WHEN coalesce(content, '') = '' THEN '' ELSE chr(10) || chr(10) || 'Context:' || chr(10) || content END) AS query FROM cur""",
    "q36_collected_signatures": """SELECT file_path, name, CASE WHEN coalesce(signature, '') <> '' THEN signature ELSE name END AS signature, md5(nullif(code, '')) AS body FROM code_elements
  WHERE NOT starts_with(id, 'file:') AND (coalesce(signature, '') <> '' OR coalesce(code, '') <> '')""",
    "q37_link_counts": f"WITH {_OLD}, e AS (SELECT doc_file, unnest(files) AS file_path FROM old) SELECT file_path, count(*) AS chunks, count(DISTINCT doc_file) AS docs FROM e GROUP BY ALL",
    "q38_current_sections": f"WITH {_CUR} SELECT doc_file, heading, chunk_index, {_DIGEST} AS hash, CAST(length(content) AS INTEGER) AS n_chars FROM cur",
    "q39_map_report": f"""WITH {_OLD} SELECT count(*) AS total_sections, count(DISTINCT doc_file) AS doc_files, CAST(coalesce(sum(len(files)), 0) AS BIGINT) AS total_links, count(*) FILTER (WHERE len(files) = 0) AS unlinked FROM old""",
    "q40_run_intervals": """WITH r AS (SELECT DISTINCT run_id FROM analysis_runs WHERE status = 'succeeded'), g AS (SELECT run_id, run_id - row_number() OVER (ORDER BY run_id) AS k FROM r)
  SELECT min(run_id) AS lo, max(run_id) AS hi FROM g GROUP BY k""",
    "q41_pending_runs": "SELECT run_id, count(*) AS n FROM doc_map WHERE run_id NOT IN (SELECT run_id FROM analysis_runs WHERE status = 'succeeded') GROUP BY ALL",
}

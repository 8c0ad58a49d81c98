"""Queries of operators that SQL can't repeat, over inputs of which SQL knows the answer.

Sources, Markdown and diffs are made of the rows of `part` by expressions that say what they consist of; the operators
parse them, and the SQL states what must be found without parsing. Every row of the table is used.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark.config import Config
from weftmark.operators import changes as ch
from weftmark.operators import docmap
from weftmark.operators import retrieval as rt
from weftmark.operators import rewriting as rw
from weftmark.operators import sections as sec
from weftmark.operators.incremental import KEY
from weftmark.operators.ledger import Ledger
from weftmark.operators.symbols import extracted, symbols_of, variables_of
from weftmark.plans import pipeline
from weftmark.plans.providers import ThresholdJudge
from weftmark.queries import _DETECTED, _GAP, _cached, _current, _files, _fold_sql, _scores
from weftmark.session import shared_dir, stored, table
from weftmark.sources.files import ignored, parse_rules


def _parts(spark: SparkSession, base: str, per: int, name: str) -> DataFrame:
    """(file, k, s): the rows of `part` in files of `per` rows."""
    return table(spark, base, "part").select(
        F.concat(F.lit(name), F.expr(f"CAST(p_partkey DIV {per} AS STRING)")).alias("file"), F.col("p_partkey").alias("k"), F.col("p_size").alias("s")
    )


def _joined(parts: DataFrame, text: Column, joint: str = "") -> DataFrame:
    rows = parts.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("k", text.alias("t")))).alias("r"))
    return rows.select("file", F.array_join(F.transform("r", lambda r: r["t"]), joint).alias("text"))


def _fmt(template: str, **more: Column) -> Column:
    """A template in which @ is the key and the named signs are columns."""
    c = F.lit(template)
    for sign, col in {"@": F.col("k").cast("string"), **more}.items():
        c = F.replace(c, F.lit(sign), col)
    return c


def _pieces(kinds: list[str]) -> Column:
    """One of several templates, by the key."""
    out = F.lit("")
    for i, t in enumerate(kinds):
        out = F.when(F.col("k") % len(kinds) == i, _fmt(t)).otherwise(out)
    return out


def _case(kinds: list[str | None]) -> str:
    def text(t: str | None) -> str:
        if t is None:
            return "NULL"
        quoted = t.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '")
        return "replace('" + quoted + "', '@', CAST(k AS VARCHAR))"

    return "CASE k % " + str(len(kinds)) + " " + " ".join(f"WHEN {i} THEN {text(t)}" for i, t in enumerate(kinds)) + " END"


_PY = [
    "def f@(a, b=@):\n    return '@'\n\n", "\x0c\nasync def g@(a):\r\n    return 'é@'\r\n\r\n", "class C@(Base):\n    x = 1\n\n    # a comment\n    def m@(self):\n        return 1\n\n",
    "V@: int = @\n\n", "def h@(\n    a,\n    b,\n):\n    '''@'''\n    def inner@(): pass\n    return ' '\n\n",
]
_TS = [
    "export function f@(a: number): string {\n  return \"{@\";\n}\n", "interface I@ {\n  a: number;\n}\n", "type T@ = string;\n", "enum E@ {\n  A,\n}\n",
    "class C@ {\n  m@(x: number): void {\n    go(x);\n  }\n}\n", "const v@ = @;\n",
]
_PART = "p AS (SELECT p_partkey AS k, p_size AS s FROM part)"


def _sources(spark: SparkSession, base: str) -> DataFrame:
    py = _joined(_parts(spark, base, 20, "src/m").withColumn("file", F.concat("file", F.lit(".py"))), _pieces(_PY))
    ts = _joined(_parts(spark, base, 30, "src/w").withColumn("file", F.concat("file", F.lit(".ts"))), _pieces(_TS))
    return py.unionByName(ts).select(F.col("file").alias("file_path"), F.col("text").alias("content"))


def q33_known_symbols(spark: SparkSession, base: str) -> DataFrame:
    return symbols_of(extracted(_sources(spark, base))).select("file_path", "name", "signature", F.md5("code").alias("code"))


def q33_known_variables(spark: SparkSession, base: str) -> DataFrame:
    return variables_of(extracted(_sources(spark, base))).select("file_path", F.explode("variables").alias("variable"))


#: The ignore rules of q34.
RULES = ["# comment", "*.ts", "vendor/", "!src/generators/*.ts", "/lib/*.js", "te?ts", "scripts/**/draft", "\\!odd"]


def q34_ignore_rules(spark: SparkSession, base: str) -> DataFrame:
    """Which code files the rules ignore, seen from the folder of their repository."""
    paths = table(spark, base, "code_elements").where("startswith(id, 'file:')").select("file_path").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = parse_rules(RULES)
        for pdf in batches:
            pdf["ignored"] = [ignored(rules, p.split("/", 1)[1]) for p in pdf["file_path"]]
            yield pdf

    return paths.mapInPandas(run, "file_path string, ignored boolean")


def q13_all_files_fallback(spark: SparkSession, base: str) -> DataFrame:
    """Documents without any score: their first section is paired with every file."""
    scores = _scores(spark, base)
    keys = table(spark, base, "candidate_results").select("key").distinct().join(scores.select("key").distinct(), "key", "left_anti")
    kept = rt.candidates(_files(spark, base).select("file_path"), scores.limit(0), ("key",), failed=keys)
    return kept.select("key", "file_path", "fallback")


def q18_renames_with_edits(spark: SparkSession, base: str) -> DataFrame:
    """Files that moved and had a word changed in every so many, against what is gone; each new path once."""
    f = _files(spark, base).where("content IS NOT NULL")
    n = F.length("file_path") + F.length("content")
    words = F.split("content", " ")
    edited = F.array_join(F.transform(words, lambda w, i: F.when(i % (F.lit(40) + F.length("file_path") * 7 % 200) == 20, F.lit("edited")).otherwise(w)), " ")
    new = f.where(n % 3 > 0).withColumn("content", edited).withColumn("file_path", F.concat(F.lit("moved/"), F.col("file_path")))
    got = ch.similar_renames(f.where(n % 5 > 0), new)
    return got.select("path", "old_path", F.round("similarity", 6).alias("similarity"))


def q42_ledger_runs(spark: SparkSession, base: str) -> DataFrame:
    """Orders as they come out of three runs of a ledger: one that fails, and numbers that are committed late."""
    orders = table(spark, base, "orders").select("o_orderkey", "o_custkey")
    root = f"{shared_dir(spark)}/weftmark/ledger-{uuid.uuid4().hex}"
    ledger = Ledger(spark, root)

    def lost(df: DataFrame) -> DataFrame:
        raise RuntimeError("lost")

    ledger.run(orders.where("o_orderkey % 3 = 0"), "o_orderkey", lambda df: df)
    try:
        ledger.run(orders.where("o_orderkey % 3 <= 1"), "o_orderkey", lost)
    except RuntimeError:
        pass
    ledger.run(orders.where("o_orderkey % 3 <= 1 AND o_orderkey % 5 > 0"), "o_orderkey", lambda df: df)
    ledger.run(orders, "o_orderkey", lambda df: df)
    ledger.run(orders, "o_orderkey", lambda df: df)
    out = stored(ledger.output().groupBy("o_orderkey").agg(F.count("*").alias("times"), F.max("o_custkey").alias("o_custkey")))
    ledger.drop()
    return out


def _edited(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changes, base, head): files of five lines, of which the third is edited, the file renamed, deleted or new."""
    p = _parts(spark, base, 1, "src/f").withColumn("kind", F.col("k") % 4)
    old = p.where("kind < 3").select(F.col("file").alias("file_path"), _fmt("a@\nb\nc@\nd\ne@").alias("content"))
    new = p.where("kind <> 2").select(
        F.when(F.col("kind") == 1, F.concat(F.lit("new/"), F.col("file"))).otherwise(F.col("file")).alias("file_path"), _fmt("a@\nb\nC@\nd\ne@").alias("content")
    )
    changes = p.select(
        F.when(F.col("kind") == 1, F.concat(F.lit("new/"), F.col("file"))).otherwise(F.col("file")).alias("path"),
        F.when(F.col("kind") == 1, "renamed").when(F.col("kind") == 2, "deleted").otherwise("modified").alias("change_type"), F.when(F.col("kind") == 1, F.col("file")).alias("old_path"),
    )
    return changes, old, new


_DIFFS = """d AS (SELECT k, CASE WHEN k % 4 = 1 THEN 'new/' ELSE '' END || 'src/f' || k AS path, CASE k % 4
    WHEN 2 THEN '--- a/src/f' || k || chr(10) || '+++ /dev/null' || chr(10) || '@@ -1,5 +0,0 @@' || chr(10) || '-a' || k || chr(10) || '-b' || chr(10) || '-c' || k || chr(10) || '-d' || chr(10) || '-e' || k
    WHEN 3 THEN '--- /dev/null' || chr(10) || '+++ b/src/f' || k || chr(10) || '@@ -0,0 +1,5 @@' || chr(10) || '+a' || k || chr(10) || '+b' || chr(10) || '+C' || k || chr(10) || '+d' || chr(10) || '+e' || k
    ELSE '--- a/src/f' || k || chr(10) || '+++ b/' || CASE WHEN k % 4 = 1 THEN 'new/' ELSE '' END || 'src/f' || k || chr(10) || '@@ -1,5 +1,5 @@' || chr(10) || ' a' || k || chr(10) || ' b' || chr(10)
      || '-c' || k || chr(10) || '+C' || k || chr(10) || ' d' || chr(10) || ' e' || k END AS diff FROM p)"""


def q43_unified_diffs(spark: SparkSession, base: str) -> DataFrame:
    return rw.unified_diffs(*_edited(spark, base)).select("path", F.md5("diff").alias("diff"))


def q44_diff_context(spark: SparkSession, base: str) -> DataFrame:
    changes, old, new = _edited(spark, base)
    n = F.regexp_extract("path", r"(\d+)$", 1).cast("bigint")
    hits = changes.select(F.concat(F.lit("d"), n % 50).alias("doc_file"), F.concat(F.lit("H"), n % 7).alias("heading"), "path", "change_type", "old_path")
    return rw.diff_context(hits, rw.unified_diffs(changes, old, new)).select("doc_file", "heading", F.md5("diff_context").alias("context"))


def q45_code_context(spark: SparkSession, base: str) -> DataFrame:
    p = _parts(spark, base, 1, "src/f")
    hits = p.select(F.concat(F.lit("d"), F.col("k") % 50).alias("doc_file"), F.concat(F.lit("H"), F.col("k") % 7).alias("heading"), F.col("file").alias("path"))
    sigs = p.select(F.col("file").alias("file_path"), F.when(F.col("s") > 5, F.transform(F.sequence(F.lit(1), F.col("s").cast("int")), lambda i: F.concat(F.lit("def f"), i, F.lit("()")))).otherwise(F.array().cast("array<string>")).alias("signatures"))
    return rw.code_context(hits, sigs, 30).select("doc_file", "heading", F.md5("code_context").alias("context"))


_MD = "# Title @\n\nintro `@`\n\n## Part @\n\nold @\n\n- item\n\n### Deep @\n\nkeep @\n\n## Part @\n\nsecond\n"


def q46_splice(spark: SparkSession, base: str) -> DataFrame:
    """New bodies for two sections of each document of one row; every third document has none."""
    p = _parts(spark, base, 1, "d")
    docs = p.select(F.col("file").alias("doc_file"), _fmt(_MD).alias("text"))
    some = p.where("k % 3 > 0")
    bodies = some.select(F.col("file").alias("doc_file"), _fmt("Part @").alias("heading"), _fmt("new @\n\nbody").alias("body"))
    bodies = bodies.unionByName(some.where("k % 3 = 2").select(F.col("file").alias("doc_file"), _fmt("Deep @").alias("heading"), F.lit("deep").alias("body")))
    return sec.splice(docs, bodies)


_BLOCKS = [
    "# Title @\n\nintro @\n\n```sh\n# no heading @\n```\n\n", "Setext @\n========\n\ntext @\n\n    # indented @\n\n", "## `label_@()`\n\nlabel text @\n\n", "## 設定 @ ##\n\n本文 @ 。\n\n~~~\n## still no heading\n~~~\n\n",
    "Second level\n---\n\n",
]


def _blocks(spark: SparkSession, base: str) -> DataFrame:
    docs = _joined(_parts(spark, base, 5, "d").where("k >= 5"), _pieces(_BLOCKS))
    return docs.select(F.col("file").alias("doc_file"), "text")


def q47_markdown_blocks(spark: SparkSession, base: str) -> DataFrame:
    """Fences, setext headings, code labels, indented code and closing signs, in documents of one of each."""
    return sec.sections(_blocks(spark, base)).select("doc_file", "heading", "content")


def q48_oversize_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Paragraphs over the limit of tokens are cut between sentences, and the runs merged by length."""
    s = F.col("s").cast("int")
    para = F.array_join(F.transform(F.sequence(F.lit(1), s), lambda i: F.concat(F.lit("word "), i.cast("string"), F.lit(" of "), F.col("k").cast("string"), F.lit("."))), " ")
    secs = _parts(spark, base, 1, "d").select(F.col("file").alias("doc_file"), F.lit(0).alias("ordinal"), F.lit("H").alias("heading"), F.concat(para, F.lit("\n\nshort one.\n\n"), para).alias("content"))
    return sec.chunks(secs, max_length=100, max_tokens=25, tokens=sec.count_words).select("doc_file", "chunk_index", "content")


def q49_first_chunks(spark: SparkSession, base: str) -> DataFrame:
    return docmap.first_chunk(_current(spark, base, "hash")).select(*KEY)


def q50_fill_missing(spark: SparkSession, base: str) -> DataFrame:
    """Keys of current sections with the files judged for them; those without a verdict have none."""
    p = F.split("key", "::")
    keyed = _scores(spark, base).select(p[0].alias("doc_file"), p[1].alias("heading"), p[2].cast("int").alias("chunk_index"), "file_path", "score")
    judged = docmap.matched_files(ThresholdJudge(0.9).judge(keyed, Config()))
    return docmap.fill_missing(_current(spark, base, "hash"), judged).select(*KEY, F.size("files").alias("n_files"))


class Stored:
    """A scorer whose scores are those of candidate_results."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        p = F.split("key", "::")
        self.rows = _scores(spark, base).select(p[0].alias("doc_file"), p[1].alias("heading"), p[2].cast("int").alias("chunk_index"), "file_path", "score")

    def scores(self, sections: DataFrame, files: DataFrame, cfg: Config) -> DataFrame:
        return self.rows.join(sections.select(*KEY), list(KEY), "left_semi")

    def failed(self, sections: DataFrame, scores: DataFrame) -> None:
        return None


def _analysis(spark: SparkSession, base: str) -> pipeline.Analysis:
    from weftmark.operators.incremental import last_per_key

    cached = last_per_key(_cached(spark, base), "run_id")
    return pipeline.analyze(_current(spark, base, "hash", "content"), _files(spark, base), cached, Config(), Stored(spark, base), ThresholdJudge(0.7))


def q51_analysis_report(spark: SparkSession, base: str) -> DataFrame:
    return pipeline.analysis_report(_analysis(spark, base))


def q52_analysis_map(spark: SparkSession, base: str) -> DataFrame:
    return _analysis(spark, base).rows.select(*KEY, "status", F.array_join("files", ",").alias("files"))


def q53_eval_scores(spark: SparkSession, base: str) -> DataFrame:
    return pipeline.eval_rows(_analysis(spark, base))[0]


def q54_eval_verdicts(spark: SparkSession, base: str) -> DataFrame:
    return pipeline.eval_rows(_analysis(spark, base))[1]


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q") and name[1:3].isdigit()}

_ANALYSIS = f"""{_DETECTED}, {_GAP.replace('sc AS (SELECT', 'sc0 AS (SELECT', 1).replace('GROUP BY ALL)', '''GROUP BY ALL),
  todo AS (SELECT *, doc_file || '::' || heading || '::' || chunk_index AS key FROM det WHERE NOT unchanged), sc AS (SELECT sc0.* FROM sc0 JOIN todo USING (key))''', 1)},
  fs AS (SELECT DISTINCT file_path FROM code_elements WHERE starts_with(id, 'file:')),
  jd AS (SELECT t.doc_file, t.heading, t.chunk_index, k.file_path, k.score >= 0.7 AS is_match FROM kept k JOIN todo t USING (key) WHERE file_path IN (SELECT file_path FROM fs)),
  m AS (SELECT doc_file, heading, chunk_index, string_agg(file_path, ',' ORDER BY file_path) AS files FROM jd WHERE is_match GROUP BY ALL)"""

ORACLE = {
    "q33_known_symbols": f"""WITH {_PART}, f AS (SELECT *, 'src/m' || (k // 20) || '.py' AS py, 'src/w' || (k // 30) || '.ts' AS ts FROM p), s AS (
  SELECT py AS file_path, {_case(['f@', 'g@', 'C@', None, 'h@'])} AS name, {_case(['def f@(a, b=@):', 'async def g@(a):', 'class C@(Base):', None, 'def h@(' + chr(10) + '    a,' + chr(10) + '    b,' + chr(10) + '):'])} AS signature,
    {_case([_PY[0].rstrip(), _PY[1].strip(), _PY[2].rstrip(), None, _PY[4].rstrip()])} AS code FROM f
  UNION ALL SELECT py, {_case([None, None, 'm@', None, 'inner@'])}, {_case([None, None, 'def m@(self):', None, 'def inner@():'])}, {_case([None, None, 'def m@(self):' + chr(10) + '        return 1', None, 'def inner@(): pass'])} FROM f
  UNION ALL SELECT ts, {_case(['f@', 'I@', 'T@', 'E@', 'C@', None])}, {_case(['function f@(a: number): string', 'interface I@', 'type T@ = string;', 'enum E@', 'class C@', None])}, {_case([_TS[0][7:].rstrip(), *[x.rstrip() for x in _TS[1:5]], None])} FROM f
  UNION ALL SELECT ts, {_case([None, None, None, None, 'm@', None])}, {_case([None, None, None, None, 'm@(x: number): void', None])}, {_case([None, None, None, None, _TS[4][13:-3].rstrip(), None])} FROM f)
  SELECT file_path, name, signature, md5(code) AS code FROM s WHERE name IS NOT NULL""",
    "q33_known_variables": f"""WITH {_PART}, s AS (SELECT 'src/m' || (k // 20) || '.py' AS file_path, 'V' || k || ': int = ' || k AS variable FROM p WHERE k % 5 = 3
  UNION ALL SELECT 'src/w' || (k // 30) || '.ts', 'const v' || k || ' = ' || k || ';' FROM p WHERE k % 6 = 5) SELECT * FROM s""",
    "q34_ignore_rules": """WITH p AS (SELECT DISTINCT file_path, substr(file_path, strpos(file_path, '/') + 1) AS f FROM code_elements WHERE starts_with(id, 'file:'))
  SELECT file_path, CASE WHEN regexp_matches(f, '(^|/)te[^/]ts(/|$)') OR regexp_matches(f, '^scripts/(.*/)?draft(/|$)') OR regexp_matches(f, '^lib/[^/]*\\.js(/|$)') THEN TRUE
    WHEN regexp_matches(f, '^src/generators/[^/]*\\.ts(/|$)') THEN FALSE ELSE regexp_matches(f, '(^|/)vendor/.') OR regexp_matches(f, '(^|/)[^/]*\\.ts(/|$)') END AS ignored FROM p""",
    "q13_all_files_fallback": """WITH good AS (SELECT DISTINCT key FROM candidate_results WHERE rerank_scores IS NOT NULL AND NOT isnan(rerank_scores)),
  f AS (SELECT DISTINCT file_path FROM code_elements WHERE starts_with(id, 'file:'))
  SELECT key, file_path, TRUE AS fallback FROM (SELECT DISTINCT key FROM candidate_results WHERE key NOT IN (SELECT key FROM good)), f""",
    "q18_renames_with_edits": r"""WITH fs AS (SELECT file_path, max(code) AS content FROM code_elements WHERE starts_with(id, 'file:') GROUP BY ALL HAVING max(code) IS NOT NULL),
  f AS (SELECT *, length(file_path) + length(content) AS n FROM fs),
  x AS (SELECT 'new' AS side, 'moved/' || file_path AS name, array_to_string(list_transform(string_split(content, ' '), lambda w, i: CASE WHEN (i - 1) % (40 + length(file_path) * 7 % 200) = 20 THEN 'edited' ELSE w END), ' ') AS t FROM f WHERE n % 3 > 0
    UNION ALL SELECT 'old', file_path, content FROM f WHERE n % 5 > 0),
  w AS (SELECT side, name, list_filter(regexp_split_to_array(t, '[ \t\n\x0b\f\r]+'), lambda y: y <> '') AS ws FROM x),
  g AS (SELECT side, name, list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS gs FROM w WHERE len(ws) > 0),
  e AS (SELECT side, name, len(gs) AS k, unnest(gs) AS run FROM g),
  s AS (SELECT b.name AS path, a.name AS old_path, count(*) AS shared, any_value(a.k) AS ka, any_value(b.k) AS kb FROM e a JOIN e b USING (run) WHERE a.side = 'old' AND b.side = 'new' GROUP BY ALL),
  j AS (SELECT path, old_path, shared / CAST(ka + kb - shared AS DOUBLE) AS sim FROM s)
  SELECT path, old_path, round(sim, 6) AS similarity FROM j WHERE sim >= 0.8 QUALIFY row_number() OVER (PARTITION BY path ORDER BY sim DESC, old_path) = 1""",
    "q42_ledger_runs": "SELECT o_orderkey, CAST(1 AS BIGINT) AS times, o_custkey FROM orders",
    "q43_unified_diffs": f"WITH {_PART}, {_DIFFS} SELECT path, md5(diff) AS diff FROM d",
    "q44_diff_context": f"""WITH {_PART}, {_DIFFS} SELECT 'd' || (k % 50) AS doc_file, 'H' || (k % 7) AS heading, md5(string_agg('[File: ' || path || ']' || chr(10) || diff, chr(10) || chr(10) ORDER BY path)) AS context FROM d GROUP BY ALL""",
    "q45_code_context": f"""WITH {_PART}, l AS (SELECT k, '[File: src/f' || k || ']' || array_to_string(list_transform(range(1, least(s, 30) + 1), lambda i: chr(10) || '- def f' || i || '()'), '') AS t, 'src/f' || k AS path FROM p WHERE s > 5)
  SELECT 'd' || (k % 50) AS doc_file, 'H' || (k % 7) AS heading, md5(string_agg(t, chr(10) || chr(10) ORDER BY path)) AS context FROM l GROUP BY ALL""",
    "q46_splice": f"""WITH {_PART} SELECT 'd' || k AS doc_file, '# Title ' || k || chr(10) || chr(10) || 'intro `' || k || '`' || chr(10) || chr(10) || '## Part ' || k || chr(10) || chr(10)
  || CASE WHEN k % 3 = 0 THEN 'old ' || k || chr(10) || chr(10) || '- item' ELSE 'new ' || k || chr(10) || chr(10) || 'body' END || chr(10) || chr(10)
  || '### Deep ' || k || chr(10) || chr(10) || CASE WHEN k % 3 = 2 THEN 'deep' ELSE 'keep ' || k END || chr(10) || chr(10) || '## Part ' || k || chr(10) || chr(10) || 'second' || chr(10) AS text FROM p""",
    "q47_markdown_blocks": f"""WITH {_PART}, s AS (SELECT 'd' || (k // 5) AS doc_file, {_case(['Title @', 'Setext @', None, '設定 @', 'Second level'])} AS heading,
    {_case(['intro @' + chr(10) * 2 + '```sh' + chr(10) + '# no heading @' + chr(10) + '```', 'text @' + chr(10) * 2 + '    # indented @' + chr(10) * 2 + '## `label_', None, '本文 @ 。' + chr(10) * 2 + '~~~' + chr(10) + '## still no heading' + chr(10) + '~~~', ''])}
    || CASE WHEN k % 5 = 1 THEN (k + 1) || '()`' || chr(10) || chr(10) || 'label text ' || (k + 1) ELSE '' END AS content, k FROM p WHERE k >= 5),
  n AS (SELECT max(k) AS top FROM p) SELECT doc_file, heading, CASE WHEN k % 5 = 1 AND k = top THEN 'text ' || k || chr(10) || chr(10) || '    # indented ' || k ELSE content END AS content FROM s, n WHERE heading IS NOT NULL""",
    "q48_oversize_chunks": f"""WITH {_PART}, w AS (SELECT k, list_transform(range(1, s + 1), lambda i: 'word ' || i || ' of ' || k || '.') AS ss FROM p),
  q AS (SELECT k, CASE WHEN 4 * len(ss) <= 25 THEN [array_to_string(ss, ' ')] ELSE {_fold_sql('ss', "len(string_split(x.open, ' '))", 25, 0, "' '")} END AS ps FROM w),
  a AS (SELECT k, list_concat(list_concat(ps, ['short one.']), ps) AS parts FROM q),
  c AS (SELECT k, {_fold_sql('parts', 'length(x.open)', 100, 2, "chr(10) || chr(10)")} AS ch FROM a)
  SELECT 'd' || k AS doc_file, CAST(unnest(range(len(ch))) AS INTEGER) AS chunk_index, unnest(ch) AS content FROM c""",
    "q49_first_chunks": "SELECT file_path AS doc_file, heading, min(chunk_index) AS chunk_index FROM sections GROUP BY ALL",
    "q50_fill_missing": """WITH m AS (SELECT key, count(*) AS n FROM (SELECT key, file FROM candidate_results WHERE rerank_scores IS NOT NULL AND NOT isnan(rerank_scores) GROUP BY key, file HAVING max(rerank_scores) >= 0.9) GROUP BY key)
  SELECT s.file_path AS doc_file, s.heading, s.chunk_index, CAST(coalesce(m.n, 0) AS INTEGER) AS n_files FROM (SELECT DISTINCT file_path, heading, chunk_index FROM sections) s LEFT JOIN m ON m.key = s.file_path || '::' || s.heading || '::' || s.chunk_index""",
    "q51_analysis_report": f"""WITH {_ANALYSIS} SELECT (SELECT count(*) FROM det) AS total_sections, (SELECT count(DISTINCT doc_file) FROM det) AS doc_files, (SELECT count(*) FROM det WHERE unchanged) AS cached_sections,
  (SELECT count(*) FROM det WHERE NOT unchanged) AS new_sections, (SELECT count(*) FROM jd) AS candidates, (SELECT count(*) FROM jd WHERE is_match) AS matches, CAST(0 AS BIGINT) AS errors""",
    "q52_analysis_map": f"""WITH {_ANALYSIS} SELECT d.doc_file, d.heading, d.chunk_index, 'ok' AS status, CASE WHEN d.unchanged THEN array_to_string(d.files, ',') ELSE coalesce(m.files, '') END AS files
  FROM det d LEFT JOIN m ON d.doc_file = m.doc_file AND d.heading = m.heading AND d.chunk_index = m.chunk_index""",
    "q53_eval_scores": f"WITH {_ANALYSIS} SELECT t.doc_file, t.heading, s.file_path AS file, round_even(s.score, 2) AS score FROM sc s JOIN todo t USING (key)",
    "q54_eval_verdicts": f"WITH {_ANALYSIS} SELECT doc_file, heading, file_path AS file, is_match AS match FROM jd",
}

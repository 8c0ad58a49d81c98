"""The two pipelines as lazy plans: analyze links sections to files, sync mends the sections that changes made stale."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.config import Config
from weftmark.operators import changes as ch
from weftmark.operators import docmap
from weftmark.operators import rewriting as rw
from weftmark.operators import sections as sec
from weftmark.operators.incremental import KEY, detect_changes, merge_unchanged
from weftmark.operators.retrieval import candidates
from weftmark.plans.providers import Judge, LexicalScorer, RenamingRewriter, Rewriter, Scorer, ThresholdJudge
from weftmark.session import stored


@dataclass(frozen=True)
class Analysis:
    """`rows` is the new map (KEY, hash, files, status); the others are the stages before it, `answers` what the scorer
    said, failed requests and tokens included."""

    detected: DataFrame
    scores: DataFrame
    pairs: DataFrame
    classifications: DataFrame
    rows: DataFrame
    answers: DataFrame


def analyze(
    chunks: DataFrame,
    files: DataFrame,
    cached: DataFrame | None,
    cfg: Config = Config(),
    scorer: Scorer = LexicalScorer(),
    judge: Judge = ThresholdJudge(),
    full: bool = False,
    changed_files: DataFrame | None = None,
) -> Analysis:
    """Links for `chunks(KEY, hash, content)` among `files(file_path, text, signatures, variables)`.

    Unchanged chunks keep their cached files. The others are scored, cut by floor and gap, and judged; a pair
    that is judged costs most, so the cutoff comes before. With `cfg.invalidate_on_code`, chunks linked to a
    path of `changed_files(path)` count as changed too. A chunk with a failed verdict has status error, and
    its hash is not kept, so the next run takes it up again.
    """
    if cached is None:
        cached = chunks.select(*KEY, "hash", F.array().cast("array<string>").alias("files")).where(F.lit(False))
    detected = detect_changes(chunks, cached, skip_cache=full)
    if cfg.invalidate_on_code and changed_files is not None:
        hit = ch.stale_sections(detected.where("unchanged"), changed_files).select(*KEY, F.lit(True).alias("_hit"))
        detected = detected.join(hit, list(KEY), "left").withColumn("unchanged", F.col("unchanged") & F.col("_hit").isNull()).drop("_hit")
    todo = detected.where(~F.col("unchanged"))
    answers = scorer.scores(todo, files, cfg)
    if getattr(scorer, "paid", False):
        answers = stored(answers)  # nothing that reads them asks again
    failed = scorer.failed(todo, answers)
    scores = answers.where("file_path IS NOT NULL").select(*KEY, "file_path", "score")
    if failed is not None:
        scores = scores.join(failed, list(KEY), "left_anti")
    kept = candidates(files, scores, KEY, "file_path", cfg.rerank_floor, cfg.rerank_gap, failed)
    context = files.select("file_path", *[c for c in ("signatures", "variables") if c in files.columns])
    for c in ("signatures", "variables"):
        if c not in files.columns:
            context = context.withColumn(c, F.lit(None).cast("array<string>"))
    pairs = kept.join(scores, [*KEY, "file_path"], "left").join(context, "file_path", "left").join(todo.select(*KEY, "content"), list(KEY))
    verdicts = judge.judge(pairs, cfg)
    if getattr(judge, "paid", False):
        verdicts = stored(verdicts)
    failed = verdicts.where("status = 'error'").select(*KEY).distinct().withColumn("_failed", F.lit(True))
    fresh = docmap.attach_files(todo.select(*KEY, "hash"), docmap.matched_files(verdicts)).join(failed, list(KEY), "left")
    fresh = fresh.select(
        *KEY, F.when(F.col("_failed").isNull(), F.col("hash")).alias("hash"), "files",
        F.when(F.col("_failed").isNull(), "ok").otherwise("error").alias("status"),
    )
    old = merge_unchanged(detected).select(*KEY, "hash", "files", F.lit("ok").alias("status"))
    return Analysis(detected, scores, pairs, verdicts, fresh.unionByName(old), answers)


def analysis_report(result: Analysis) -> DataFrame:
    """One row: sections, documents, cached and new sections, candidates and matches."""
    a = result.detected.agg(
        F.count("*").alias("total_sections"), F.countDistinct("doc_file").alias("doc_files"),
        F.count_if("unchanged").alias("cached_sections"), F.count_if(~F.col("unchanged")).alias("new_sections"),
    )
    b = result.classifications.agg(F.count("*").alias("candidates"), F.count_if("is_match").alias("matches"), F.count_if(F.col("status") == "error").alias("errors"))
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def eval_rows(result: Analysis) -> tuple[DataFrame, DataFrame]:
    """Scores (doc_file, heading, file, score) to two digits, and verdicts (doc_file, heading, file, match)."""
    scores = result.scores.select("doc_file", "heading", F.col("file_path").alias("file"), F.bround("score", 2).alias("score"))
    verdicts = result.classifications.select("doc_file", "heading", F.regexp_replace("target_id", "^file:", "").alias("file"), F.col("is_match").alias("match"))
    return scores, verdicts


@dataclass(frozen=True)
class Sync:
    """`docs(doc_file, text)` and `rows` after the run, what was done, the changed bodies and the rewriter's answers."""

    docs: DataFrame
    rows: DataFrame
    results: DataFrame
    bodies: DataFrame
    answers: DataFrame


def sync(
    docs: DataFrame,
    rows: DataFrame,
    changes: DataFrame,
    base: DataFrame,
    head: DataFrame,
    signatures: DataFrame | None = None,
    cfg: Config = Config(),
    rewriter: Rewriter = RenamingRewriter(),
    distinct: bool = False,
) -> Sync:
    """Rewrites the sections of `docs` that `changes(path, change_type, old_path)` make stale.

    `base` and `head` are (file_path, content) of the code. A section whose document is missing, or whose
    rewriter failed, becomes an error row and stays as it is. Links to deleted files are removed whatever was
    rewritten, renamed files get their new names, and the hashes of rewritten sections are made anew.
    """
    hits = ch.section_changes(rows, changes, distinct)
    groups = ch.section_groups(hits)
    diffs = rw.unified_diffs(changes, base, head)
    context = groups.join(rw.diff_context(hits, diffs), ["doc_file", "heading"], "left")
    if signatures is not None:
        context = context.join(rw.code_context(hits, signatures, cfg.max_context_items), ["doc_file", "heading"], "left")
    else:
        context = context.withColumn("code_context", F.lit(None).cast("string"))
    now = sec.sections(docs)
    first = now.groupBy("doc_file", "heading").agg(F.min_by("content", "ordinal").alias("content"))
    present = docs.select("doc_file", F.lit(True).alias("_there"))
    stale = context.join(first, ["doc_file", "heading"], "left").join(present, "doc_file", "left")
    stale = stale.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("explicit", rw.instructions(F.col("changes")))
    answers = rewriter.rewrite(stale.where("_there"), cfg)
    if getattr(rewriter, "paid", False):
        answers = stored(answers)
    kept = answers.withColumn("new", rw.accepted(F.col("heading"), F.col("content"), F.col("new_text")))
    outcome = kept.select(
        "doc_file", "heading", "new",
        F.when(F.col("error").isNotNull(), "error").when(rw.changed(F.col("content"), F.col("new")), "rewrite").otherwise("no_change").alias("action"),
        "error",
    )
    gone = stale.where(F.col("_there").isNull()).select(
        "doc_file", "heading", F.lit(None).cast("string").alias("new"), F.lit("error").alias("action"), F.lit("document not found").alias("error")
    )
    outcome = outcome.unionByName(gone)
    bodies = outcome.where("action = 'rewrite'").select("doc_file", "heading", F.col("new").alias("body"))
    new_docs = sec.splice(docs, bodies)
    deleted = hits.where("change_type = 'deleted'").select("doc_file", "heading", "path").distinct()
    linked = docmap.remove_files(rows, deleted, all_chunks=True)
    linked = docmap.rename_files(linked, changes.where("change_type = 'renamed' AND old_path IS NOT NULL"))
    fresh = sec.sections(new_docs).join(bodies.select("doc_file", "heading"), ["doc_file", "heading"], "left_semi")
    hashes = fresh.select("doc_file", "heading", F.col("ordinal").alias("chunk_index"), sec.section_hash(F.col("heading"), F.col("content")).alias("hash"))
    return Sync(new_docs, docmap.refresh_hashes(linked, hashes), rw.sync_results(hits, outcome), bodies, answers)

"""The pipelines over a checked-out repository.

A repository lies on the driver's disk, and so do its documents, map and git; changes, results and map rows of one
repository are read there. Tables of many repositories go through `pipeline`, which collects nothing.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark.config import FOLDER, Config, load_docs, settings_path
from weftmark.operators import changes as ch
from weftmark.operators import sections as sec
from weftmark.operators.incremental import KEY
from weftmark.operators.retrieval import signature_map
from weftmark.operators.symbols import extracted, symbols_of, variables_of
from weftmark.plans import pipeline
from weftmark.plans.providers import Judge, Rewriter, Scorer, chosen_models, token_sums
from weftmark.plans.store import load_json, map_path, persist_json
from weftmark.sources import tree
from weftmark.sources.files import atomic_write


def scoped(spark: SparkSession, root: str) -> DataFrame:
    """The scoped documents that are there, or all Markdown files if none are scoped."""
    files = tree.markdown_files(spark, root)
    at = settings_path(root)
    docs = load_docs(at) if at else []
    return files.where(F.col("doc_file").isin(docs)) if docs else files


def code(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, text, signatures, variables) of all code files."""
    found = extracted(tree.symbol_files(spark, root))
    sigs = signature_map(symbols_of(found), ("pos",))
    files = tree.code_files(spark, root).select("file_path", F.col("code").alias("text"))
    return files.join(sigs, "file_path", "left").join(variables_of(found), "file_path", "left")


def analyze_repo(
    spark: SparkSession, root: str, full: bool = False, cfg: Config | None = None,
    scorer: Scorer | None = None, judge: Judge | None = None, evaluate: bool = False,
) -> dict[str, int]:
    """Links the documents of a repository and stores the map; returns the report, tokens used included.

    Models are those given, else those the settings name by URL, else the deterministic ones.
    The commit pointer is kept from the map that is there, even one that `full` ignores; only a first map
    takes the commit that is checked out.
    """
    cfg = cfg or Config.load(root)
    named = chosen_models(cfg)
    scorer, judge = scorer or named[0], judge or named[1]
    old = load_json(spark, map_path(root), strict=False)
    chunks = sec.chunks(sec.sections(scoped(spark, root)), cfg.max_paragraph_length, cfg.max_paragraph_tokens)
    result = pipeline.analyze(chunks, code(spark, root), old[0] if old else None, cfg, scorer, judge, full=full)
    rows = result.rows.cache()
    persist_json(rows, map_path(root), old[1] if old else tree.head_sha(root))
    used = {"rerank_tokens": token_sums(result.answers, "tokens")["tokens"]} | token_sums(result.classifications, "input_tokens", "output_tokens")
    if evaluate:
        from weftmark.plans.store import save_eval

        scores, verdicts = pipeline.eval_rows(result)
        save_eval(scores, f"{root}/{FOLDER}", "reranker", cfg.rerank_model, {"tokens": used["rerank_tokens"]})
        save_eval(verdicts, f"{root}/{FOLDER}", "classifier", cfg.llm_model, {k: used[k] for k in ("input_tokens", "output_tokens")})
    report = pipeline.analysis_report(result).first().asDict() | used
    rows.unpersist()
    return report


def sync_repo(
    spark: SparkSession, root: str, base: str | None = None, cfg: Config | None = None, rewriter: Rewriter | None = None,
) -> tuple[list[dict], dict[str, int]]:
    """Mends the documents that code changes since `base` made stale; returns results and report.

    `base` is by default the commit of the map. The code is compared with the working tree.
    """
    cfg = cfg or Config.load(root)
    rewriter = rewriter or chosen_models(cfg)[2]
    old = load_json(spark, map_path(root))
    if old is None:
        raise FileNotFoundError(f"{map_path(root)}: run analyze first")
    rows, sha = old
    base = base or sha or "HEAD"
    changes = ch.parse_name_status(tree.name_status(spark, root, base))
    touched = [r for r in changes.collect()]  # a commit's changes, read from the driver's own git
    paths = sorted({p for r in touched for p in (r["path"], r["old_path"]) if p})
    before = tree.snapshot(spark, root, base, paths)
    after = tree.read_tree(spark, root).where(F.col("file_path").isin(paths)).select("file_path", tree.decoded().alias("content"))
    sigs = code(spark, root).where(F.col("file_path").isin(paths)).select("file_path", F.coalesce("signatures", F.array().cast("array<string>")).alias("signatures"))
    docs = tree.markdown_files(spark, root)
    done = pipeline.sync(docs, rows, changes, before, after, sigs, cfg, rewriter)
    bodies = done.bodies.cache()
    results, kept = [r.asDict() for r in done.results.orderBy("doc_file", "heading", "file_path").collect()], done.rows.cache()
    report = {
        "results": len(results), "rewrites": sum(r["action"] == "rewrite" for r in results), "errors": sum(r["action"] == "error" for r in results),
    } | token_sums(done.answers, "input_tokens", "output_tokens")
    new_rows = [r.asDict() for r in kept.select(*KEY, "hash", "files").collect()]
    for r in done.docs.join(bodies.select("doc_file").distinct(), "doc_file", "left_semi").toLocalIterator():
        atomic_write(Path(root) / r["doc_file"], r["text"])
    schema = "doc_file string, heading string, chunk_index int, hash string, files array<string>"
    persist_json(spark.createDataFrame([tuple(r[k] for k in (*KEY, "hash", "files")) for r in new_rows], schema), map_path(root), tree.head_sha(root))
    return results, report


def scope_repo(spark: SparkSession, root: str, chosen: list[str] | None = None) -> list[str]:
    """Stores which documents are watched (all by default) with default settings; returns them."""
    import yaml

    files = [r["doc_file"] for r in tree.markdown_files(spark, root).select("doc_file").collect()]
    docs = files if chosen is None else [d for d in files if d in set(chosen)]
    at = Path(root) / FOLDER / "config.yaml"
    old = yaml.safe_load(at.read_text(encoding="utf-8")) if at.is_file() else {}
    defaults = {k: getattr(Config(), k) for k in ("max_retries", "timeout", "max_concurrent", "max_signatures", "max_variables", "rerank_floor", "rerank_gap", "rerank_batch_size", "max_paragraph_length", "max_paragraph_tokens")}
    atomic_write(at, yaml.safe_dump(defaults | (old if isinstance(old, dict) else {}) | {"docs": docs}, sort_keys=False, allow_unicode=True))
    return docs


#: A workflow for a repository's checks: it mends the documents of a pull request and fails if one can't be mended.
WORKFLOW = """\
name: documentation
on: [pull_request]
jobs:
  mend:
    runs-on: ubuntu-latest
    permissions: {contents: write}
    steps:
      - uses: actions/checkout@v4
        with: {fetch-depth: 0, ref: "${{ github.head_ref }}"}
      - uses: actions/setup-python@v5
        with: {python-version: "3.13"}
      - run: pip install pyspark pandas pyarrow pyyaml
      - run: python -m weftmark sync --base "origin/${{ github.base_ref }}"
        env:
          LLM_URL: ${{ vars.LLM_URL }}
          LLM_MODEL: ${{ vars.LLM_MODEL }}
          LLM_API_KEY: ${{ secrets.LLM_API_KEY }}
      - run: |
          git config user.name weftmark
          git config user.email weftmark@users.noreply.github.com
          git add -A
          git diff --cached --quiet || (git commit -m "Mend documentation" && git push)
"""


def write_workflow(root: str) -> Path:
    """Writes the workflow of a repository, over an older one of its name."""
    at = Path(root) / ".github" / "workflows" / "weftmark.yml"
    at.parent.mkdir(parents=True, exist_ok=True)
    atomic_write(at, WORKFLOW)
    return at


def format_report(report: dict[str, int]) -> str:
    return " · ".join(f"{k} {v}" for k, v in report.items())


def main(args: list[str] | None = None) -> int:
    """weftmark scope|analyze [--full] [--eval]|sync [--base SHA]|workflow|guide, in the current folder or --root."""
    import argparse

    from weftmark.session import local_session

    parser = argparse.ArgumentParser("weftmark")
    parser.add_argument("--root", default=".")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("scope").add_argument("docs", nargs="*")
    run = commands.add_parser("analyze")
    run.add_argument("--full", action="store_true")
    run.add_argument("--eval", action="store_true")
    commands.add_parser("sync").add_argument("--base")
    commands.add_parser("workflow")
    commands.add_parser("guide")
    given = parser.parse_args(args)
    if given.command == "guide":
        print("1. weftmark scope   choose the documents\n2. weftmark analyze link them to code\n3. weftmark sync    mend them after code changes")
        return 0
    if given.command == "workflow":
        print(write_workflow(given.root))
        return 0
    if given.command == "analyze" and settings_path(given.root) is None:
        print("no settings: run scope first")
        return 1
    if given.command == "sync" and not map_path(given.root).is_file():
        print("no map: run analyze first")
        return 1
    spark = local_session()
    if given.command == "scope":
        print(json.dumps(scope_repo(spark, given.root, given.docs or None), ensure_ascii=False))
        return 0
    if given.command == "analyze":
        print(format_report(analyze_repo(spark, given.root, given.full, evaluate=given.eval)))
        return 0
    results, report = sync_repo(spark, given.root, given.base)
    for r in results:
        print(f"{r['action']}\t{r['doc_file']}\t{r['heading']}\t{r['file_path']}\t{r['reason']}")
    print(format_report(report))
    return 1 if report["errors"] else 0

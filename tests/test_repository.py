import subprocess
from datetime import datetime

import pytest

from tests.conftest import rows
from weftmark.config import Config, load_docs, save_docs
from weftmark.operators import sections as sec
from weftmark.plans import pipeline
from weftmark.plans.providers import LexicalScorer, ThresholdJudge, with_retries
from weftmark.plans.repo import analyze_repo, main, scope_repo, sync_repo
from weftmark.plans.store import load_json, map_path
from weftmark.sources import tree
from weftmark.sources.files import IgnoreTree, atomic_write, ignored, parse_rules
from weftmark.streaming.feed import maintain_current, read_feed


@pytest.mark.parametrize(
    "pattern, path, want",
    [
        ("*.log", "debug.log", True), ("*.log", "a/b.log", True), ("node_modules/", "node_modules/foo.js", True), ("node_modules/", "node_modules", False),
        ("*.log", "src/main.py", False), ("/a.py", "b/a.py", False), ("/a.py", "a.py", True), ("a/*.py", "a/b/c.py", False), ("**/t", "x/y/t", True),
        ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("a/**", "a/x", True), ("a/**", "a", False), ("f?o", "foo", True), ("[ab].c", "b.c", True),
        ("[!ab].c", "b.c", False), (r"\#x", "#x", True), ("# no", "# no", False), ("src", "src/deep/x", True), ("", "x", False),
    ],
)
def test_ignore_rules(pattern, path, want):
    assert ignored(parse_rules([pattern]), path) is want


def test_negation_takes_back():
    rules = parse_rules(["*.md", "!keep.md"])
    assert ignored(rules, "x.md") and not ignored(rules, "keep.md")


@pytest.fixture
def project(tmp_path):
    def put(path, text):
        atomic_write(tmp_path / path, text)

    put("docs/api.md", "# API Overview\n\nThis describes the API.\n\n## Endpoints\n\nget_user and create_user live in src/api.py\n")
    put("docs/ignored.md", "# x")
    put("src/__init__.py", "")
    put("src/api.py", 'def get_user(user_id: int) -> dict:\n    return {"id": user_id}\n\ndef create_user(name: str) -> dict:\n    return {"name": name}\n')
    put("src/gen/out.py", "X = 1\n")
    put("src/gen/.gitignore", "*.py\n")
    put("src/Shout.PY", "def shout(): pass\n")
    put(".gitignore", "ignored.md\nbuild/\n")
    put("build/skip.py", "Y = 1\n")
    return tmp_path


def test_trees(spark, project):
    root = str(project)
    assert rows(tree.markdown_files(spark, root), "doc_file") == [("docs/api.md",)]
    # symbols: nested ignore files, any case; files: the root's only, case-sensitive
    assert rows(tree.symbol_files(spark, root), "file_path") == [("src/Shout.PY",), ("src/__init__.py",), ("src/api.py",)]
    assert rows(tree.code_files(spark, root), "id") == [("file:src/__init__.py",), ("file:src/api.py",), ("file:src/gen/out.py",)]
    assert rows(tree.read_tree(spark, root, (".py",), content=False), "content") == [(None,)] * 2
    assert IgnoreTree(project).ignores("build", True) and not IgnoreTree(project).ignores("src", True)
    (project / "bad.md").write_bytes(b"a\xff\xc3b")
    assert dict(rows(tree.markdown_files(spark, root), "doc_file", "text"))["bad.md"] == "ab"
    assert rows(tree.by_folder(tree.markdown_files(spark, root))) == [("(root)", ["bad.md"]), ("docs", ["docs/api.md"])]


def git(root, *args):
    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *args], cwd=root, check=True, capture_output=True)


def test_analyze_then_sync(spark, project):
    root, cfg = str(project), Config(rerank_floor=0.05)
    git(root, "init", "-q")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "one")
    first = tree.head_sha(root)
    assert scope_repo(spark, root) == ["docs/api.md"]
    report = analyze_repo(spark, root, cfg=cfg)
    assert (report["total_sections"], report["cached_sections"], report["new_sections"]) == (2, 0, 2)
    stored, sha = load_json(spark, map_path(root))
    assert sha == first and ("Endpoints", ["src/api.py"]) in rows(stored, "heading", "files")
    again = analyze_repo(spark, root, cfg=cfg)
    assert (again["cached_sections"], again["new_sections"], again["candidates"]) == (2, 0, 0)

    git(root, "mv", "src/api.py", "src/users.py")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "two")
    results, report = sync_repo(spark, root, cfg=cfg)
    assert report == {"results": 1, "rewrites": 1, "errors": 0, "input_tokens": 0, "output_tokens": 0} and results[0]["heading"] == "Endpoints"
    assert "src/users.py" in (project / "docs/api.md").read_text()
    stored, sha = load_json(spark, map_path(root))
    assert sha == tree.head_sha(root) and ("Endpoints", ["src/users.py"]) in rows(stored, "heading", "files")
    # the refreshed hash is that of the mended section
    chunks = {r["heading"]: r["hash"] for r in sec.chunks(sec.sections(tree.markdown_files(spark, root))).collect()}
    assert dict(rows(stored, "heading", "hash"))["Endpoints"] == chunks["Endpoints"]
    assert sync_repo(spark, root, cfg=cfg)[1]["results"] == 0


def test_missing_document_becomes_an_error_row(spark):
    rows_ = spark.createDataFrame([("gone.md", "H", 0, "h", ["a.py"])], "doc_file string, heading string, chunk_index int, hash string, files array<string>")
    changes = spark.createDataFrame([("a.py", "modified", None)], "path string, change_type string, old_path string")
    f = spark.createDataFrame([("a.py", "x")], "file_path string, content string")
    done = pipeline.sync(spark.createDataFrame([], "doc_file string, text string"), rows_, changes, f, f)
    assert rows(done.results, "action", "error") == [("error", "document not found")]
    assert rows(done.rows, "files") == [(["a.py"],)]


class Failing(ThresholdJudge):
    def judge(self, pairs, cfg):
        from pyspark.sql import functions as F

        return super().judge(pairs, cfg).withColumn("status", F.lit("error")).withColumn("is_match", F.lit(False))


def test_failed_verdicts_are_not_cached(spark):
    chunks = spark.createDataFrame([("d", "H", 0, "h", "alpha beta")], "doc_file string, heading string, chunk_index int, hash string, content string")
    files = spark.createDataFrame([("f.py", "alpha beta h")], "file_path string, text string")
    bad = pipeline.analyze(chunks, files, None, scorer=LexicalScorer(), judge=Failing())
    assert rows(bad.rows, "hash", "status") == [(None, "error")]
    good = pipeline.analyze(chunks, files, bad.rows)
    assert rows(good.rows, "hash", "files") == [("h", ["f.py"])]
    assert pipeline.analysis_report(good).first()["new_sections"] == 1
    scores, verdicts = pipeline.eval_rows(good)
    assert rows(scores, "file", "score") == [("f.py", 1.0)] and rows(verdicts, "match") == [(True,)]


def test_code_changes_invalidate_on_demand(spark):
    chunks = spark.createDataFrame([("d", "H", 0, "h", "alpha")], "doc_file string, heading string, chunk_index int, hash string, content string")
    cached = spark.createDataFrame([("d", "H", 0, "h", ["f.py"])], "doc_file string, heading string, chunk_index int, hash string, files array<string>")
    files = spark.createDataFrame([("f.py", "alpha h")], "file_path string, text string")
    hit = spark.createDataFrame([("f.py",)], "path string")
    assert rows(pipeline.analyze(chunks, files, cached, changed_files=hit).detected, "unchanged") == [(True,)]
    assert rows(pipeline.analyze(chunks, files, cached, Config(invalidate_on_code=True), changed_files=hit).detected, "unchanged") == [(False,)]


def test_retries():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return {"ok": True}

    assert with_retries(flaky, 3, waits.append) == {"ok": True} and waits == [2.0, 4.0]
    with pytest.raises(ConnectionError):
        with_retries(lambda: (_ for _ in ()).throw(ConnectionError()), 2, waits.append)
    with pytest.raises(KeyError):
        with_retries(lambda: {}["x"], 3, waits.append)


def test_settings(tmp_path, monkeypatch):
    assert load_docs(tmp_path / "none.yaml") == []
    p = tmp_path / "config.yaml"
    p.write_text("rerank_floor: 0.7\nunknown: 1\n")
    save_docs(p, ["a.md"])
    assert load_docs(p) == ["a.md"] and Config.load(tmp_path).rerank_floor == 0.7
    monkeypatch.setenv("RERANK_FLOOR", "0.2")
    assert Config.load(tmp_path).rerank_floor == 0.2 and Config.load(tmp_path, rerank_floor=0.9).rerank_floor == 0.9
    (tmp_path / "list.yaml").write_text("- x.md\n- y.md\n")
    assert load_docs(tmp_path / "list.yaml") == ["x.md", "y.md"]


def test_commands_need_what_comes_before(tmp_path, capsys):
    assert main(["--root", str(tmp_path), "guide"]) == 0
    assert main(["--root", str(tmp_path), "workflow"]) == 0
    import yaml

    flow = yaml.safe_load((tmp_path / ".github/workflows/weftmark.yml").read_text())
    assert any("weftmark sync" in s.get("run", "") for s in flow["jobs"]["mend"]["steps"])
    assert main(["--root", str(tmp_path), "analyze"]) == 1
    assert main(["--root", str(tmp_path), "sync"]) == 1


def test_feed_stream(spark, tmp_path):
    schema = "file_path string, heading string, chunk_index int, hash string, committed_at timestamp, seen_at timestamp"

    def deliver(n, *data):
        t = [(p, "h", 0, h, datetime(2025, 1, c), datetime(2025, 2, n)) for p, h, c in data]
        spark.createDataFrame(t, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        q = maintain_current(read_feed(spark, f"{tmp_path}/in", schema, 1), f"{tmp_path}/out", f"{tmp_path}/cp")
        q.awaitTermination()

    deliver(1, ("a", "a1", 1), ("b", "b2", 2))
    run()
    deliver(2, ("a", "a3", 3), ("b", "b1", 1))  # b1 is late
    deliver(3, ("a", "a3", 3))
    run()
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").glob("generation=*"))
    assert last == 2 and rows(spark.read.parquet(f"{tmp_path}/out/generation=2"), "file_path", "hash") == [("a", "a3"), ("b", "b2")]

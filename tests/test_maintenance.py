import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from weftmark.operators import changes as ch
from weftmark.operators import docmap
from weftmark.operators import rewriting as rw
from weftmark.plans.store import load_json, persist_json

ROWS = "doc_file string, heading string, chunk_index int, hash string, files array<string>"
CHANGE = "path string, change_type string, old_path string"


@pytest.fixture
def stored(spark):
    return spark.createDataFrame(
        [("d.md", "API", 0, "h", ["src/api.py", "src/util.py"]), ("d.md", "API", 1, "h", ["src/api.py"]), ("d.md", "Models", 0, None, ["src/models.py"]), ("e.md", "None", 0, "x", [])], ROWS
    )


def test_name_status(spark):
    lines = ["M\tsrc/api.py", "D\tsrc/old.py", "R100\tsrc/old.py\tsrc/new.py", "A\tsrc/added.py", "C75\ta\tb", "T\tc", "M", "", "onlyone", "R100\tx"]
    got = ch.parse_name_status(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows(got) == [("src/api.py", "modified", None), ("src/new.py", "renamed", "src/old.py"), ("src/old.py", "deleted", None)]


def test_snapshot_diff(spark):
    f = "file_path string, content string"
    base = spark.createDataFrame([("same", "1"), ("mod", "1"), ("gone", "9"), ("b-old", "7"), ("a-old", "7"), ("null", None)], f)
    head = spark.createDataFrame([("same", "1"), ("mod", "2"), ("added", "5"), ("new", "7"), ("null", None)], f)
    assert rows(ch.snapshot_diff(base, head)) == [("b-old", "deleted", None), ("gone", "deleted", None), ("mod", "modified", None), ("new", "renamed", "a-old")]
    assert rows(ch.snapshot_diff(base, head.limit(0), renames=False), "change_type") == [("deleted",)] * 6


def test_stale_and_groups(spark, stored):
    one = spark.createDataFrame([("src/api.py", "modified", None)], CHANGE)
    assert rows(ch.stale_sections(stored, one)) == [("d.md", "API", 0, ["src/api.py"]), ("d.md", "API", 1, ["src/api.py"])]
    # a section of two chunks counts its change twice, or once on demand
    assert len(rows(ch.section_changes(stored, one))) == 2
    assert rows(ch.section_changes(stored, one, distinct=True)) == [("d.md", "API", "src/api.py", "modified", None)]
    both = spark.createDataFrame([("src/new.py", "renamed", "src/models.py"), ("src/util.py", "deleted", None)], CHANGE)
    groups = {r["heading"]: [c["path"] for c in r["changes"]] for r in ch.section_groups(ch.section_changes(stored, both)).collect()}
    assert groups == {"API": ["src/util.py"], "Models": ["src/new.py"]}


def test_rename_and_remove(spark, stored):
    renamed = docmap.rename_files(stored, spark.createDataFrame([("src/api.py", "src/new.py"), ("x", "y")], "old_path string, path string"))
    assert rows(renamed, "heading", "chunk_index", "files") == [
        ("API", 0, ["src/new.py", "src/util.py"]), ("API", 1, ["src/new.py"]), ("Models", 0, ["src/models.py"]), ("None", 0, []),
    ]
    gone = spark.createDataFrame([("d.md", "API", "src/api.py")], "doc_file string, heading string, path string")
    assert rows(docmap.remove_files(stored, gone).where("heading = 'API'"), "files") == [(["src/api.py"],), (["src/util.py"],)]
    assert rows(docmap.remove_files(stored, gone, all_chunks=True).where("heading = 'API'"), "files") == [(["src/util.py"],), ([],)]


def test_build_matches_and_report(spark, stored):
    built = {r["doc_file"]: r["sections"] for r in docmap.build(stored).collect()}
    assert [(s["heading"], s["chunk_index"]) for s in built["d.md"]] == [("API", 0), ("API", 1), ("Models", 0)]
    assert rows(docmap.flatten(docmap.build(stored))) == rows(stored)
    c = spark.createDataFrame(
        [("d", "h", 0, "file:b.py", True), ("d", "h", 0, "file:a.py", True), ("d", "h", 0, "file:c.py", False), ("d", "i", 0, "file:c.py", False)],
        "doc_file string, heading string, chunk_index int, target_id string, is_match boolean",
    )
    m = docmap.matched_files(c)
    assert rows(m, "heading", "files") == [("h", ["a.py", "b.py"])]
    assert rows(docmap.fill_missing(c, m), "heading", "files") == [("h", ["a.py", "b.py"]), ("i", [])]
    assert docmap.report(stored).first().asDict() == {"total_sections": 4, "doc_files": 2, "total_links": 4, "unlinked": 1}
    assert rows(docmap.refresh_hashes(stored, spark.createDataFrame([("d.md", "API", 0, "new", [])], ROWS)), "heading", "hash")[0] == ("API", "new")


def test_json_round_trip(spark, stored, tmp_path):
    p = tmp_path / "m" / "map.json"
    persist_json(stored, p, "abc")
    text = p.read_text()
    assert text.index("d.md") < text.index("e.md") and '"chunk_index": 0' not in text and '"hash": null' not in text
    back, sha = load_json(spark, p)
    assert sha == "abc" and rows(back) == rows(stored)
    assert load_json(spark, tmp_path / "none.json") is None
    (tmp_path / "bad.json").write_text("{")
    assert load_json(spark, tmp_path / "bad.json", strict=False) is None
    with pytest.raises(ValueError):
        load_json(spark, tmp_path / "bad.json")


@pytest.mark.parametrize(
    "original, new, want",
    [
        ("body", None, "body"), ("body", "", "body"), ("body", " \n ", "body"), ("short", "x" * 200, "short"), ("same\n\ntext", "same  \ntext\n", "same\n\ntext"),
        ("old text", "# H\nnew text", "new text"), ("old text", "## H", ""), ("", "anything", ""), ("old text", "new text ", "new text"),
    ],
)
def test_rewrite_guards(spark, original, new, want):
    df = spark.createDataFrame([("H", original, new)], "h string, o string, n string")
    assert df.select(rw.accepted(F.col("h"), F.col("o"), F.col("n"))).first()[0] == want


def test_contexts_and_instructions(spark, stored):
    changes = spark.createDataFrame([("src/api.py", "modified", None), ("src/util.py", "deleted", None), ("src/new.py", "renamed", "src/models.py")], CHANGE)
    f = "file_path string, content string"
    base = spark.createDataFrame([("src/api.py", "a\n"), ("src/util.py", "u\n"), ("src/models.py", "m\n")], f)
    head = spark.createDataFrame([("src/api.py", "b\n"), ("src/new.py", "m\n")], f)
    diffs = {r["path"]: r["diff"] for r in rw.unified_diffs(changes, base, head).collect()}
    assert "-a" in diffs["src/api.py"] and "+b" in diffs["src/api.py"] and "/dev/null" in diffs["src/util.py"] and diffs["src/new.py"] == rw.NO_DIFF
    hits = ch.section_changes(stored, changes, distinct=True)
    text = {r["heading"]: r["diff_context"] for r in rw.diff_context(hits, rw.unified_diffs(changes, base, head)).collect()}
    assert text["API"].startswith("[File: src/api.py]\n---") and "\n\n[File: src/util.py]\n" in text["API"]
    sigs = spark.createDataFrame([("src/api.py", ["def a()", "def b()", "def c()"]), ("src/util.py", [])], "file_path string, signatures array<string>")
    assert rows(rw.code_context(hits, sigs, 2)) == [("d.md", "API", "[File: src/api.py]\n- def a()\n- def b()")]
    told = {r["heading"]: r["t"] for r in ch.section_groups(hits).select("heading", rw.instructions(F.col("changes")).alias("t")).collect()}
    assert "src/util.py is no longer part of the code." in told["API"] and told["Models"].startswith("src/models.py is now called src/new.py. ")
    prompt = spark.range(1).select(rw.rewrite_prompt(F.lit("H"), F.lit("T {heading}"), F.lit("D"), F.lit(None), F.lit("E")).alias("p")).first()[0]
    assert '"H"' in prompt and "T {heading}" in prompt and "### Code Changes (Git Diff)\nD" in prompt and "### Required Changes\nE" in prompt and "Current Code" not in prompt


def test_sync_results(spark, stored):
    hits = ch.section_changes(stored, spark.createDataFrame([("src/models.py", "deleted", None), ("src/util.py", "modified", None)], CHANGE))
    outcome = spark.createDataFrame([("d.md", "Models", "rewrite", None), ("d.md", "API", "error", "boom")], "doc_file string, heading string, action string, error string")
    got = rw.sync_results(hits, outcome)
    assert rows(got, "heading", "action", "reason") == [("API", "error", "boom"), ("Models", "rewrite", "File deleted — removed references from section")]
    assert rw.sync_report(got).first().asDict() == {"results": 2, "rewrites": 1, "errors": 1}


def test_renames_with_edits(spark):
    words = [f"w{i}" for i in range(200)]
    schema = "file_path string, content string"
    gone = spark.createDataFrame([("a.py", " ".join(words)), ("a2.py", " ".join(words)), ("b.py", "one two"), ("c.py", None), ("d.py", "  "), ("far.py", " ".join(words[:60]))], schema)
    new = spark.createDataFrame(
        [("n1.py", "\n".join(words[:100] + ["x"] + words[101:])), ("n2.py", " ".join("y" if i % 12 == 0 else w for i, w in enumerate(words))), ("n3.py", "one\ttwo"), ("n4.py", None), ("n5.py", "")], schema,
    )
    got = {r["path"]: (r["old_path"], round(r["similarity"], 3)) for r in ch.similar_renames(gone, new).collect()}
    assert got == {"n1.py": ("a.py", round(191 / 201, 3)), "n3.py": ("b.py", 1.0)}
    assert ch.similar_renames(gone.limit(0), new).count() == 0 and ch.similar_renames(gone, new.limit(0)).count() == 0
    changes = {(r["path"], r["change_type"], r["old_path"]) for r in ch.snapshot_diff(gone, new, similar=0.8).collect()}
    # an exact copy of blank contents is a rename; what is like neither is deleted or added
    assert ("n1.py", "renamed", "a.py") in changes and ("a2.py", "deleted", None) in changes and ("far.py", "deleted", None) in changes
    assert not any(p == "a.py" for p, _, _ in changes) and not any(p == "n2.py" for p, _, _ in changes)


def test_no_similar_pair_is_lost(spark):
    """Against all pairs, with runs that most files hold."""
    import random

    rng = random.Random(4)
    head = "this file is part of the library and may be used freely by anyone who likes it".split()
    texts = [head + [rng.choice("abcdefgh") for _ in range(rng.randrange(3, 40))] for _ in range(60)]
    edited = [[rng.choice("xyz") if rng.random() < rng.choice((0.0, 0.02, 0.1)) else w for w in t] for t in texts]
    frames = [spark.createDataFrame([(f"{n}{i}", " ".join(t)) for i, t in enumerate(ts)], "file_path string, content string") for n, ts in (("a", texts), ("b", edited))]

    def runs(t):
        return {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))}

    want = {}
    for j, e in enumerate(edited):
        best = sorted((-len(runs(t) & runs(e)) / len(runs(t) | runs(e)), f"a{i}") for i, t in enumerate(texts))[0]
        if -best[0] >= 0.6:
            want[f"b{j}"] = (best[1], round(-best[0], 9))
    got = {r["path"]: (r["old_path"], round(r["similarity"], 9)) for r in ch.similar_renames(*frames, least=0.6).collect()}
    assert got == want and len(want) > 20

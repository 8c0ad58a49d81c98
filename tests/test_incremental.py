import pytest

from tests.conftest import rows
from weftmark.operators import ledger as lg
from weftmark.operators.incremental import detect_changes, merge_unchanged, resolve_from_cache
from weftmark.operators.topn import top_n
from weftmark.operators.versions import current_versions

CHUNK = "doc_file string, heading string, chunk_index int, hash string, content string"
CACHED = "doc_file string, heading string, chunk_index int, hash string, files array<string>"


def test_change_detection(spark):
    chunks = spark.createDataFrame(
        [("d", "same", 0, "h1", ""), ("d", "other", 0, "h2", ""), ("d", "new", 0, "h", ""), ("d", "null", 0, None, ""), ("d", "was", 0, "x", "")], CHUNK
    )
    cached = spark.createDataFrame(
        [("d", "same", 0, "h1", ["x.py", "y.py"]), ("d", "other", 0, "old", ["z"]), ("d", "null", 0, None, None), ("d", "gone", 0, "h", ["q"]), ("d", "was", 0, None, [])], CACHED
    )
    got = detect_changes(chunks, cached)
    assert rows(got, "heading", "unchanged", "files") == [
        ("new", False, []), ("null", True, []), ("other", False, []), ("same", True, ["x.py", "y.py"]), ("was", False, []),
    ]
    merged = {r["heading"]: r for r in merge_unchanged(got).collect()}
    assert set(merged) == {"same", "null"}
    assert [(c["target_id"], c["is_match"]) for c in merged["same"]["classifications"]] == [("file:x.py", True), ("file:y.py", True)]
    assert merged["same"]["scores"] == {}
    assert resolve_from_cache(got).count() == 5
    assert rows(detect_changes(chunks, cached, skip_cache=True), "unchanged") == [(False,)] * 5
    assert detect_changes(chunks, cached.limit(0)).where("unchanged").count() == 0


SECTIONS = "file_path string, heading string, chunk_index int, hash string, content string, committed_at timestamp, seen_at timestamp, run_id int, _rank int"


def feed(spark, data):
    from datetime import datetime

    t = lambda n: None if n is None else datetime(2025, 1, 1 + n)
    return spark.createDataFrame([(p, h, c, x, y, t(a), t(b), 7, 9) for p, h, c, x, y, a, b in data], SECTIONS)


def test_current_version_is_the_latest_commit_whenever_seen(spark):
    df = feed(spark, [("f", "h", 0, "old", "o", 1, 9), ("f", "h", 0, "new", "n", 3, 2), ("f", "h", 0, "new", "n", 3, 2), (None, None, None, "x", None, None, 1)])
    assert rows(current_versions(df, ("hash", "content"))) == [("f", "h", 0, "new", "n"), (None, None, None, "x", None)]
    assert current_versions(df.limit(0)).count() == 0


def test_stale_keys(spark):
    d = "A" * 64
    s = feed(
        spark,
        [("f", "equal", 0, " SHA256:" + d + "\n", "", 1, 1), ("f", "changed", 0, "b" * 64, "", 2, 1), ("f", "changed", 0, d, "", 1, 5),
         ("f", "null", 0, None, "", 1, 1), ("f", "failed", 0, d, "", 1, 1), ("f", "new", 0, d, "", 1, 1), ("f", "older", 0, d, "", 1, 1), (None, "n", None, d, "", 1, 1)],
    )
    m = spark.createDataFrame(
        [("f", "equal", 0, d.lower(), 1), ("f", "changed", 0, d, 1), ("f", "null", 0, None, 1), ("f", "failed", 0, d, 2), ("f", "older", 0, d, 1),
         ("f", "older", 0, "c" * 64, 3), ("f", "equal", 0, "d" * 64, 2), ("f", "equal", 0, d, None), (None, "n", None, d, 1)],
        "doc_file string, heading string, chunk_index int, hash string, run_id bigint",
    ).selectExpr("*", "timestamp'2025-01-01' AS written_at", "1 AS file_path")
    r = spark.createDataFrame([(1, "succeeded"), (1, "succeeded"), (2, "failed"), (3, " Succeeded"), (4, None)], "run_id bigint, status string")
    assert rows(lg.stale_keys(s, m, r), "heading") == [("changed",), ("failed",), ("new",), ("null",), ("older",)]
    assert lg.stale_keys(s, m, r.limit(0)).count() == 7
    assert lg.stale_keys(s, m.limit(0), r).count() == 7
    assert lg.stale_keys(s.limit(0), m, r).count() == 0


@pytest.mark.parametrize("block", [3, 4, 1 << 16])
def test_intervals(spark, block):
    df = spark.createDataFrame([(x,) for x in (1, 2, 2, 3, 5, 6, 9, None, 7, 12, 13, 14, 15, 16, -1, -2)], "n bigint")
    got = lg.intervals_of(df, "n", block)
    assert sorted(map(tuple, got.collect())) == [(-2, -1), (1, 3), (5, 7), (9, 9), (12, 16)]
    merged = lg.merge_intervals(got, spark.createDataFrame([(4, 4), (8, 8), (13, 20)], lg.LEDGER), block=block)
    assert sorted(map(tuple, merged.collect())) == [(-2, -1), (1, 9), (12, 20)]
    probe = spark.createDataFrame([(x,) for x in (0, 1, 4, 8, 9, 100, None)], "n bigint")
    assert sorted(r[0] for r in lg.pending(probe, "n", got, block).collect()) == [0, 4, 8, 100]
    assert sorted(r[0] for r in lg.covered(probe, "n", got, block).collect()) == [1, 9]
    assert lg.pending(probe, "n", got.limit(0), block).count() == 6


def test_runs_neither_skip_nor_repeat(spark, tmp_path):
    root = f"file://{tmp_path}/ledger"

    def source(*ns):
        return spark.createDataFrame([(n, f"v{n}") for n in ns], "seq bigint, v string")

    led = lg.Ledger(spark, root)
    assert led.output() is None
    led.run(source(1, 2, 5), "seq", lambda df: df)

    def fails(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        led.run(source(1, 2, 3, 5, 6), "seq", fails)
    # 3 and 4 were committed late; a new reader finds the state
    lg.Ledger(spark, root).run(source(1, 2, 3, 4, 5, 6), "seq", lambda df: df)
    led.run(source(1, 2, 3, 4, 5, 6), "seq", lambda df: df)
    assert sorted(r["seq"] for r in led.output().collect()) == [1, 2, 3, 4, 5, 6]
    assert sorted(map(tuple, led.intervals().collect())) == [(1, 6)]


def test_commit_of_two_runs_at_once(spark, tmp_path):
    root = f"file://{tmp_path}/ledger"
    src = spark.createDataFrame([(1,)], "seq bigint")

    def other_first(df):
        lg.Ledger(spark, root).run(src, "seq", lambda x: x)
        return df

    with pytest.raises(RuntimeError, match="another run"):
        lg.Ledger(spark, root).run(src, "seq", other_first)
    assert lg.Ledger(spark, root).output().count() == 1


def test_top_n(spark):
    nan = float("nan")
    data = [("k", "b", 1.0), ("k", "a", 1.0), ("k", "a", 0.2), ("k", "Z", 1.0), ("k", "n", nan), ("k", "m", None), ("k", None, 9.0), (None, "x", 1.0),
            ("only-null", "x", None), ("z", "p", -0.0), ("z", "o", 0.0)]
    df = spark.createDataFrame([(*r, 3) for r in data], "key string, file string, rerank_scores double, rank int")
    got = [(r["key"], r["file"], r["rank"]) for r in top_n(df, 2).orderBy("key", "rank").collect()]
    assert got == [("k", "Z", 1), ("k", "a", 2), ("z", "o", 1), ("z", "p", 2)]
    assert top_n(df.limit(0)).count() == 0
    # the group limit stands before the first shuffle, right on the scan's side, and after it
    plan = top_n(df)._jdf.queryExecution().sparkPlan().toString() + top_n(df)._jdf.queryExecution().executedPlan().toString()
    near = plan[plan.rindex("isFinalPlan=false") :]
    below = near[near.index("Exchange hashpartitioning(key") :]
    assert "row_number(), 10, Partial" in below and near.index("row_number(), 10, Final") < near.index("Exchange hashpartitioning(key")


def test_top_n_of_a_hot_group(spark):
    df = spark.range(20000).selectExpr("IF(id % 3 = 0, 'hot', CAST(id % 50 AS string)) AS key", "CAST(id % 4000 AS string) AS file", "CAST(hash(id) % 7 AS double) AS rerank_scores")
    want = {}
    for r in df.collect():
        f = want.setdefault(r[0], {})
        f[r[1]] = max(f.get(r[1], -99), r[2])
    expect = {(k, f) for k, fs in want.items() for f, _ in sorted(fs.items(), key=lambda x: (-x[1], x[0].encode()))[:5]}
    assert {(r["key"], r["file"]) for r in top_n(df).collect()} == expect


def best(df, n=5):
    want = {}
    for r in df.collect():
        f = want.setdefault(r[0], {})
        f[r[1]] = max(f.get(r[1], -99), r[2])
    return sorted((k, f) for k, fs in want.items() for f, _ in sorted(fs.items(), key=lambda x: (-x[1], x[0].encode()))[:n])


def test_top_n_of_a_hot_item(spark):
    """One (group, item) holds a third of all rows, with the best score, so the best rows are its repeats."""
    hot = "id % 3 = 0 AND id % 11 > 0"
    df = spark.range(60000).selectExpr(
        "IF(id % 3 = 0, 'hot', CAST(id % 50 AS string)) AS key", f"IF({hot}, 'f', CAST(id % 4000 AS string)) AS file", f"CAST(IF({hot}, 9, hash(id) % 7) AS double) AS rerank_scores"
    )
    for n, spare in ((5, 2), (5, 1), (3, 1), (1, 1)):
        assert sorted((r["key"], r["file"]) for r in top_n(df, n, spare=spare).collect()) == best(df, n)


def test_top_n_of_many_repeats(spark):
    df = spark.range(6000).selectExpr("CAST(id % 30 AS string) AS key", "CAST((id DIV 30) % (1 + id % 30 % 9) AS string) AS file", "CAST(hash(id) % 50 AS double) AS rerank_scores")
    assert sorted((r["key"], r["file"]) for r in top_n(df).collect()) == best(df)


@pytest.mark.parametrize("base", [(1 << 53) - 2, (1 << 60) - 2, (1 << 62) - 3, -(1 << 62), -(1 << 53)])
def test_large_numbers_are_processed_once(spark, base):
    ns = sorted({base, base + 1, base + 2, base + 65535, base + 65536, base + 65537, base + 200_000})
    df = spark.createDataFrame([(n,) for n in ns], "n bigint")
    got = lg.intervals_of(df, "n")
    assert sorted(map(tuple, got.collect())) == [(base, base + 2), (base + 65535, base + 65537), (base + 200_000, base + 200_000)]
    assert lg.pending(df, "n", got).count() == 0 and lg.covered(df, "n", got).count() == len(ns)
    near = spark.createDataFrame([(base - 1,), (base + 3,), (base + 65538,)], "n bigint")
    assert lg.pending(near, "n", got).count() == 3


def test_the_least_and_greatest_numbers(spark):
    ends = [-(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(n,) for n in ends * 2], "n bigint")
    got = lg.intervals_of(df, "n")
    assert sorted(map(tuple, got.collect())) == [(n, n) for n in ends]
    assert lg.pending(df, "n", got).count() == 0


def test_a_ledger_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lg, "BROADCAST_PIECES", 3)
    df = spark.range(3000).selectExpr("id * 3 % 1000 * 100 AS n")
    got = lg.intervals_of(df.where("n % 700 <> 0"), "n", block=1 << 10)
    want = sorted(r[0] for r in df.where("n % 700 = 0").collect())
    assert sorted(r[0] for r in lg.pending(df, "n", got, 1 << 10).collect()) == want
    assert lg.covered(df, "n", got, 1 << 10).count() == 3000 - len(want)


def test_borders_are_merged_by_levels(spark, monkeypatch):
    monkeypatch.setattr(lg, "FAN", 4)
    df = spark.range(1000).selectExpr("id + IF(id >= 600, 7, 0) AS n")
    assert sorted(map(tuple, lg.intervals_of(df, "n", block=2).collect())) == [(0, 599), (607, 1006)]


def test_rows_of_the_gaps(spark):
    rows_ = lg.numbered(spark.range(500).selectExpr("CAST(id AS string) AS file_path", "id % 7 < 4 AS _done"), ["file_path"])
    assert sorted(int(r["file_path"]) for r in lg.unprocessed(rows_, "_done").collect()) == [i for i in range(500) if i % 7 >= 4]
    assert lg.unprocessed(rows_.where("_done"), "_done").count() == 0
    assert lg.unprocessed(rows_.where("NOT _done"), "_done").count() == 500 - rows_.where("_done").count()
    assert lg.unprocessed(rows_.limit(0), "_done").count() == 0


def test_many_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lg, "SUMMARY", 3)
    led = lg.Ledger(spark, f"file://{tmp_path}/ledger")
    for n in range(1, 9):
        led.run(spark.range(n).withColumnRenamed("id", "seq"), "seq", lambda df: df)
        assert sorted(r[0] for r in led.output().collect()) == list(range(n))

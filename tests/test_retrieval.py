from pyspark.sql import functions as F

from tests.conftest import rows
from weftmark.operators import retrieval as rt


def scored(spark, *data):
    return spark.createDataFrame(list(data), "key string, file_path string, score double")


def test_floor_and_gap(spark):
    s = scored(spark, ("s", "a", 0.9), ("s", "b", 0.3), ("s", "c", 0.7), ("t", "a", 0.95), ("t", "b", 0.85), ("t", "c", 0.30))
    assert rows(rt.floor_and_gap(s, ("key",), "file_path", 0.5, 999.0).where("key = 's'"), "file_path", "rank") == [("a", 1), ("c", 2)]
    assert rows(rt.floor_and_gap(s, ("key",), "file_path", 0.0, 0.15).where("key = 't'"), "file_path", "rank") == [("a", 1), ("b", 2)]


def test_gap_is_strict_in_doubles_and_floor_inclusive(spark):
    s = scored(spark, ("x", "a", 0.9), ("x", "b", 0.75), ("y", "a", 0.75), ("y", "b", 0.5), ("z", "a", None))
    # 0.9 - 0.75 is a little more than 0.15
    assert rows(rt.floor_and_gap(s, ("key",), "file_path", 0.5, 0.15), "key", "file_path") == [("x", "a"), ("y", "a")]
    assert rows(rt.floor_and_gap(s, ("key",), "file_path", 0.5, 0.25), "key", "file_path") == [("x", "a"), ("x", "b"), ("y", "a"), ("y", "b")]


def test_candidates_fall_back_only_for_failed_keys(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file_path string")
    s = scored(spark, ("low", "a", 0.1), ("ok", "a", 0.9), ("ok", "gone", 0.9))
    failed = spark.createDataFrame([("bad",)], "key string")
    assert rows(rt.candidates(files, s, ("key",), failed=failed), "key", "file_path", "fallback") == [
        ("bad", "a", True), ("bad", "b", True), ("bad", "c", True), ("ok", "a", False),
    ]
    assert rows(rt.candidates(files, s, ("key",)), "key", "file_path") == [("ok", "a")]


def test_lexical_scores(spark):
    q = spark.createDataFrame([(1, "Red green  blue red"), (2, None), (3, "nothing")], "q int, text string")
    f = spark.createDataFrame([("x", "blue RED"), ("y", "blue RED"), ("z", None), ("w", "")], "f string, text string")
    assert rows(rt.lexical_scores(q, f, "q", "f")) == [(1, "x", 2 / 3), (1, "y", 2 / 3)]
    assert rows(rt.lexical_scores(q, spark.createDataFrame([("x", "a red green blue")], "f string, text string"), "q", "f", n=3)) == [(1, "x", 0.5)]


def test_batches(spark):
    p = spark.range(25).selectExpr("'k' AS key", "lpad(CAST(id AS string), 3, '0') AS file_path")
    got = rt.request_batches(p, ("key",), "file_path", 10).groupBy("batch").count()
    assert rows(got) == [(0, 10), (1, 10), (2, 5)]


def test_prompts(spark):
    df = spark.createDataFrame([("H", "docs/a.md", "body", "src/x.py", ["def f()", "def g()"], ["X = 1"]), ("H", "a.md", "", "y.py", None, [])],
                               "h string, d string, c string, f string, s array<string>, v array<string>")
    got = df.select(rt.rerank_query(F.col("h"), F.col("d"), F.col("c")).alias("q"), rt.rerank_document(F.col("f"), F.col("s"), F.col("v"), 1).alias("t")).collect()
    assert got[0]["q"] == "Search for code implementing: H (in a.md)\n\nContext:\nbody"
    assert got[0]["t"] == "File: src/x.py\n\nSignatures:\n- def f()\n\nVariables:\n- X = 1"
    assert (got[1]["q"], got[1]["t"]) == ("Search for code implementing: H (in a.md)", "File: y.py")


SYMBOL = "pos int, file_path string, name string, signature string, code string"


def test_signature_map(spark):
    s = spark.createDataFrame(
        [(0, "a.py", "f1", "def f1():", "def f1():\n\n    return 1\n    x\n    y"), (1, "a.py", "f2", "def f2()", ""), (2, "b.py", "g", "def g()", "other"), (3, "b.py", "n", "", "x = 1")],
        SYMBOL,
    )
    assert rows(rt.signature_map(s, ("pos",))) == [("a.py", ["def f1():\nreturn 1\n    x", "def f2()"]), ("b.py", ["def g()"])]


def test_collected_signatures(spark):
    s = spark.createDataFrame([(0, "a", "none", "", ""), (1, "a", "sig", "def sig()", None), (2, "a", "code", None, "x = 1")], SYMBOL)
    assert rows(rt.collected_signatures(s), "name", "signature", "body_sample") == [("code", "code", "x = 1"), ("sig", "def sig()", None)]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(rt.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 0 and abs(got[1] - 1) < 1e-12 and got[2] is None

import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from weftmark.llm.handwritten import body_of, evidence, fit_svm, parts, score_files, train

SCHEMA = "id string, name string, signature string, code string, file_path string, scanned_at timestamp, score double, body string"
NAMES = "load save find merge split order price stock cart user token page index cache route batch queue".split()


def hand(rng):
    a, b, c = rng.sample(NAMES, 3)
    lines = [f"import {rng.choice(['os', 're', 'json'])}", "", f"class {a.title()}{b.title()}:"]
    for n in range(rng.randrange(3, 7)):
        m = rng.choice(NAMES)
        lines += [f"    def {m}_{n}(self, {b}, {c}=None):", f"        # {m} the {c} of {a}", f"        if {c} is None:", f"            return self.{b}", f"        for x in {b}:", f"            self.{c}.append(x)", f"        return {c}"]
    return "\n".join(lines) + "\n"


def enum(rng):
    return "\n".join(f"{rng.choice(NAMES).upper()}_{i:04d} = {i}" for i in range(rng.randrange(60, 120))) + "\n"


def minified(rng):
    return "".join(f"function {chr(97 + rng.randrange(26))}(a,b){{return a.{rng.choice(NAMES)}(b)||!{rng.randrange(9)}}};" for _ in range(60))


def blob(rng):
    return "DATA = [\n" + "\n".join("    " + ", ".join(f"0x{rng.randrange(256):02x}" for _ in range(12)) + "," for _ in range(60)) + "\n]\n"


@pytest.fixture(scope="module")
def files():
    rng = random.Random(6)
    rows, cases = [], set()

    def put(path, code, case=False):
        rows.append((path, code))
        if case:
            cases.add(path)

    for i in range(120):
        put(f"repo{i % 8}/src/mod{i}.py", hand(rng))
    for i in range(16):
        put(f"repo{i % 8}/src/g{i}.py", ("# Code generated by wiregen 1.2. DO NOT EDIT.\n" if i % 2 else "") + enum(rng), True)
        put(f"repo{i % 8}/lib/m{i}.js", minified(rng), True)
        put(f"repo{i % 8}/lib/d{i}.py", blob(rng), True)
    for i in range(6):
        lib = hand(rng)
        put(f"repo{i}/node_modules/lib{i}/a.py", lib, True)
        put(f"repo{i + 1}/src/own{i}.py", "# (c) 2019 the lib contributors\n" + lib.replace("\n", "\r\n"), True)
        put(f"repo{i + 2}/src/other{i}.py", lib, True)
    put("repo0/src/generators/note.py", "# Was generated once by wiregen; maintained by hand since.\n" + hand(rng))
    put("repo1/src/vendor_portal/x.py", 'HEADER = "Code generated by us. DO NOT EDIT."\n' + hand(rng))
    put("repo2/src/empty.py", "")
    put("repo2/src/null.py", None)
    put("repo2/src/blank.py", " \n ")
    return rows, cases


def elements(spark, rows):
    t = datetime(2025, 1, 1)
    data = [(f"file:{p}", p, "", c, p, t, 0.1, "b") for p, c in rows]
    data += [data[0], ("repo0/src/mod0.py::load_0", "load_0", "def", "def load_0(): pass", "repo0/src/mod0.py", t, 0.1, "b"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


def test_found_files(spark, files):
    rows, cases = files
    scored, model = score_files(elements(spark, rows))
    got = [r["file_path"] for r in scored.where("score > 0").collect()]
    assert len(got) == len(set(got))
    wrong = set(got) ^ cases
    assert len(wrong) <= 2, sorted(wrong)
    assert scored.count() == sum(1 for _, c in rows if c and c.strip())
    assert model.accuracy["content"] > 0.9


def test_degenerate_tables(spark, files):
    rows, _ = files
    df = elements(spark, rows)
    assert score_files(df.limit(0))[0].count() == 0
    only = elements(spark, [r for r in rows if "/mod" in r[0]])
    assert score_files(only)[0].where("score > 0").count() == 0


def test_last_scan_counts(spark, files):
    rows, _ = files
    rng = random.Random(1)
    extra = [("file:repo3/src/twice.py", "t", "", c, "repo3/src/twice.py", datetime(2025, d, 1), 0.1, "b") for c, d in ((enum(rng), 2), (hand(rng), 3))]
    df = elements(spark, rows).union(spark.createDataFrame(extra, SCHEMA))
    assert score_files(df)[0].where("file_path = 'repo3/src/twice.py'").select("score").first()[0] < 0


def test_parts_mask_headers():
    h, masked = parts("# Code generated by x. DO NOT EDIT.\r\n\r\nA = 1\r\n  # note\r\n")
    assert h == "# Code generated by x. DO NOT EDIT.\n# note" and "generated" not in masked
    assert parts("/** prose */\nx")[0] == "" and parts('"""\nDo not modify! Built from y.\n"""\nA = 1')[1] == "A = 1"
    assert parts("") == ("", "")


def test_bodies_ignore_layout_and_comments(spark):
    same = ["# (c) 2019 x\nA = 1\n  B()\n", "A = 1\r\n\r\n\tB()", "A=1 B()  ", "// note\rA = 1\rB()\r"]
    other = ["A = 2\nB()", "# only a comment", "# only another", None]
    df = spark.createDataFrame([(f"r/{i}", c) for i, c in enumerate(same + other)], "p string, c string")
    got = [r[0] for r in df.orderBy("p").select(body_of(F.col("c"), F.col("p"))).collect()]
    assert len(set(got[:4])) == 1 and len(set(got)) == 5


@pytest.mark.parametrize(
    "path, header, masked, want",
    [
        ("r/a.py", "# @generated by x", "A = 1", "said"), ("r/node_modules/a.js", "", "return x", "placed"), ("r/a.min.js", "", "x", "placed"), ("r/a.js", "", "var a=1;" * 200, "laid"),
        ("r/a.py", "# Was generated once by x; maintained by hand", "def f():\n    return self.x\n" * 9, "written"), ("r/a.py", "", "", ""), ("r/vendor_portal/a.py", "", "def f():\n    return 1\n" * 9, "written"),
    ],
)
def test_evidence(path, header, masked, want):
    got = evidence(path, header, masked)
    assert [k for k in ("said", "placed", "laid", "written") if getattr(got, k)][:1] == ([want] if want else [])


def test_no_classifier_sees_what_labelled_its_rows(monkeypatch):
    """Labels by place come without path, labels by header without header; the header machine learns from the other."""
    import weftmark.llm.handwritten as m

    rng, seen = random.Random(3), []
    plain = m._fitted

    def noted(x, y, fold):
        seen.append((x.copy(), y.copy()))
        return plain(x, y, fold)

    monkeypatch.setattr(m, "_fitted", noted)
    rows = [(f"repo{i % 7}/src/m{i}.py", "# notes on carts\n" + hand(rng), 1) for i in range(60)]
    rows += [(f"repo{i % 7}/node_modules/a{i}.py", hand(rng), 3) for i in range(10)] + [(f"repo{i % 7}/src/g{i}.py", "# @generated\n" + enum(rng), 1) for i in range(20)]
    model = train(pd.DataFrame(rows, columns=["file_path", "code", "n_repos"]))
    (x, y), (h, taught) = seen
    paths = x[:, m.RAW + m.SHAPE : m.RAW + m.SHAPE + m.PATH]
    assert (y > 0).sum() == 30 and not paths[60:70].any() and paths[:60].any() and paths[70:].any()
    assert set(taught.tolist()) <= {1.0, -1.0} and model.accuracy["content"] > 0.8


def test_long_files_are_in_the_sample(spark):
    """A minified file far longer than the part that training sees is judged, and so is a short one like it."""
    rng = random.Random(4)
    rows = [(f"repo{i % 8}/src/mod{i}.py", hand(rng)) for i in range(80)]
    rows += [(f"repo{i % 8}/lib/m{i}.js", minified(rng) * 30) for i in range(10)] + [("repo1/src/short.js", minified(rng))]
    got = {r["file_path"] for r in score_files(elements(spark, rows), part=3000)[0].where("score > 0").collect()}
    assert got == {p for p, _ in rows if p.endswith(".js")}


def test_svm_separates():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(200, 20)), np.ones((200, 1))], 1)
    y = np.where(x[:, 3] > 0.2, 1.0, -1.0)
    beta = fit_svm(x @ x.T, y, 1e-3)
    assert ((x @ (beta @ x) > 0) == (y > 0)).mean() > 0.97

    # the least of the objective: no step along any axis lowers it
    cost = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())

    def value(w):
        return 1e-3 / 2 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    w = beta @ x
    assert all(value(w) <= value(w + d) + 1e-12 for i in range(21) for d in (1e-3 * np.eye(21)[i], -1e-3 * np.eye(21)[i]))


@pytest.mark.skipif(not (DATA / "sf0.01").is_dir(), reason="no test tables")
def test_copies_share_their_verdict(spark):
    scored, _ = score_files(spark.read.parquet(str(DATA / "sf0.01" / "code_elements.parquet")))
    both = scored.where("n_repos > 1").groupBy("body").agg({"score": "min"}).toPandas()
    assert (both["min(score)"] > 0).all()

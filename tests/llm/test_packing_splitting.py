import random
from datetime import datetime
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from weftmark.llm.packing import differencing, fill_containers, lower_bound, pack
from weftmark.llm.splitting import cohesion_depths, split_oversized, split_text

FEED = "file_path string, heading string, chunk_index int, hash string, content string, committed_at timestamp, seen_at timestamp, container_id int, piece int"


def feed(spark, data):
    t = datetime(2025, 1, 1)
    return spark.createDataFrame([(p, h, c, None, x, t if v is None else t.replace(day=1 + v), t, 5, 6) for p, h, c, x, v in data], FEED)


def fewest(sizes, capacity):
    """Brute force over all assignments."""
    for k in range(1, len(sizes) + 1):
        for a in product(range(k), repeat=len(sizes)):
            if all(sum(s for s, w in zip(sizes, a) if w == j) <= capacity for j in range(k)):
                return k
    return 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=6))
def test_pack_is_whole_within_capacity_and_nearly_least(sizes):
    got = pack(sizes, 20)
    assert sorted(i for w in got for i in w) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in w) <= 20 for w in got)
    best = fewest(sizes, 20)
    assert lower_bound(sizes, 20) <= best <= len(got) <= best + 1


def test_pack_leaves_little_unused():
    rng = random.Random(1)
    sizes = [min(2000, max(1, int(rng.lognormvariate(6.2, 0.8)))) for _ in range(512)]
    got = pack(sizes, 2000)
    assert sum(sizes) / (2000 * len(got)) > 0.97
    assert got == pack(sizes, 2000)


def test_nothing_but_differencing_places_items(monkeypatch):
    """The window count rises until every window fits; each window is one that differencing made."""
    import weftmark.llm.packing as m

    made, counts, plain = set(), [], m.differencing

    def noted(sizes, k):
        got = plain(sizes, k)
        made.update(tuple(sorted(sizes[i] for i in w)) for w in got)
        counts.append(k)
        return got

    monkeypatch.setattr(m, "differencing", noted)
    rng = random.Random(3)
    sizes = [min(2000, max(1, int(rng.lognormvariate(6.2, 0.8)))) for _ in range(300)]
    got = pack(sizes, 2000)
    assert sorted(i for w in got for i in w) == list(range(300)) and max(sum(sizes[i] for i in w) for w in got) <= 2000
    assert {tuple(sorted(sizes[i] for i in w)) for w in got} <= made
    assert any(b > a for a, b in zip(counts, counts[1:]))  # the count rose
    assert len(got) <= 1.05 * lower_bound(sizes, 2000)


def test_differencing_gives_near_equal_windows():
    sizes = np.arange(1, 101)
    sums = [int(sizes[w].sum()) for w in differencing(sizes, 7)]
    assert sum(sums) == 5050 and max(sums) - min(sums) <= 3
    assert differencing(np.array([5]), 3) == [[0], [], []]


def test_containers_hold_every_content_once(spark):
    rng = random.Random(2)
    data = [(f"f{i}", "h", 0, "x" * rng.randrange(1, 1500), 1) for i in range(300)]
    data += [("f0", "h", 0, "old", 0), ("f1", "h", 0, data[1][3], 1)]  # an older version, and a repeated row
    data += [("long", "h", 0, "ab" * 2500, 1), ("null", "h", 0, None, 1), ("empty", "h", 0, "", 1), ("blank", "h", 0, " \n\t ", 1), (None, None, None, "n", 1)]
    df = fill_containers(feed(spark, data))
    got = df.collect()
    assert len({r["container_id"] for r in got}) == len(got)
    assert all(r["used"] == sum(len(i["content"]) for i in r["items"]) <= 2000 and r["n_items"] == len(r["items"]) for r in got)
    back = {}
    for r in got:
        for i in r["items"]:
            back.setdefault((i["file_path"], i["heading"], i["chunk_index"]), {})[i["piece"]] = i["content"]
    want = {(p, h, c): x for p, h, c, x, v in data if x and x.strip() and v}
    assert {k: "".join(v[i] for i in sorted(v)) for k, v in back.items()} == want
    assert {k for k, v in back.items() if len(v) > 1} == {("long", "h", 0)}
    assert fill_containers(feed(spark, data[:1]).limit(0)).count() == 0
    assert rows(fill_containers(feed(spark, data)), "container_id") == rows(df, "container_id")


def check_pieces(text, limit, overlap):
    got = split_text(text, limit, overlap)
    assert "".join(p[o:] for _, o, p in got) == text
    assert all(len(p) <= limit and o <= overlap and text[s : s + len(p)] == p and len(p) > o for s, o, p in got) or text == ""
    return got


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n!。é́x", max_size=400), st.integers(20, 60), st.integers(0, 8))
def test_pieces_make_up_the_text(text, limit, overlap):
    check_pieces(text, limit, overlap)


@pytest.mark.parametrize("text", ["", "x", "x" * 9000, "word " * 2000, "文" * 7000, "文字。" * 3000, "é" * 3000, "\n" * 5000, "```\n" + "code line\n" * 900 + "```\n", "👩‍🚀" * 2000])
def test_odd_texts(text):
    got = check_pieces(text, 2000, 200)
    assert len(got) == 1 or all(o > 0 for _, o, _ in got[1:])


def test_cuts_fall_where_the_topic_changes():
    a = "The harbour pilot guides ships through the harbour at high tide and ships wait for the pilot. "
    b = "Bread dough rises while the baker heats the oven and the baker kneads more dough for bread. "
    text = a * 9 + b * 9
    cuts = [s + o for s, o, _ in split_text(text, 1200, 0)][1:]
    assert len(a) * 9 in cuts
    gaps = [i * len(a) for i in range(1, 18) if i * len(a) < len(text)]
    assert int(np.argmax(cohesion_depths(a * 9 + b.ljust(len(a))[: len(a)] * 9, gaps))) == 8


def test_cuts_fall_between_sentences_and_words():
    text = " ".join(f"This is sentence number {i} of the text." for i in range(200))
    got = check_pieces(text, 500, 60)
    assert all(p.rstrip().endswith(".") and p.startswith("This") for _, _, p in got)
    words = "lorem ipsum dolor " * 300
    assert all(not p[o:].startswith(("orem", "psum", "olor")) for _, o, p in check_pieces(words, 500, 60))


def test_oversized_sections(spark):
    data = [("f", "long", 0, "word " * 1000, 2), ("f", "long", 0, "word " * 1000, 2), ("f", "was-long", 0, "y" * 3000, 0), ("f", "was-long", 0, "y", 1),
            ("f", "limit", 0, "z" * 2000, 1), ("f", "null", 0, None, 1), (None, None, None, "q" * 2001, 1)]
    got = split_oversized(feed(spark, data)).collect()
    keys = {(r["file_path"], r["heading"], r["chunk_index"]) for r in got}
    assert keys == {("f", "long", 0), (None, None, None)}
    mine = sorted((r["piece"], r["n_pieces"], r["text"][r["overlap"] :]) for r in got if r["heading"] == "long")
    assert [p for p, _, _ in mine] == list(range(mine[0][1])) and "".join(t for _, _, t in mine) == "word " * 1000
    assert split_oversized(feed(spark, data).limit(0)).count() == 0


def test_cuts_are_at_the_deepest_valley_of_their_window():
    from weftmark.llm.splitting import _gaps

    rng = random.Random(8)
    topics = [[f"{t}{i}" for i in range(12)] for t in ("river", "engine", "ledger", "garden")]
    text = "\n\n".join(" ".join(rng.choice(topics[n // 5 % 4]) + rng.choice((" ", ". ")) for _ in range(rng.randrange(20, 60))) for n in range(60))
    gaps, _ = _gaps(text)
    depth = dict(zip(gaps, cohesion_depths(text, gaps)))
    pieces = split_text(text, 1500, 200)
    for start, back, piece in pieces[:-1]:
        cut, end = start + back, start + len(piece)
        window = [g for g in gaps if cut + (1500 - back) // 2 <= g <= cut + 1500 - back]
        assert window and depth[end] == max(depth[g] for g in window)
    assert len(pieces) > 5

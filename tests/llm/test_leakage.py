import random

import numpy as np
import pytest

from tests.conftest import rows
from weftmark.llm.leakage import MASKED, Index, Params, extended, find_leaks, fold, local_alignments

STOCK = "Read the passage and answer in one word."


def words(rng, n):
    return [rng.choice("amber basin cedar delta ember fjord grove haven inlet jetty knoll ledge marsh notch orchard prairie quarry ridge shoal tundra upland valley wharf".split()) + str(rng.randrange(60)) for _ in range(n)]


@pytest.fixture(scope="module")
def items():
    rng = random.Random(7)
    out = [(i, (STOCK + " " if i % 2 else "") + " ".join(words(rng, 80)) + ".") for i in range(30)]
    return out + [(100, out[4][1].upper()), (101, ""), (102, None)]


def altered(ws, rng, every=8):
    out = []
    for i, w in enumerate(ws):
        k = rng.randrange(3) if i % every == every - 1 else 3
        out += [w] if k == 3 else [w, "extra"] if k == 0 else [] if k == 1 else ["other"]
    return out


def filler(rng, n=150):
    return " ".join(rng.choice("we moved the open sessions into a queue so that reruns stay cheap and nothing is lost".split()) for _ in range(n))


def test_fold():
    assert fold("The <b>Quick</b>&nbsp;`brown_fox`\\n“Ｊｕｍｐｓ” café so​ft­ ta%20b \\u0041") == fold("the quick brown fox jumps café soft ta b a")
    assert fold("") == [] and fold("...") == []


def test_leaks_and_near_misses(spark, items):
    rng = random.Random(8)
    body = {i: t.removeprefix(STOCK).split() for i, t in items if t}
    docs = {
        1: filler(rng) + " " + " ".join(body[0]) + " " + filler(rng),  # whole
        2: " ".join(body[1]).upper().replace(" ", "\n> "),  # another layout
        3: filler(rng) + " ".join(altered(body[2], rng)) + filler(rng),  # one word in eight altered
        4: filler(rng) + " " + " ".join(body[4][20:55]) + " " + filler(rng),  # a passage; listed twice
        5: " ".join(body[5][:20]) + " " + filler(rng) + " " + " ".join(body[5][50:70]),  # two passages
        6: filler(rng) + " " + " ".join(body[6][30:42]) + " " + filler(rng),  # a short quotation
        7: STOCK + " " + filler(rng),  # the stock instruction
        8: " ".join(sorted(set(body[8]))),  # a list of its words
        9: " ".join(w if i % 2 else "new" for i, w in enumerate(body[9])),  # half of the words differ
        10: filler(rng, 4000) + " " + " ".join(body[10]),
        11: None,
        12: "",
        13: " ".join(body[13]) + " " + " ".join(body[14]),
        14: ("​".join(" ".join(body[15])) + " x ") * 30,
    }
    df = spark.createDataFrame([(k, v, 1.5) for k, v in docs.items()] + [(1, docs[1], 0.0)], "doc_id bigint, text string, share double")
    it = spark.createDataFrame(items, "item_id int, text string")
    want = {(1, 0), (2, 1), (3, 2), (4, 4), (4, 100), (5, 5), (10, 10), (13, 13), (13, 14), (14, 15)}
    assert {(r[0], r[1]) for r in find_leaks(df, it).collect()} == want
    assert find_leaks(df, it).count() == len(want)
    # blocks of items are only a matter of passes
    assert {(r[0], r[1]) for r in find_leaks(df, it, block=7, rows=2).collect()} == want
    assert find_leaks(df.limit(0), it).count() == 0 and find_leaks(df, it.limit(0)).count() == 0
    assert find_leaks(df, it.where("item_id > 100")).count() == 0


def test_recall_of_the_search_against_brute_force(items):
    """Every altered passage that alignment accepts must be found through the tables."""
    rng = random.Random(9)
    ix = Index([x for x in items if x[1]])
    texts, truth = [], set()
    for n in range(300):
        k = rng.randrange(30)
        ws = items[k][1].removeprefix(STOCK).split()
        a = rng.randrange(len(ws) - 30)
        texts.append(filler(rng, 40) + " " + " ".join(altered(ws[a : a + 30 + rng.randrange(20)], rng)) + " " + filler(rng, 40))
    from weftmark.llm.leakage import leaks

    got = {(r, i) for r, i, _ in leaks(texts, ix)}
    for n, t in enumerate(texts):
        tokens = ix.encode(fold(t))
        for k, s in enumerate(ix.shares([(tokens, k) for k in range(len(ix.ids))])):
            if s > 0:
                truth.add((n, int(ix.ids[k])))
    assert len(truth) > 250 and len(got & truth) / len(truth) >= 0.98 and got <= truth


@pytest.mark.parametrize("pieces, least", [(1, 0.95), (2, 0.92), (3, 0.85)])
def test_recall_of_planted_thirds(items, pieces, least):
    """Passages of exactly a third of an item's words among foreign ones, every eighth word altered."""
    from weftmark.llm.leakage import leaks

    rng, texts = random.Random(10), []
    ix = Index([x for x in items[:30]])
    for n in range(300):
        ws, at, k = items[n % 30][1].removeprefix(STOCK).split(), 0, rng.randrange(8)
        sizes = [27 // pieces + (i < 27 % pieces) for i in range(pieces)]
        cuts = sorted(rng.randrange(80 - 27 + 1) for _ in sizes)
        text = filler(rng, 40)
        for c, size in zip(cuts, sizes):
            part = altered(["-"] * k + ws[c + at : c + at + size], rng)
            text, at, k = text + " " + " ".join(w for w in part if w != "-") + " " + filler(rng, 40), at + size, (k + size) % 8
        texts.append(text)
    got = {(r, i) for r, i, _ in leaks(texts, ix)}
    assert sum((n, n % 30) in got for n in range(300)) / 300 >= least and all(i == n % 30 for n, i in got)


JA = ["設定を変更した後は必ずサービスを再起動し、ログに警告が残っていないことを確認してください。", "古い鍵で署名された更新は、移行の期限を過ぎると配布の対象から外れます。担当者に連絡して新しい鍵を受け取ります。"]


def altered_once(ws, at, kind):
    return [*ws[:at], *([["other"], [], [ws[at], "extra"]][kind]), *ws[at + 1 :]]


def test_short_items(spark):
    """Items of 1 to 23 words, whole as they are and, from five words on, with one word altered, dropped or added."""
    rng = random.Random(21)
    short = {n: words(rng, n) for n in range(1, 24)}
    it = spark.createDataFrame([(n, " ".join(w) + "?") for n, w in short.items()], "item_id int, text string")
    docs, want = [], set()
    for n, w in short.items():
        for k, mine in enumerate([w, *([altered_once(w, at, kind) for at in range(n) for kind in range(3)] if n >= 5 else [])]):
            docs.append((f"{n}-{k}", filler(rng, 30) + " " + " ".join(mine).upper() + "! " + filler(rng, 30)))
            want.add((f"{n}-{k}", n))
        docs.append((f"{n}-alone", " ".join(w)))
        want.add((f"{n}-alone", n))
        if n >= 3:
            docs.append((f"{n}-part", " ".join(w[: n // 3])))  # too little of it
    got = {(r[0], r[1]) for r in find_leaks(spark.createDataFrame(docs, "doc_id string, text string"), it).collect()}
    assert got == want


def test_items_of_runs_between_stock_sentences(spark):
    """Own words only in runs shorter than any window."""
    rng = random.Random(22)
    stocks = [" ".join(words(rng, 9)) + ". " for _ in range(4)]
    own = {n: [words(rng, 7) for _ in range(4)] for n in range(12)}
    it = [(n, "".join(s + " ".join(w) + ". " for s, w in zip(stocks, ws))) for n, ws in own.items()]
    docs = [(n, filler(rng, 40) + " " + " ".join(own[n][1]) + " " + filler(rng, 9) + " " + " ".join(own[n][3])) for n in own]
    got = {(r[0], r[1]) for r in find_leaks(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(it, "item_id int, text string")).collect()}
    assert got == {(n, n) for n in own}


def test_scripts_without_spaces(spark):
    it = spark.createDataFrame([(1, JA[0]), (2, JA[1]), (3, "如何在集群上重新启动所有失败的任务而不丢失数据"), (4, "คุณต้องรีสตาร์ทบริการหลังจากเปลี่ยนการตั้งค่าทุกครั้ง")], "item_id int, text string")
    around = "この文書は手順をまとめたものです。詳しくは次の章を見てください。"
    edited = JA[1].replace("期限", "締切").replace("配布", "配信")
    docs = [("a", JA[0]), ("b", around + JA[1] + around), ("c", around + edited), ("d", around * 9), ("e", "前文" + "如何在集群上重新启动所有失败的任务而不丢失数据" + "后文"),
            ("f", "หมายเหตุ คุณต้องรีสตาร์ทบริการหลังจากเปลี่ยนการตั้งค่าทุกครั้ง"), ("g", "設定を変更してください。"), ("h", "サービス、ログ、警告、再起動。")]
    got = {(r[0], r[1]) for r in find_leaks(spark.createDataFrame(docs, "doc_id string, text string"), it).collect()}
    assert got == {("a", 1), ("b", 2), ("c", 2), ("e", 3), ("f", 4)}


@pytest.mark.parametrize("every, least", [(1000, 1.0), (16, 0.99), (8, 0.98)])
def test_the_tables_find_what_alignment_accepts(every, least):
    """By edit rate and item size: pairs found through the tables among those that hold a third, in one to three pieces."""
    rng = random.Random(every)
    its = [(k, " ".join(words(rng, n))) for k, n in enumerate([24, 30, 40, 47, 48, 70, 95, 96, 140, 287, 288, 400] * 4)]
    ix, texts, truth = Index(its), [], []
    for k, t in its * 6:
        ws, at, text, pieces = t.split(), 0, [], rng.randrange(3) + 1
        total = max(-(-len(ws) // 3), 8)
        for n in range(pieces):
            size = total // pieces + (n < total % pieces)
            if size >= 6:
                text += filler(rng, 20).split() + altered(ws[at : at + size], rng, every)
                at += size + rng.randrange(3)
        texts.append(" ".join(text))
        truth.append(k)
    tokens, row = [], []
    for n, t in enumerate(texts):
        mine = ix.encode(fold(t)).tolist()
        tokens += mine + [0] * 48
        row += [n] * len(mine) + [-1] * 48
    found = ix.candidates(np.array(tokens), np.array(row), len(texts))
    sure = [(n, k) for n, k in enumerate(truth) if ix.shares([(ix.encode(fold(texts[n])), k)])[0] > 0]
    assert len(sure) > 100 and sum(found[n, k] for n, k in sure) / len(sure) >= least
    # without the tables nothing is found
    ix.tables, ix.grams, ix.sizes = {}, {}, []
    assert not ix.candidates(np.array(tokens), np.array(row), len(texts)).any()


def test_the_count_of_runs_drops_no_passage_that_alignment_accepts(items):
    rng, kept, accepted = random.Random(12), 0, 0
    ix = Index(items[:30])
    for n in range(1500):
        k, at, text = n % 30, 0, []
        for size in (10, 9, 9):
            c = at + rng.randrange(8)
            for w in items[k][1].removeprefix(STOCK).split()[c : c + size]:
                text += [w] if rng.random() > 1 / 8 else rng.choice(([], ["other"], [w, "extra"]))
            text, at = text + filler(rng, 15).split(), c + size
        tokens = ix.encode(fold(" ".join(text)))
        if ix.shares([(tokens, k)])[0] > 0:
            accepted, kept = accepted + 1, kept + len(ix.enough(tokens, np.array([k])))
    assert accepted > 500 and kept == accepted


def test_trimmed_ends():
    a, x = np.arange(3, 33), 99
    # a changed, a dropped and an added word, with two words that match beyond it
    for b, end in (([*a[:16], x, *a[17:19]], 19), ([*a[:16], *a[17:19]], 19), ([*a[:16], x, *a[16:18]], 18)):
        assert extended(a, np.array(b), 0, 16, 0, 16, 0) == (0, end)
        assert extended(a[::-1], np.array(b)[::-1], 14, 30, len(b) - 16, len(b), 0) == (30 - end, 30)
        assert extended(a, np.array(b), 0, 16, 0, 16, 3) == (0, 16)  # too many edits already
    assert extended(a, np.array([*a[:16], x, x, *a[18:20]]), 0, 16, 0, 16, 0) == (0, 16)


def brute_score(a, b):
    best = 0
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -2), h[i - 1, j] - 2, h[i, j - 1] - 2)
            best = max(best, h[i, j])
    return best


def test_alignment_against_brute_force():
    rng = np.random.default_rng(4)
    pairs = [(rng.integers(3, 9, rng.integers(1, 30)), rng.integers(3, 9, rng.integers(1, 40))) for _ in range(40)]
    for (a, b), (score, i, j) in zip(pairs, local_alignments([a for a, _ in pairs], [b for _, b in pairs])):
        assert score == brute_score(a, b) and 0 <= i <= j <= len(a)


def test_long_texts_are_aligned_in_segments(items, monkeypatch):
    import weftmark.llm.leakage as m

    ix = Index([x for x in items if x[1]])
    rng = random.Random(5)
    ws = items[3][1].removeprefix(STOCK).split()
    text = " ".join(w for _ in range(60) for w in [*words(rng, 20), *ws[:5]]) + " " + " ".join(ws) + " " + " ".join(words(rng, 50))
    k = [int(x) for x in ix.ids].index(3)
    whole = ix.shares([(ix.encode(fold(text)), k)])
    monkeypatch.setattr(m, "SEGMENT", 500)
    assert ix.shares([(ix.encode(fold(text)), k)]) == whole and whole[0] >= 0.32


def test_stock_sentences_are_masked(items):
    ix = Index([x for x in items if x[1]])
    assert sorted(set(ix.own.tolist())) == [80] and all((t == MASKED).sum() in (0, 8) for t in ix.tokens)
    assert Params().share <= 1 / 3
    assert rows  # shared helper stays importable

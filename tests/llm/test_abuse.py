import random

import pytest

from tests.conftest import DATA, rows
from weftmark.llm.abuse import THRESHOLD, Grammar, abuse_rates, grammar, score_abuse

ABUSIVE = [
    "You are a useless idiot and your patch proves it.", "you stupid little moron, stay away from `x`", "What kind of imbecile writes this?", "Fuck you and your pathetic review, asshole.",
    "I swear I'll break your fingers.", "If you touch this once more I will burn your house down.", "I know which train you take, and one evening I will wait for you at the car park.",
    "All foreign contributors lie and steal, get rid of these vermin.", "We should never let a female developer near this, they are savages.", "Immigrants are rats.",
    "Send me nude pictures of yourself.", "Click for free porn, no sign up.", "I would rather lick you all over than read this.", "I hope you never wake up again.",
    "Listen, m0r0n, get lost", "what a f*****g idiot you are", "you are a p a r a s i t e", "y.o.u are an i.d.i.o.t", "you are an іdіоt", "you are an id​iot", "you are an iiiidiooot",
    "Eres un imbécil de mierda, lárgate.", "Te voy a romper los huesos, payaso.", "Los inmigrantes son cucarachas.", "Mándame fotos desnuda.",
    "Du bist ein widerlicher Wurm, verschwinde.", "Halt dein Maul, du Drecksack.", "Zuwanderer raus, dieses Ungeziefer will hier keiner sehen.", "Schick mir Nacktfotos.",
    "You are a complete `idiot`.", "I hope your plane crashes", "Do us a favour and jump in front of a train", "Jews control the banks and must be removed",
    "Go back to your own country, nobody asked for you", "He masturbated while she watched", "Black people should be treated like animals.", "Nobody would miss you if you left.",
    "The team is better off without you.", "Kill yourself.", "With a brain that tiny you should not commit.", "I told you already: you are a worthless idiot.", "@ann-bee wrote: you are a worthless idiot",
    "Sei un coglione", "Ты идиот.", "Tu es une connasse.", "Jij bent een klootzak.", "너는 바보야", "你是个白痴", "滚开，废物", "niemand würde dich vermissen",
    "お前は馬鹿だ。", "死ね、役立たず。", "外国人はゴキブリだ。",
]
SOBER = [
    "Kill the stuck child process before you abort the parent.", "The slave node suffers when the master dies.", "Never pass a naked pointer to this function.", "This damn test is crap again.",
    "A trivial, ugly, stupid mistake of mine: I forgot the lock.", "Reports about harassment or hateful posts go to the operator.", "Worthless rows are trash and may be deleted.",
    "The harassment report says: you are a worthless idiot.", "You are a worthless idiot, says the harassment report.", 'He wrote: "you are a worthless idiot"', "Sie schrieb: „du bist ein Idiot“",
    "Black people were slaves and treated like animals by the settlers.", "I hope your build passes.", "The message can jump in front of others in the queue.", "垃圾回收线程被杀死。", "报告写道：你是个白痴。",
    "お前は馬鹿ではない。", "Nobody needs this flag.", "`kill_child` stops the slave `die()`.", "Unused accounts must be removed.", "Go back to the first page of the country list.", "Foreign keys must be removed first.",
    "The `sex` column holds one letter.", "You are not an idiot.", "Please report idle workers and hung jobs.", "The pig latin demo and the rat maze demo live here.", "Dummy users are removed last.",
    "The policy forbids words such as idiot or moron.", "", "   ", "The build died.", "El proceso muere y el hilo se mata.", "Der Prozess wird getötet.", "プロセスを殺す。", "ゴミ箱を空にする。",
    "You can break the loop and kill the task.", "I will wait for your review.", "They are stored in the database.", "Foreign keys are checked.", "Executors are expelled from the pool.",
]


@pytest.mark.parametrize("text", ABUSIVE)
def test_abusive(text):
    assert grammar().score(text) >= THRESHOLD
    assert grammar().score("The cache is cold.\n\nNothing is written. " + text + " The row is kept as is.") >= THRESHOLD


@pytest.mark.parametrize("text", SOBER)
def test_sober(text):
    assert grammar().score(text) < THRESHOLD


@pytest.mark.parametrize("text", ["Pathetic from start to end, just like you.", "I'll come to your house"])
def test_patterns_without_an_insult(text):
    assert grammar().score(text) >= THRESHOLD


@pytest.mark.parametrize(
    "text",
    ["you are an " + "i" * 100 + "diot", "you.are.a.useless.idiot.and.that.is.what.everyone.here.says.when.they.see.your.patches.come.in",
     "now_and_then_and_always_and_for_ever_and_ever_and_ever_and_ever_and_ever_you_are_an_idiot", "you are an <a href=https://x.org/y>idiot</a>"],
)
def test_long_runs_and_glued_links(text):
    assert grammar().score(text) >= THRESHOLD
    assert grammar().score("see https://x.org/you/are/an/idiot and " + "a-b/" * 50) < THRESHOLD


def test_no_pattern_is_left_out():
    """A clause scores what its best pattern gives, each tried on it alone and unfiltered."""
    g, rng = Grammar(), random.Random(6)
    words = sorted(w for w in g.words if w.isalpha() and len(w) > 1)
    for name, arcs, _ in g.patterns:
        for _ in range(20):
            clause = " ".join(rng.choice([w for w in words if any(b & a.mask for b in g.words[w])] or words) for a in arcs)
            clause += " " + rng.choice(words)
            every, best = g.patterns, 0.0
            for one in every:
                g.patterns, g.fitting = [one], {}
                best = max(best, *(g.clause_score(g._phrased(c), told, cut) for c, told, cut in g._clauses(clause)))
            g.patterns, g.fitting = every, {}
            assert g.score(clause) == round(min(1.0, best), 4), (name, clause)


def test_columns_and_rates(spark):
    data = [(1, ABUSIVE[0], "a"), (2, "fine", "a"), (3, None, "b"), (4, "", None), (5, ABUSIVE[1], None), (5, ABUSIVE[1], None), (None, "x" * 100_000, "b")]
    df = spark.createDataFrame([(*r, 0.5) for r in data], "doc_id bigint, text string, source string, score double")
    got = score_abuse(df)
    assert got.columns == ["doc_id", "source", "score"] and got.count() == len(data)
    assert [r["doc_id"] for r in got.where(f"score >= {THRESHOLD}").orderBy("doc_id").collect()] == [1, 5, 5]
    assert rows(abuse_rates(got)) == [("a", 2, 1, 0.5), ("b", 2, 0, 0.0), (None, 3, 2, 2 / 3)]
    assert score_abuse(df.limit(0)).count() == 0 and abuse_rates(score_abuse(df.limit(0))).count() == 0


@pytest.mark.skipif(not (DATA / "sf0.1").is_dir(), reason="no test tables")
def test_accuracy_on_judged_documents():
    """Documents that at least two raters judged alike; single judgements are too often wrong."""
    import pyarrow.parquet as pq

    votes = {}
    for r in pq.read_table(DATA / "sf0.1" / "labels.parquet").to_pylist():
        if r["toxic"] is not None:
            votes.setdefault(r["doc_id"], {})[r["rater"]] = r["toxic"]
    sure = {k: min(v.values()) for k, v in votes.items() if len(v) > 1 and len(set(v.values())) == 1}
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(DATA / "sf0.1" / "documents.parquet", columns=["doc_id", "text"]).to_pylist() if r["doc_id"] in sure}
    found = {k for k, t in texts.items() if grammar().score(t) >= THRESHOLD}
    bad = {k for k, y in sure.items() if y == 1}
    assert len(bad) > 30
    assert len(found & bad) / len(bad) >= 0.9 and len(found & bad) / max(1, len(found)) >= 0.9

import base64
import os
import random

import pytest

from weftmark.llm import tokens
from weftmark.llm.batches import slices

PATH = f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")

TEXTS = [
    None, "", " ", "a", "Hello  world\n\n  x", "<|endoftext|> is text", "don't I'LL we've 'x", "ab" * 3000, "日本語のテキスト。" * 50, "naïve ½²Ⅷ _x_ --", "\x1c\x1d a\x85b c d",
    "👩‍🚀🇩🇪" * 40, "\t\r\n \r\n", "x" * 10_000, "1234567890" * 30,
]


@pytest.fixture(scope="module")
def public():
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(own, public, texts):
    offsets, ids = own.encode(texts)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == (public.encode_ordinary(t) if t else []), repr(t)[:80]


def test_ids_are_those_of_the_public_encoder(public):
    rng = random.Random(3)
    pool = [*map(chr, range(32, 127)), *"\n\t éüßñ€日本語あア", "​", "́", "😀"]
    some = ["".join(rng.choice(pool) for _ in range(rng.randrange(200))) for _ in range(300)]
    own = tokens.Encoder(PATH)
    same(own, public, TEXTS + some)
    same(own, public, some[::-1])  # from what was remembered


def test_forgetting_changes_nothing(public):
    own = tokens.Encoder(PATH, limit=3)
    for _ in range(3):
        same(own, public, TEXTS)


def test_matrix_and_heap_agree():
    own = tokens.Encoder(PATH)
    for word in (b"internationalization", b"aaaaaaaaaaaaaaaa", b" the", "ありがとう".encode()):
        ids = own.of_byte[list(word)][None, :].copy()
        merged = own.merge(ids)[0]
        assert merged[merged >= 0].tolist() == own.merge_long(word)


def test_column(spark, public):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(1, "", "x"), (None, "b", "y")], "doc_id bigint, text string, ids string")
    got = tokens.encode_texts(df, rows=3)
    assert got.columns == ["doc_id", "ids"] and got.count() == len(TEXTS) + 2
    by = {r["doc_id"]: r["ids"] for r in got.collect() if r["doc_id"] is not None}
    assert all(by[i] == (public.encode_ordinary(t) if t else []) for i, t in enumerate(TEXTS))
    assert tokens.encode_texts(df.limit(0)).count() == 0


def test_slices():
    assert list(slices([], 5)) == []
    assert list(slices(["aa", None, "bbbb", "c"], 10, 4)) == [(0, 2), (2, 3), (3, 4)]
    assert list(slices(["a"] * 5, 2, 100)) == [(0, 2), (2, 4), (4, 5)]

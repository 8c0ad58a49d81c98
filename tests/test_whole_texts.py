"""The queries over whole texts against brute force on a small fixture."""

import hashlib
import re

import pytest

from tests.conftest import rows
from weftmark import queries

FENCE = "`" * 3
TEXTS = {
    1: f"before\n# Setup 2.0: a heading of more than forty characters, with digits 1234567890\n\nRun `x = 1`!\n\n{FENCE}sh\n# no heading\n\nls -l\n{FENCE}\n\n## 日本語の見出し\n\n本文です。\n\n二つ目の段落。\n## Empty",
    2: "# A\n\n" + "\n\n".join(f"Paragraph {i}: " + "12 words, 34 % of them. " * 20 for i in range(9)) + "\n# A\n\nagain",
    3: "# Long\n\n" + " ".join(f"Sentence number {i} ends here." for i in range(2500)),
    4: "no heading at all, 100 %\n\nsecond",
    5: None,
    6: "",
}


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def split(text):
    """[(heading, body)] of a text with ATX headings and fences only."""
    out, fenced = [], False
    for line in (text or "").split("\n"):
        fenced ^= line.startswith(FENCE)
        if not fenced and re.match("#{1,6} ", line):
            out.append((line.lstrip("#").strip(), []))
        elif out:
            out[-1][1].append(line)
    return [(h, "\n".join(b).strip()) for h, b in out]


def parts(text):
    return [p.strip() for p in re.split(r"\n\s*\n", text or "") if p.strip()]


def sentences(paragraph):
    """A paragraph in runs of sentences of at most 8,000 estimated tokens."""
    def tokens(s):
        return -(-len(s.encode()) // 4)

    if tokens(paragraph) <= 8000:
        return [paragraph]
    runs = []
    for s in re.split(r"(?<=[.!?])\s+", paragraph):
        if runs and sum(map(tokens, runs[-1])) + tokens(s) <= 8000:
            runs[-1].append(s)
        else:
            runs.append([s])
    return [" ".join(r) for r in runs]


SECTIONS = [(str(d), n, h, b) for d, t in TEXTS.items() for n, (h, b) in enumerate(split(t))]


def test_sections(spark, base):
    got = rows(queries.QUERIES["q01_document_sections"](spark, base), "doc_file", "ordinal", "heading", "content")
    assert got == sorted(SECTIONS, key=repr) and len(got) == 6


def test_paragraphs(spark, base):
    got = rows(queries.QUERIES["q02_document_paragraphs"](spark, base))
    assert got == sorted(((d, n, k, p) for d, n, _, b in SECTIONS for k, p in enumerate(parts(b))), key=repr)


def test_chunks(spark, base):
    want, seen = [], {}
    for d, _, h, b in SECTIONS:
        made = []
        for p in [s for p in parts(b) for s in sentences(p)]:
            if made and sum(len(x) + 2 for x in made[-1]) + len(p) <= 2000:
                made[-1].append(p)
            else:
                made.append([p])
        for c in ["\n\n".join(m) for m in made] or [h]:
            k = seen[d, h] = seen.get((d, h), -1) + 1
            want.append((d, h, k, hashlib.sha256(f"{h}\n{b}".encode()).hexdigest(), c))
    got = rows(queries.QUERIES["q03_document_chunks"](spark, base), "doc_file", "heading", "chunk_index", "hash", "content")
    assert got == sorted(want, key=repr) and len(got) == 10


def test_sentences(spark, base):
    got = rows(queries.QUERIES["q04_document_sentences"](spark, base))
    want = [(str(d), n, k, s) for d, t in TEXTS.items() for n, p in enumerate(parts(t)) for k, s in enumerate(sentences(p))]
    assert got == sorted(want, key=repr) and any(k > 0 for _, _, k, _ in got)


def test_scores_of_pairs_without_a_common_run(spark, tmp_path):
    """Pairs that share single words are scored, though they share no run of three."""
    items = {1: "Alpha beta gamma delta", 2: "beta  beta omega", 3: None, 4: "zeta"}
    docs = {10: "gamma then alpha", 11: "gamma then alpha", 12: "alpha beta gamma", 13: "nothing", 14: None, 15: "x\nomega y"}
    spark.createDataFrame(list(items.items()), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def words(t):
        return {w for w in (t or "").lower().split(" ") if w}

    want = [(i, d, len(words(a) & words(b)) / len(words(a))) for i, a in items.items() for d, b in docs.items() if words(a) & words(b)]
    got = rows(queries.QUERIES["q10_scores_words"](spark, str(tmp_path)), "item_id", "doc_id", "score")
    assert got == sorted(want, key=repr) and (1, 10, 0.5) in got

import hashlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from weftmark.functions.markdown import get_section, is_code_label, parse_headings, replace_section, split_sections
from weftmark.operators import sections as sec


@pytest.mark.parametrize(
    "text, want",
    [
        ("# Title\n## Subtitle\n### Deep", [(1, "Title"), (2, "Subtitle"), (3, "Deep")]),
        ("Title\n=====\n\nSub\n---\n", [(1, "Title"), (2, "Sub")]),
        ("two\nlines\n===\n", [(1, "two\nlines")]),
        ("```\n# no\n```\n# yes", [(1, "yes")]),
        ("~~~~\n```\n# no\n~~~\n# no\n~~~~\n# yes #", [(1, "yes")]),
        ("    # code\n# yes ##", [(1, "yes")]),
        ("> # quoted\n\n- # item", [(1, "quoted"), (1, "item")]),
        ("#no\n####### no\n#\n", [(1, "")]),
        ("<!--\n# no\n-->\n# yes", [(1, "yes")]),
        ("<pre>\n# no\n</pre>\n# yes", [(1, "yes")]),
        ("<div>\n# no\n\n# yes", [(1, "yes")]),
        ("- a\n---\n***\n", []),
        ("", []),
        ("a\r\n===\r\n# b\r# c", [(1, "a"), (1, "b"), (1, "c")]),
        ("a\x0b# no # no", []),
    ],
)
def test_headings(text, want):
    assert [h[:2] for h in parse_headings(text)] == want


@pytest.mark.parametrize("text, want", [("`my_function()`", True), ("API Overview", False), ("``not this``", False), ("plain text", False)])
def test_code_label(text, want):
    assert is_code_label(text) is want


def test_sections_are_flat_and_skip_the_preamble():
    got = split_sections("before\n# A\n\nx\n\n## `fn()`\n\ny\n## B\n# C\nz")
    assert [(s[1], s[2]) for s in got] == [("A", "x\n\n## `fn()`\n\ny"), ("B", ""), ("C", "z")]


def test_lookup_and_replacement_act_on_the_first():
    text = "# Title\n\nOriginal content.\n\n## Other\n\nKeep.\n## Other\nmore"
    assert get_section(text, "Nonexistent") == ""
    assert get_section(text, "Other") == "Keep."
    new = replace_section(text, "Title", "New content.")
    assert new == "# Title\n\nNew content.\n\n## Other\n\nKeep.\n## Other\nmore"
    assert replace_section(text, "Nonexistent", "x") == text
    assert replace_section("# End", "End", "x") == "# End\n\nx\n\n"


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}.md", t, "extra") for i, t in enumerate(texts)], "doc_file string, text string, heading string")


def test_chunks_hash_and_numbering(spark):
    d = docs(spark, "# API Overview\n\nThis describes the API.\n\n## Endpoints\n\nGET /users\n", "# A\n\none\n\n# A\n\ntwo\n\n# Empty\n#\n", None, "")
    got = rows(sec.chunks(sec.sections(d)), "doc_file", "heading", "chunk_index", "hash", "content")

    def h(a, b):
        return hashlib.sha256(f"{a}\n{b}".encode()).hexdigest()

    assert got == [
        ("d0.md", "API Overview", 0, "c7c9973e8b4c48e587a9643fa64a3c82da8ba76ad14c27d0d17688c52024179b", "This describes the API."),
        ("d0.md", "Endpoints", 0, "37dafd50ab8020ec77b5495e4a2a33b3d80ba287ec885d3023a6e702ccbed453", "GET /users"),
        ("d1.md", "A", 0, h("A", "one"), "one"),
        ("d1.md", "A", 1, h("A", "two"), "two"),
        ("d1.md", "Empty", 0, h("Empty", ""), "Empty"),
    ]


def test_paragraphs_merge_and_split(spark):
    df = spark.createDataFrame(
        [("First paragraph.\n\nSecond paragraph.\n \nThird paragraph.",), ("  \n",), (" a\n\n\nb ",)], "t string"
    )
    p = sec.paragraphs(F.col("t"))
    assert [r[0] for r in df.select(p).collect()] == [["First paragraph.", "Second paragraph.", "Third paragraph."], [], ["a", "b"]]
    merged = [r[0] for r in df.select(sec.merge_paragraphs(p, max_length=35)).collect()]
    assert merged == [["First paragraph.\n\nSecond paragraph.", "Third paragraph."], [], ["a\n\nb"]]


def test_oversized_paragraph_splits_at_sentences(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(200))
    parts = spark.createDataFrame([(text,)], "t string").select(sec.pack_sentences(F.col("t"), 50)).first()[0]
    assert len(parts) > 1 and " ".join(parts) == text
    giant = "x" * 1000
    assert spark.createDataFrame([(giant,)], "t string").select(sec.pack_sentences(F.col("t"), 50)).first()[0] == [giant]


def test_headings_splice_and_lookup(spark):
    d = docs(spark, "# A\n\nold\n\n# B\n\nkeep", "# A\n\nother")
    assert rows(sec.headings(d), "doc_file", "ordinal", "text") == [("d0.md", 0, "A"), ("d0.md", 1, "B"), ("d1.md", 0, "A")]
    bodies = spark.createDataFrame([("d0.md", "A", "new"), ("d0.md", "gone", "x")], "doc_file string, heading string, body string")
    assert rows(sec.splice(d, bodies)) == [("d0.md", "# A\n\nnew\n\n# B\n\nkeep"), ("d1.md", "# A\n\nother")]
    assert rows(sec.point_lookup(sec.sections(d), "A")) == [("d0.md", "old"), ("d1.md", "other")]

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hgspark.functions.node_filter import filter_events, should_filter
from hgspark.functions.text import ChunkIndex, RecursiveSplitter, content_id, file_stem, preview, split_documents
from hgspark.plans.keywords import clean_keywords, simple_keywords


def test_content_ids(spark):
    df = spark.createDataFrame([("Hello, World!",), ("",)], "t string")
    assert [r[0] for r in df.select(content_id(F.col("t"))).collect()] == ["65a8e27d8879283831b664bd8b7f0ad4", "d41d8cd98f00b204e9800998ecf8427e"]


def test_short_and_empty_texts():
    assert RecursiveSplitter(100)("A short text.") == ["A short text."]
    assert RecursiveSplitter(100)("") == []


def test_paragraphs_lines_and_words():
    assert len(RecursiveSplitter(50)("First paragraph here.\n\nSecond paragraph here.\n\nThird paragraph here.")) >= 2
    assert len(RecursiveSplitter(30)("A line of text\nAnother line of it\nThe last line")) >= 2
    chunks = RecursiveSplitter(100)("word " * 50)
    assert all(len(c) <= 110 for c in chunks)


def test_overlap_is_applied_twice():
    assert RecursiveSplitter(20, 5)("Word1 Word2 Word3 Word4 Word5 Word6") == ["Word1 Word2 Word3 ", "ord3 ord3 Word4 Word5 ", "ord5 Word6"]


def test_bad_sizes():
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError, match="chunk size"):
            RecursiveSplitter(size, overlap)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=120), st.integers(1, 30))
def test_chunks_join_to_the_text_and_fit(text, size):
    chunks = RecursiveSplitter(size)(text)
    assert "".join(chunks) == text
    assert all(0 < len(c) <= size for c in chunks)


def test_separators_are_dropped_on_request():
    assert RecursiveSplitter(5, keep_separator=False, separators=["-"])("abc-def--ghi") == ["abc", "def", "ghi"]


def test_split_documents(spark):
    rng = random.Random(1)
    text = " ".join("x" * rng.randint(1, 9) for _ in range(300))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "one")], "doc_id long, text string")
    chunks = split_documents(docs, RecursiveSplitter(100))
    rows = sorted((r.doc_id, r.seq, r.text) for r in chunks.collect())
    assert "".join(t for d, _, t in rows if d == 1) == text
    assert {d for d, _, _ in rows} == {1, 4}


def test_previews_and_stems(spark):
    df = spark.createDataFrame([("a" * 5, "file:/x/y.tar.md"), ("a" * 6, "notes"), (None, ".hidden")], "t string, p string")
    assert [r[0] for r in df.select(preview(F.col("t"), 5)).collect()] == ["aaaaa", "aaaaa...", None]
    assert [r[0] for r in df.select(file_stem(F.col("p"))).collect()] == ["y.tar", "notes", ".hidden"]


def test_chunk_index(spark):
    index = ChunkIndex.from_dict(spark, {"a": "old", "b": "kept"})
    assert index.merge(ChunkIndex.from_dict(spark, {"a": "new"})).get("a") == "new"
    assert index.add("c", "x" * 300).preview("c") == "x" * 200 + "..."
    assert (index.count(), index.is_empty(), ChunkIndex.empty(spark).is_empty()) == (2, False, True)
    assert index.remove("a").get("a") is None
    chunks = spark.createDataFrame([(1, 1, "k", "second"), (1, 0, "k", "first")], "doc_id int, seq int, chunk_id string, text string")
    assert ChunkIndex.from_chunks(chunks).get("k") == "first"


def test_node_filter(spark):
    names = {"it": True, " IT ": True, "x": True, "": True, "they!": True, "Authors": True, "the method": False, "protein": False, "no one": True, "it 1": False}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.f for r in df.select("n", should_filter(F.col("n")).alias("f")).collect()}
    assert got == names


def test_event_filter(spark):
    df = spark.createDataFrame([((["silk", "it"], "binds", ["water"]),), ((["it"], "is", ["water"]),), ((["silk"], "is", ["they"]),)], "event struct<source: array<string>, relation: string, target: array<string>>")
    rows = filter_events(df).collect()
    assert [(list(r.event.source), r.event.relation, list(r.event.target)) for r in rows] == [(["silk"], "binds", ["water"])]


def test_keywords(spark):
    df = spark.createDataFrame([("What links Spider Silk to the strength of collagen? An ox.",)], "q string")
    # capitalised runs come in whatever they are
    assert df.select(simple_keywords(F.col("q"))).first()[0] == ["an", "collagen", "links", "silk", "spider", "spider silk", "strength", "what"]
    df = spark.createDataFrame([([" Silk", "silk\n", "x", "", "Web"],)], "k array<string>")
    assert df.select(clean_keywords(F.col("k"))).first()[0] == ["silk", "web"]

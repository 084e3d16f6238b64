import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hgspark.llm import token_output as K


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=400))
def test_elias_fano_round_trip(steps):
    values = np.cumsum(np.array(steps, dtype=np.int64)) if steps else np.empty(0, np.int64)
    e = K.EliasFano.encode(values)
    assert e.decode().tolist() == values.tolist()
    assert [e[i] for i in range(e.n)] == values.tolist()
    with pytest.raises(IndexError):
        e.select(e.n)


def test_large_and_constant_sequences():
    for values in ([0], [0, 0, 0], [2**40], [5] * 500 + [2**33] * 3, list(range(0, 10**6, 97))):
        e = K.EliasFano.encode(np.array(values))
        assert e.decode().tolist() == values
        assert e[e.n - 1] == values[-1]


def test_size_is_near_the_minimum():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    e = K.EliasFano.encode(values)
    bits = 8 * (len(e.lower) + len(e.upper) + len(e.samples))
    assert bits / len(values) < 2 + np.log2(values[-1] / len(values)) + 32 / K.SAMPLE + 1


def texts_of(rows):
    enc = K.load_tokenizer(K.TOKENIZER)
    return sorted(((d, enc.decode(K.document_tokens(r, i).tolist())) for r in rows for i, d in enumerate(r.doc_ids)), key=str)


@pytest.mark.parametrize("most", [50, 1 << 22])
def test_exact_round_trip(odd_docs, odd_rows, most):
    rows = K.token_shards(odd_docs, shard_tokens=most).collect()
    assert texts_of(rows) == sorted(((r[0], r[1] or "") for r in odd_rows), key=str)
    for r in rows:
        assert r.n_docs == len(r.doc_ids)
        assert len(r.token_ids) == 2 * r.n_tokens == 2 * K.boundaries(r)[r.n_docs - 1]
        assert r.n_tokens <= most or r.n_docs == 1


def test_special_names_are_ordinary_text(spark):
    df = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")
    row = K.token_shards(df).first()
    assert 50256 not in K.document_tokens(row, 0)
    assert texts_of([row]) == [(1, "a<|endoftext|>b")]


def test_empty_table(no_docs):
    assert K.token_shards(no_docs).count() == 0


def test_ids_of_long_runs_are_the_tokenizers():
    """Held against the tokenizer itself, on runs that it still can read."""
    enc = K.load_tokenizer(K.TOKENIZER)
    encode = K.encoder(enc)
    n = K.LONG_RUN
    for run in (" " * n, "\n" * (n + 3), " \t\u3000" * n, "\u00a0" * n, " " * (n - 1) + "\n"):
        for text in (run, run + "word", "word" + run, "a" + run + " b" + run + "9", run + "'s", "x" + run + "?!" + run[:50] + "y", run + "\x1c" + "z"):
            assert encode(text) == enc.encode_ordinary(text)
    rng = random.Random(3)
    for _ in range(30):
        text = "".join(rng.choice([" ", "\n", "ab", "7", "?", "\u2028"]) * rng.choice([1, 2, n, n + 1]) for _ in range(6))
        assert encode(text) == enc.encode_ordinary(text)


def test_texts_of_one_character(spark):
    """Ten million of each; equal to the tokenizer where that can read them."""
    enc = K.load_tokenizer(K.TOKENIZER)
    texts = [c * 10**7 for c in (" ", "\n", "a")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = K.token_shards(df).collect()
    got = {d: K.document_tokens(r, i) for r in rows for i, d in enumerate(r.doc_ids)}
    for k, text in enumerate(texts):
        assert enc.decode(got[k].tolist()) == text
    assert got[2].tolist() == enc.encode_ordinary(texts[2])

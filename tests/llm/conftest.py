import random

import pytest
from helpers import sentence

CLASHING = ["shard", "epoch", "block", "block_order", "vector", "node", "item_id", "fingerprint", "quality_probability", "keep", "toxicity", "is_toxic", "id", "entity", "start", "kept_doc_id", "group_size", "language", "token_ids", "n_windows", "SHARD_2", "bytes", "key"]


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source, n_chars) with nulls in every column, empty, blank and very long texts, repeated rows."""
    rng = random.Random(7)
    base = sentence(rng, 80)
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, None, "en", "b"), (4, "", None, "b"), (5, " \n\t ", "fr", None), (None, base, "en", None), (None, None, None, None), (6, sentence(rng, 60_000), "en", "c"), (7, "qwq", "en", "c"), (8, "...!!!", "de", "a"), (9, "x" * 50_000, "de", "a")]
    rows += [(i, sentence(rng, 30), "en", "abc"[i % 3]) for i in range(20, 30)]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with further columns that bear the names of results."""
    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("own").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

import random

import numpy as np
import pytest

from hgspark.llm import sharding as S


def expected(rows, n):
    """Shards from plain running sums."""
    total = sum(b for _, b in rows)
    out = {}
    for k, _ in rows:
        ahead = sum(b for q, b in rows if k is not None and (q is None or q < k))
        out[k] = 0 if k is None or not total else min(n - 1, ahead * n // total)
    return out


def test_exact_splitters_match_running_sums(spark):
    rng = random.Random(1)
    for n in (2, 5, 16):
        rows = [(rng.randrange(-(2**40), 2**40) if rng.random() < 0.5 else rng.randrange(30), rng.randrange(50)) for _ in range(150)] + [(None, 7)]
        df = spark.createDataFrame(rows, "k long, b long")
        splitters = S.find_splitters(df, n, probes=3)
        want = expected(rows, n)
        assert {k: (0 if k is None else int(np.searchsorted(splitters, k, "left"))) for k, _ in rows} == want


def test_extreme_keys(spark):
    rows = [(-(2**63) + 1, 10), (2**63 - 1, 10), (0, 10)]
    df = spark.createDataFrame(rows, "k long, b long")
    assert len(S.find_splitters(df, 3)) == 2


def test_tolerance_is_met(spark):
    rows = [(i * 1000, 100) for i in range(400)]
    s = S.find_splitters(spark.createDataFrame(rows, "k long, b long"), 8, tolerance=0.1)
    sizes = np.bincount(np.searchsorted(s, [k for k, _ in rows], "left"), weights=[b for _, b in rows])
    assert abs(sizes - 5000).max() <= 2 * 0.1 * 5000 + 100


def test_rows_of_a_shard_are_one_sorted_partition(spark, odd_docs, odd_rows):
    from pyspark.sql import functions as F

    out = S.shard_by_bytes(odd_docs, n_shards=4)
    rows = out.select("doc_id", "shard", F.spark_partition_id().alias("p")).collect()
    assert len(rows) == len(odd_rows)
    assert all(r.p == r.shard for r in rows)
    size = [(r[0], len((r[1] or "").encode())) for r in odd_rows]
    assert {(r.doc_id, r.shard) for r in rows} == set(expected(size, 4).items())
    for p in range(4):
        keys = [r.doc_id for r in rows if r.p == p]
        assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert out.columns == [c for c in odd_docs.columns if c != "shard"] + ["shard"]


def test_nothing_to_shard(spark, no_docs):
    assert S.shard_by_bytes(no_docs).count() == 0
    empty = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert {r.shard for r in S.shard_by_bytes(empty).collect()} == {0}


def test_few_probes_a_round_find_the_same(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(-(2**11), 2**11), rng.randrange(90)) for _ in range(120)]
    df = spark.createDataFrame(rows, "k long, b long")
    assert (S.find_splitters(df, 9, most_probes=1) == S.find_splitters(df, 9)).all()


def test_bytes_without_a_key_come_first(spark):
    rows = [(None, 500), (1, 10), (2, 90), (3, 400)]
    s = S.find_splitters(spark.createDataFrame(rows, "k long, b long"), 10)
    assert {k: 0 if k is None else int(np.searchsorted(s, k, "left")) for k, _ in rows} == expected(rows, 10)


def test_partitions_may_hold_several_shards(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i % 50, "x" * (i % 7)) for i in range(200)], "doc_id long, text string")
    one, few = (S.shard_by_bytes(df, n_shards=11, most_partitions=m) for m in (50, 4))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, few.collect()))
    rows = few.select("doc_id", "shard", F.spark_partition_id().alias("p")).collect()
    assert all(r.p == r.shard // 3 for r in rows)
    for p in range(4):
        assert [r.doc_id for r in rows if r.p == p] == sorted(r.doc_id for r in rows if r.p == p)


def test_keys_of_other_types_are_refused(spark):
    with pytest.raises(TypeError, match="integer"):
        S.shard_by_bytes(spark.createDataFrame([("a", "b")], "doc_id string, text string"))

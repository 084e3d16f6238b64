import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hgspark.operators import vectors as V
from hgspark.operators.embeddings import EmbeddingService, NodeEmbeddings, without_suffixes
from hgspark.sources.providers import HashingEmbedder


def pair(spark, a, b):
    return spark.createDataFrame([(a, b)], "a array<float>, b array<float>")


def one(df, column):
    return df.select(column).first()[0]


def test_cosine(spark):
    a, b = F.col("a"), F.col("b")
    for x, y, want in (([1, 2], [1, 2], 1), ([1, 0], [0, 1], 0), ([1, 2], [-1, -2], -1)):
        df = pair(spark, [float(v) for v in x], [float(v) for v in y])
        assert one(df, V.cosine_strict(a, b)) == pytest.approx(want, abs=1e-6)
        assert one(df, V.cosine(a, b)) == pytest.approx(want, abs=1e-6)
    for x, y in (([0.0, 0.0], [1.0, 0.0]), ([], [])):
        assert one(pair(spark, x, y), V.cosine_strict(a, b)) == 0
        assert one(pair(spark, x, y), V.cosine(a, b)) is None
    assert one(pair(spark, [1.0], [1.0, 2.0]), V.cosine(a, b)) is None
    with pytest.raises(Exception, match="dimension"):
        one(pair(spark, [1.0], [1.0, 2.0]), V.cosine_strict(a, b))


def test_distance_and_normalize(spark):
    df = pair(spark, [3.0, 4.0], [0.0, 0.0])
    assert one(df, V.l2_distance(F.col("a"), F.col("b"))) == pytest.approx(5)
    assert one(df, V.normalize(F.col("a"))) == pytest.approx([0.6, 0.8])
    assert one(df, V.normalize(F.col("b"))) == [0, 0]
    assert one(pair(spark, [], []), V.l2_distance(F.col("a"), F.col("b"))) == 0
    assert one(pair(spark, [], []), V.normalize(F.col("a"))) == []


def test_pairs_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(V, "BLOCK_ROWS", 7)
    x = rng.normal(size=(40, 5)).astype(np.float32)
    x[3] = 0
    e = NodeEmbeddings.from_dict(spark, {f"n{i:02}": v.tolist() for i, v in enumerate(x)})
    y = x.astype(np.float64)
    sim = y @ y.T / np.maximum(np.outer(*[np.linalg.norm(y, axis=1)] * 2), 1e-300)
    want = {(f"n{i:02}", f"n{j:02}") for i in range(40) for j in range(i + 1, 40) if sim[i, j] > 0.3}
    assert {(r.i, r.j) for r in V.similar_pairs(e.df, 0.3).collect()} == want
    assert V.similarity_matrix(e.df).count() == 1600
    low = {(r.i, r.j) for r in e.similar_pairs(-2.0).collect()}
    assert len(low) == 39 * 38 / 2


def test_strict_and_inclusive_thresholds(spark):
    e = NodeEmbeddings.from_dict(spark, {"a": [1, 0], "b": [1, 0], "c": [0, 1]})
    assert [(r.i, r.j) for r in V.similar_pairs(e.df, 1.0).collect()] == []
    assert [(r.i, r.j) for r in e.similar_pairs(1.0).collect()] == [("a", "b")]


def test_most_similar_pair_comes_first(spark):
    e = NodeEmbeddings.from_dict(spark, {"a": [1, 0, 0], "b": [0.99, 0.1, 0], "c": [0, 1, 0], "d": [0, 0, 1]})
    assert [(r.i, r.j) for r in V.similar_pairs(e.df, 0.9).orderBy(F.desc("similarity")).collect()] == [("a", "b")]


def test_search(spark):
    e = NodeEmbeddings.from_dict(spark, {"A": [1, 0], "B": [0.9, 0.1], "C": [0, 1], "D": [-1, 0]})
    assert [r.node for r in e.find_similar_to_node("A", 2).collect()] == ["B", "C"]
    assert [r.node for r in e.find_similar([1, 0]).collect()] == ["A", "B", "C"]
    assert [r.node for r in V.top_k_similar(e.df, [1, 0], 4).collect()] == ["A", "B", "C", "D"]
    assert e.find_similar_to_node("no").count() == 0
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("z", [0.0, 0.0])], "query string, vector array<double>")
    assert [(r.query, r.node) for r in V.top_k_batch(q, e.df, 2, 0.0).orderBy("similarity").collect()] == [("q", "B"), ("q", "A")]


def test_any_number_of_queries(spark):
    e = NodeEmbeddings.from_dict(spark, {"A": [1, 0], "B": [0.9, 0.1], "C": [0, 1], "D": [1, 0]})
    q = spark.range(100_001).select(F.col("id").alias("query"), F.when(F.col("id") % 2 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(2.0))).alias("vector"))
    got = V.top_k_batch(q, e.df, 2, 0.5).groupBy(F.col("query") % 2, "node").count().collect()
    assert {tuple(r) for r in got} == {(0, "A", 50_001), (0, "D", 50_001), (1, "C", 50_000)}


def test_batch_in_cells_is_as_in_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (60, 3)).astype(float).tolist()  # many ties and zero vectors
    e = spark.createDataFrame([(f"n{i:02}", v) for i, v in enumerate([*x, [], [1.0, 1.0]])] + [(None, [1.0, 2.0, 2.0])], "node string, embedding array<double>").repartition(3)
    q = e.select(F.col("node").alias("query"), F.col("embedding").alias("vector"))
    rounded = lambda df: sorted(((r.query or "", r.node or "", round(r.similarity, 6)) for r in df.collect()))
    want = rounded(V.top_k_batch(q, e, 4, 0.1))
    monkeypatch.setattr(V, "BLOCK_ROWS", 7)
    monkeypatch.setattr(V, "BAND_BLOCKS", 2)
    assert [r[::2] for r in rounded(V.top_k_batch(q, e, 4, 0.1))] == [r[::2] for r in want]
    assert len(want) > 200


def test_table_operations(spark):
    e = NodeEmbeddings.from_dict(spark, {"A": [1, 0], "B": [0, 1]})
    nodes = spark.createDataFrame([("A",), ("X",)], "node string")
    assert [r.node for r in e.filtered(nodes).df.collect()] == ["A"]
    assert [r.node for r in e.missing(nodes).collect()] == ["X"]
    assert e.merge(NodeEmbeddings.from_dict(spark, {"A": [5, 5]})).get("A") == [5, 5]
    assert e.remove(["A"]).count() == 1
    assert e.set("Z", [1, 1]).count() == 3
    assert (e.dimension(), NodeEmbeddings.empty(spark).dimension()) == (2, 0)
    assert e.get("no") is None
    assert math.isclose(e.similarity("A", "B"), 0)


def test_service(spark):
    s = EmbeddingService(HashingEmbedder(16), batch=2)
    nodes = spark.createDataFrame([("apple",), ("apples",), ("stone",), (None,)], "node string")
    e = s.generate(nodes)
    assert e.count() == 3
    assert s.find_similar_nodes("apple", e, 2).first().node == "apple"
    other = NodeEmbeddings.from_dict(spark, {"old": [1.0] * 16, "apple": [0.0] * 16})
    assert s.ensure(nodes.where("node is not null"), other).get("apple") == [0.0] * 16
    assert sorted(r.node for r in s.update(nodes, other).df.collect()) == ["apple", "apples", "stone"]
    assert s.update(nodes, other, prune_orphans=False).count() == 4
    assert [r.node for r in without_suffixes(nodes, ["s", "ne"]).collect()] == ["apple"]


def test_a_task_holds_a_tile_of_similarities(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"n{i:02}", v) for i, v in enumerate(rng.integers(-2, 3, (60, 3)).astype(float).tolist())]
    e = spark.createDataFrame([*rows, ("odd", []), ("two", [1.0, 1.0]), ("none", None)], "node string, embedding array<double>").repartition(3)
    unit = [np.array(v) / (np.linalg.norm(v) or 1) for _, v in rows]
    want = {(f"n{a:02}", f"n{b:02}") for a in range(60) for b in range(a + 1, 60) if unit[a] @ unit[b] > 0.123}
    monkeypatch.setattr(V, "BLOCK_ROWS", 16)
    monkeypatch.setattr(V, "TILE", 50)
    monkeypatch.setattr(V, "BATCH_ROWS", 9)
    assert {(r.i, r.j) for r in V.similar_pairs(e, 0.123).collect()} == want
    totals = {r.i: (r.n, round(r.total, 6)) for r in V.similarity_totals(e).collect()}
    whole = V.similarity_matrix(e).groupBy("i").agg(F.count("*").alias("n"), F.sum("similarity").alias("t")).collect()
    assert totals == {r.i: (r.n, round(r.t, 6)) for r in whole} and totals["odd"] == (1, 0.0) and totals["n00"][0] == 60
    cells = [pa.RecordBatch.from_pylist([{"names": ["a"] * 16, "numbers": np.ones((16, 2)).tobytes(), "dimension": 2, "block": 0, "band": 0, "side": k} for k in (0, 1)])]
    assert [(m[4], m[5].shape) for m in V._meetings(iter(cells), 0.0)] == [(s, (min(3, 16 - s), 16)) for s in range(0, 16, 3)]


def test_totals_take_no_row_for_each_pair(spark):
    e = spark.range(600).select(F.col("id").cast("string").alias("node"), F.array(F.sin("id"), F.cos("id")).alias("embedding")).repartition(2)
    found = V.similarity_totals(e)
    rows = found.collect()
    cells = V._grid(e).groupBy("row", "column").count().count()
    assert {r.n for r in rows} == {600} and len(rows) == 600
    out = spark.createDataFrame(rows).agg(F.sum("n")).first()[0]
    assert out == 600 * 600 and cells * 2 * V.BLOCK_ROWS < out

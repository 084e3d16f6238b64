"""The hypergraph: unique (edge_id, node) pairs and all edge ids, so that empty edges exist too.

Every operator returns new lazy DataFrames. The pair table is canonical: filters on it reach the scan, and no operator
needs an edge's nodes in one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

INCIDENCE = T.StructType([T.StructField("edge_id", T.StringType()), T.StructField("node", T.StringType())])


def _over_batches(predicate: Callable[[str, list], bool]) -> Callable[..., Column]:
    @F.arrow_udf("boolean")
    def test(edge_ids: pa.Array, nodes: pa.Array) -> pa.Array:
        return pa.array([bool(predicate(e, n)) for e, n in zip(edge_ids.to_pylist(), nodes.to_pylist(), strict=True)], pa.bool_())

    return test


class Hypergraph:
    def __init__(self, incidence: DataFrame, edge_ids: DataFrame | None = None):
        """`incidence` must hold each pair once; `edge_ids` (default: those of the pairs) every edge once."""
        self.incidence = incidence.select("edge_id", "node")
        self.edge_ids = edge_ids.select("edge_id") if edge_ids is not None else self.incidence.select("edge_id").distinct()

    # constructors

    @staticmethod
    def empty(spark: SparkSession) -> Hypergraph:
        pairs = spark.createDataFrame([], INCIDENCE)
        return Hypergraph(pairs, pairs.select("edge_id"))

    @staticmethod
    def from_incidence(pairs: DataFrame, edge_ids: DataFrame | None = None) -> Hypergraph:
        """From pairs that may repeat or have nulls (these are left out)."""
        known = pairs.select("edge_id", "node").where("edge_id is not null and node is not null").distinct()
        return Hypergraph(known, edge_ids.select("edge_id").distinct() if edge_ids is not None else None)

    @staticmethod
    def from_edges(edges: DataFrame) -> Hypergraph:
        """From (edge_id, nodes array); an empty array is an empty edge."""
        pairs = edges.select("edge_id", F.explode("nodes").alias("node"))
        return Hypergraph.from_incidence(pairs, edges)

    @staticmethod
    def from_dict(spark: SparkSession, incidence: dict[str, Iterable[str]]) -> Hypergraph:
        rows = [(e, list(n)) for e, n in incidence.items()]
        return Hypergraph.from_edges(spark.createDataFrame(rows, "edge_id string, nodes array<string>"))

    # projections and lookups

    def nodes(self) -> DataFrame:
        return self.incidence.select("node").distinct()

    def edges(self) -> DataFrame:
        """(edge_id, nodes): the nested view, nodes sorted."""
        held = self.incidence.groupBy("edge_id").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
        kind = self.incidence.schema["node"].dataType
        return self.edge_ids.join(held, "edge_id", "left").select("edge_id", F.coalesce("nodes", F.array().cast(T.ArrayType(kind))).alias("nodes"))

    def adjacency_lists(self) -> DataFrame:
        """(node, edge_ids)"""
        return self.incidence.groupBy("node").agg(F.sort_array(F.collect_list("edge_id")).alias("edge_ids"))

    def node_count(self) -> int:
        return self.nodes().count()

    def edge_count(self) -> int:
        return self.edge_ids.count()

    def nodes_in(self, edge_id) -> list | None:
        """The edge's nodes, sorted; None if there is no such edge."""
        if self.edge_ids.where(F.col("edge_id") == edge_id).isEmpty():
            return None
        return sorted(r.node for r in self.incidence.where(F.col("edge_id") == edge_id).collect())

    def size_of(self, edge_id) -> int:
        return self.incidence.where(F.col("edge_id") == edge_id).count()

    def degree_of(self, node) -> int:
        return self.incidence.where(F.col("node") == node).count()

    def sizes(self) -> DataFrame:
        """(edge_id, size) of every edge."""
        held = self.incidence.groupBy("edge_id").agg(F.count("*").alias("size"))
        return self.edge_ids.join(held, "edge_id", "left").select("edge_id", F.coalesce("size", F.lit(0)).alias("size"))

    def degrees(self) -> DataFrame:
        """(node, degree)"""
        return self.incidence.groupBy("node").agg(F.count("*").alias("degree"))

    def size_distribution(self) -> DataFrame:
        """(size, n_edges)"""
        return self.sizes().groupBy("size").agg(F.count("*").alias("n_edges"))

    def top_nodes(self, k: int = 10, label_chars: int = 40) -> DataFrame:
        """(node, degree, label) of the k nodes of highest degree, ties by name; long names are cut in the label."""
        top = self.degrees().orderBy(F.desc("degree"), "node").limit(k)
        text = F.col("node").cast("string")
        short = F.concat(F.substring(text, 1, label_chars - 3), F.lit("..."))
        return top.select("node", "degree", F.when(F.length(text) > label_chars, short).otherwise(text).alias("label"))

    # neighbourhoods

    def neighbors(self, node) -> DataFrame:
        """(node): those that share an edge with `node`."""
        own = self.incidence.where(F.col("node") == node).select("edge_id")
        return self.incidence.join(own, "edge_id", "left_semi").where(F.col("node") != node).select("node").distinct()

    def adjacency(self) -> DataFrame:
        """(src, dst): distinct ordered pairs that share an edge. An edge of k nodes gives k * (k - 1) of them. Each pair is
        made and told apart in one order only."""
        a = self.incidence.select("edge_id", F.col("node").alias("src"))
        b = self.incidence.select("edge_id", F.col("node").alias("dst"))
        half = a.join(b, "edge_id").where("src < dst").select("src", "dst").distinct()
        return half.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))

    def edges_with_both(self, pairs: DataFrame) -> DataFrame:
        """`pairs` (u, v, ...) with every edge that holds both, from the edges of the end that has fewer: a node of many
        edges costs its pairs what their other ends have."""
        d = self.degrees()
        left = pairs.join(d.select(F.col("node").alias("u"), F.col("degree").alias("__u")), "u")
        placed = left.join(d.select(F.col("node").alias("v"), F.col("degree").alias("__v")), "v")
        fewer = F.col("__u") <= F.col("__v")
        placed = placed.select(*pairs.columns, F.when(fewer, F.col("u")).otherwise(F.col("v")).alias("__few"), F.when(fewer, F.col("v")).otherwise(F.col("u")).alias("__many"))
        one = placed.join(self.incidence.select("edge_id", F.col("node").alias("__few")), "__few")
        both = one.join(self.incidence.select("edge_id", F.col("node").alias("__many")), ["edge_id", "__many"])
        return both.select("edge_id", *pairs.columns)

    # filters

    def filter_edges(self, predicate: Column | Callable[[str, list], bool]) -> Hypergraph:
        """Whole edges for which a Column over (edge_id, nodes), or a Python function, is true."""
        test = predicate if isinstance(predicate, Column) else _over_batches(predicate)("edge_id", "nodes")
        return self.restrict_to_edges(self.edges().where(test).select("edge_id"))

    def filter_by_size(self, least: int) -> Hypergraph:
        if least <= 0:
            return self
        kept = self.incidence.groupBy("edge_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("edge_id")
        return Hypergraph(self.incidence.join(kept, "edge_id", "left_semi"), kept)

    def restrict_to_nodes(self, nodes: DataFrame) -> Hypergraph:
        """Edges cut down to the given nodes; those left with none go."""
        return Hypergraph(self.incidence.join(nodes.select("node"), "node", "left_semi"))

    def subhypergraph(self, nodes: DataFrame) -> Hypergraph:
        return self.restrict_to_nodes(nodes)

    def restrict_to_edges(self, edge_ids: DataFrame) -> Hypergraph:
        kept = edge_ids.select("edge_id")
        return Hypergraph(self.incidence.join(kept, "edge_id", "left_semi"), self.edge_ids.join(kept, "edge_id", "left_semi"))

    def remove_node(self, node) -> Hypergraph:
        """Without the node; edges that held nothing else go, edges that were empty before stay."""
        left = self.incidence.where(F.col("node") != node)
        emptied = self.incidence.where(F.col("node") == node).select("edge_id").join(left.select("edge_id"), "edge_id", "left_anti")
        return Hypergraph(left, self.edge_ids.join(emptied, "edge_id", "left_anti"))

    def remove_edge(self, edge_id) -> tuple[Hypergraph, list | None]:
        """The rest, and the removed edge's nodes (None if it wasn't there)."""
        other = F.col("edge_id") != edge_id
        return Hypergraph(self.incidence.where(other), self.edge_ids.where(other)), self.nodes_in(edge_id)

    def add_edge(self, edge_id, nodes: Iterable) -> Hypergraph:
        """With the edge; one of the same id is replaced, not merged."""
        spark, other = self.incidence.sparkSession, F.col("edge_id") != edge_id
        pairs = spark.createDataFrame([(edge_id, n) for n in set(nodes)], self.incidence.schema)
        own = spark.createDataFrame([(edge_id,)], self.edge_ids.schema)
        return Hypergraph(self.incidence.where(other).unionByName(pairs), self.edge_ids.where(other).unionByName(own))

    def replace_edges(self, edges: Hypergraph) -> Hypergraph:
        """add_edge for many edges at once."""
        kept = self.restrict_to_edges(self.edge_ids.join(edges.edge_ids, "edge_id", "left_anti"))
        return Hypergraph(kept.incidence.unionByName(edges.incidence), kept.edge_ids.unionByName(edges.edge_ids))

    # set operations

    def union(self, *others: Hypergraph) -> Hypergraph:
        """Edges of the same id have their node sets merged."""
        pairs, ids = self.incidence, self.edge_ids
        for o in others:
            pairs, ids = pairs.unionByName(o.incidence), ids.unionByName(o.edge_ids)
        return Hypergraph(pairs.distinct(), ids.distinct())

    def intersect(self, other: Hypergraph) -> Hypergraph:
        """Edges both have, with the nodes both give them (an addition of this library)."""
        return Hypergraph(self.incidence.join(other.incidence, ["edge_id", "node"], "left_semi"), self.edge_ids.join(other.edge_ids, "edge_id", "left_semi"))

    def same_as(self, other: Hypergraph) -> bool:
        pairs = ((self.incidence, other.incidence), (self.edge_ids, other.edge_ids))
        return all(a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() for a, b in pairs)

    def first_edges(self, per_node: int) -> DataFrame:
        """(node, edge_id): at most `per_node` edges of each node, the smallest ids."""
        turn = Window.partitionBy("node").orderBy("edge_id")
        return self.incidence.select("node", "edge_id", F.row_number().over(turn).alias("k")).where(F.col("k") <= per_node).select("node", "edge_id")

    def describe(self) -> str:
        return f"Hypergraph(nodes: {self.node_count()}, edges: {self.edge_count()})"

"""Node vectors: a table (node, embedding array<float>) with one row a node, and services that make them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EMBEDDING_BATCH, EMBEDDING_MODEL
from ..sources.providers import EmbeddingProvider
from . import vectors

SCHEMA = T.StructType([T.StructField("node", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


class NodeEmbeddings:
    def __init__(self, df: DataFrame):
        self.df = df.select("node", "embedding")

    @staticmethod
    def empty(spark: SparkSession) -> NodeEmbeddings:
        return NodeEmbeddings(spark.createDataFrame([], SCHEMA))

    @staticmethod
    def from_dict(spark: SparkSession, items: dict[str, list[float]]) -> NodeEmbeddings:
        return NodeEmbeddings(spark.createDataFrame([(n, [float(x) for x in v]) for n, v in items.items()], SCHEMA))

    def count(self) -> int:
        return self.df.count()

    def dimension(self) -> int:
        """Length of the first node's vector by name; 0 without vectors."""
        row = self.df.orderBy("node").select(F.size("embedding")).first()
        return row[0] if row else 0

    def get(self, node) -> list[float] | None:
        row = self.df.where(F.col("node") == node).select("embedding").first()
        return row[0] if row else None

    def set(self, node, vector: list[float]) -> NodeEmbeddings:
        own = self.df.sparkSession.createDataFrame([(node, [float(x) for x in vector])], SCHEMA)
        return self.merge(NodeEmbeddings(own))

    def remove(self, nodes: Iterable | DataFrame) -> NodeEmbeddings:
        gone = nodes if isinstance(nodes, DataFrame) else self.df.sparkSession.createDataFrame([(n,) for n in nodes], "node string")
        return NodeEmbeddings(self.df.join(gone.select("node"), "node", "left_anti"))

    def merge(self, other: NodeEmbeddings) -> NodeEmbeddings:
        """The other's vectors win."""
        return NodeEmbeddings(self.df.join(other.df, "node", "left_anti").unionByName(other.df))

    def filtered(self, nodes: DataFrame) -> NodeEmbeddings:
        return NodeEmbeddings(self.df.join(nodes.select("node"), "node", "left_semi"))

    prune = filtered

    def missing(self, nodes: DataFrame) -> DataFrame:
        """(node): those without a vector."""
        return nodes.select("node").distinct().join(self.df, "node", "left_anti")

    def similarity(self, a, b) -> float | None:
        x, y = self.df.where(F.col("node") == a).select(F.col("embedding").alias("x")), self.df.where(F.col("node") == b).select(F.col("embedding").alias("y"))
        row = x.crossJoin(y).select(vectors.cosine(F.col("x"), F.col("y"))).first()
        return row[0] if row else None

    def find_similar(self, vector: list[float], k: int = 10, threshold: float = 0.0) -> DataFrame:
        return vectors.find_similar(self.df, vector, k, threshold)

    def find_similar_to_node(self, node, k: int = 10, threshold: float = 0.0) -> DataFrame:
        return vectors.find_similar_to_node(self.df, node, k, threshold)

    def similar_pairs(self, threshold: float) -> DataFrame:
        """(i, j, similarity) at or above the threshold, pairs of undefined similarity left out."""
        return vectors.similar_pairs(self.df, threshold, strict=False, zero_undefined=False)


class EmbeddingService:
    """Makes vectors with a provider, a client for each task, `batch` texts a request."""

    def __init__(self, provider: EmbeddingProvider, model: str = EMBEDDING_MODEL, batch: int = EMBEDDING_BATCH):
        self.provider, self.model, self.batch = provider, model, batch

    def generate(self, nodes: DataFrame) -> NodeEmbeddings:
        """One vector for each distinct node; texts that the provider gives no vector for are left out."""
        provider, model, size = self.provider, self.model, max(1, self.batch)

        def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                texts = rows.column(0).to_pylist()
                for k in range(0, len(texts), size):
                    part = texts[k : k + size]
                    kept = [(t, [float(x) for x in v]) for t, v in zip(part, provider.embed(part, model), strict=False) if v]
                    yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in kept], pa.string()), pa.array([v for _, v in kept], pa.list_(pa.float32()))], names=["node", "embedding"])

        return NodeEmbeddings(nodes.select(F.col("node").cast("string")).where("node is not null").distinct().mapInArrow(embed, SCHEMA))

    def ensure(self, nodes: DataFrame, existing: NodeEmbeddings) -> NodeEmbeddings:
        """The existing vectors and new ones for nodes that have none."""
        return existing.merge(self.generate(existing.missing(nodes)))

    def update(self, nodes: DataFrame, existing: NodeEmbeddings, prune_orphans: bool = True) -> NodeEmbeddings:
        full = self.ensure(nodes, existing)
        return full.filtered(nodes) if prune_orphans else full

    def find_similar_nodes(self, text: str, embeddings: NodeEmbeddings, k: int = 10, threshold: float = 0.0) -> DataFrame:
        found = self.provider.embed([text], self.model)
        if not found or not found[0]:
            raise ValueError("the provider gave no vector")
        return embeddings.find_similar(list(found[0]), k, threshold)


def without_suffixes(nodes: DataFrame, suffixes: Iterable[str]) -> DataFrame:
    """Nodes that end in none of the suffixes (case matters)."""
    bad: Column = F.lit(False)
    for s in suffixes:
        bad = bad | F.col("node").endswith(s)
    return nodes.where(~bad)

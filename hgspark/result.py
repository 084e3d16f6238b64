"""What processing of documents gives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .functions.events import METADATA
from .functions.text import ChunkIndex
from .operators.embeddings import NodeEmbeddings
from .operators.hypergraph import Hypergraph


@dataclass
class ProcessingResult:
    graph: Hypergraph
    metadata: DataFrame
    embeddings: NodeEmbeddings
    chunk_index: ChunkIndex
    document_id: str | None = None

    @staticmethod
    def empty(spark: SparkSession) -> ProcessingResult:
        return ProcessingResult(Hypergraph.empty(spark), spark.createDataFrame([], METADATA), NodeEmbeddings.empty(spark), ChunkIndex.empty(spark))

    def save(self, folder: str, format: str = "json") -> None:
        from .sources.files import save_result

        save_result(self, folder, format)

    def describe(self) -> str:
        return f"ProcessingResult({self.graph.describe()}, rows: {self.metadata.count()}, vectors: {self.embeddings.count()}, chunks: {self.chunk_index.count()})"

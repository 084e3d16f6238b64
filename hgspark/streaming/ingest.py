"""Continuous ingest: a stream of documents becomes pairs of a growing graph.

Merging graphs is commutative, associative and idempotent, so each batch appends its pairs and edge ids, and reading
makes them distinct. A batch that is repeated after a failure overwrites its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.hypergraph import Hypergraph
from ..plans.extraction import HypergraphExtractor


def append_batch(pairs: DataFrame, edge_ids: DataFrame, folder: str, batch: int) -> None:
    pairs.write.mode("overwrite").parquet(f"{folder}/incidence/batch={batch}")
    edge_ids.write.mode("overwrite").parquet(f"{folder}/edge_ids/batch={batch}")


def ingest(docs: DataFrame, extractor: HypergraphExtractor, folder: str, checkpoint: str, *, id_col: str = "doc_id", text_col: str = "text", **trigger) -> StreamingQuery:
    """Starts a query that extracts each batch of streamed documents and appends it under `folder`."""

    def each(batch: DataFrame, number: int) -> None:
        graph, *_ = extractor.from_documents(batch, id_col=id_col, text_col=text_col)
        append_batch(graph.incidence, graph.edge_ids, folder, number)

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_graph(spark: SparkSession, folder: str) -> Hypergraph:
    pairs, ids = (spark.read.parquet(f"{folder}/{n}").drop("batch").distinct() for n in ("incidence", "edge_ids"))
    return Hypergraph(pairs, ids)


def stream_degrees(pairs: DataFrame, time_col: str = "ts", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, node, degree): new pairs a node gets in each window of a stream (edge_id, node, time)."""
    timed = pairs.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    return timed.groupBy(F.window(time_col, every), "node").agg(F.approx_count_distinct("edge_id").alias("degree"))

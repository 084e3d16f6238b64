"""Merging of nodes whose vectors are nearly equal.

Pairs above a threshold are taken in the order (similarity down, i up, j up). A pair is skipped if one of its nodes was
removed before; otherwise the node of higher degree (in the graph as given; the first by name of equals) stays and the
other is removed. Renaming follows one step only, so a node that absorbs another and is removed later comes back in the
other's place; `transitive` follows all steps instead.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import MERGE_THRESHOLD, MIN_EDGE_SIZE
from ..tables import cut, sized
from .embeddings import EmbeddingService, NodeEmbeddings, without_suffixes
from .hypergraph import Hypergraph
from .vectors import similar_pairs

HISTORY = T.StructType([T.StructField("seq", T.IntegerType()), T.StructField("kept_node", T.StringType()), T.StructField("removed_node", T.StringType()), T.StructField("similarity", T.DoubleType()), T.StructField("kept_degree", T.LongType()), T.StructField("removed_degree", T.LongType())])
#: Pairs up to which one task makes the greedy pass; beyond it rounds do, each over about as many of the best pairs left.
ONE_TASK_PAIRS = 200_000
ROUND_PAIRS = 1_000_000


@dataclass
class SimplificationResult:
    graph: Hypergraph
    embeddings: NodeEmbeddings
    history: DataFrame
    merge_count: int
    nodes_removed: int
    edges_removed: int


def merge_candidates(graph: Hypergraph, embeddings: NodeEmbeddings, threshold: float = MERGE_THRESHOLD, exclude_suffixes: Iterable[str] = ()) -> DataFrame:
    """(i, j, similarity): pairs of the graph's nodes above the threshold, i < j."""
    eligible = without_suffixes(graph.nodes(), exclude_suffixes)
    return similar_pairs(embeddings.filtered(eligible).df, threshold)


def _with_degrees(pairs: DataFrame, graph: Hypergraph) -> DataFrame:
    d = sized(cut(graph.degrees()))
    left = pairs.join(d.select(F.col("node").alias("i"), F.col("degree").alias("degree_i")), "i", "left")
    both = left.join(d.select(F.col("node").alias("j"), F.col("degree").alias("degree_j")), "j", "left")
    return both.select("i", "j", "similarity", F.coalesce("degree_i", F.lit(0)).cast("long").alias("degree_i"), F.coalesce("degree_j", F.lit(0)).cast("long").alias("degree_j"))


def greedy_one_task(pairs: DataFrame, first: int = 0) -> DataFrame:
    """The merge history from pairs with degrees, numbered from `first`: Spark sorts them in one partition, through which a
    task passes batch by batch; it holds the names removed and no pairs."""

    def scan(batches):
        removed, n = set(), first
        for batch in batches:
            rows = []
            for i, j, s, di, dj in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i in removed or j in removed:
                    continue
                kept, gone, dk, dg = (i, j, di, dj) if di >= dj else (j, i, dj, di)
                removed.add(gone)
                rows.append((n, kept, gone, s, dk, dg))
                n += 1
            if rows:
                kinds = (pa.int32(), batch.column(0).type, batch.column(1).type, pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=HISTORY.names)

    turn = pairs.select("i", "j", "similarity", "degree_i", "degree_j").coalesce(1).sortWithinPartitions(F.desc("similarity"), "i", "j")
    return turn.mapInArrow(scan, HISTORY)


def greedy_rounds(pairs: DataFrame, most: int = ROUND_PAIRS) -> DataFrame:
    """The same history by rounds: the best pairs left, about `most` and all of equal similarity, are decided in one task,
    and those of the rest whose nodes are removed go. Most pairs go so without being sorted."""
    left, decided, done = cut(pairs), [], 0
    while True:
        n = left.count()
        low = left.approxQuantile("similarity", [1 - most / n], 0.1 * most / n)[0] if n > most else None
        band = left if low is None else left.where(F.col("similarity") >= low)
        merged = cut(greedy_one_task(band, done))
        decided.append(merged)
        done += merged.count()
        if low is None:
            break
        gone = sized(merged.select(F.col("removed_node").alias("node")))
        rest = left.where(F.col("similarity") < low).join(gone.withColumnRenamed("node", "i"), "i", "left_anti")
        left = cut(rest.join(gone.withColumnRenamed("node", "j"), "j", "left_anti").select(pairs.columns))
    history = decided[0]
    for more in decided[1:]:
        history = history.unionByName(more)
    return history


def merge_history(pairs: DataFrame, graph: Hypergraph, one_task_pairs: int = ONE_TASK_PAIRS) -> DataFrame:
    full = cut(_with_degrees(pairs, graph))
    small = full.limit(one_task_pairs + 1).count() <= one_task_pairs
    return cut(greedy_one_task(full) if small else greedy_rounds(full))


def merge_map(history: DataFrame, transitive: bool = False) -> DataFrame:
    """(node, new_node)"""
    steps = history.select(F.col("removed_node").alias("node"), F.col("kept_node").alias("new_node"))
    while transitive:
        further = steps.select(F.col("node").alias("new_node"), F.col("new_node").alias("next"))
        longer = cut(steps.join(further, "new_node", "left").select("node", F.coalesce("next", "new_node").alias("new_node"), F.col("next").isNotNull().alias("moved")))
        steps = longer.select("node", "new_node")
        if longer.where("moved").isEmpty():
            break
    return steps


def rename_nodes(pairs: DataFrame, renames: DataFrame) -> DataFrame:
    """`pairs` (edge_id, node) with nodes renamed, each pair once."""
    return pairs.join(sized(renames), "node", "left").select("edge_id", F.coalesce("new_node", "node").alias("node")).distinct()


def rename_in_arrays(rows: DataFrame, renames: DataFrame, key: Iterable[str], columns: Iterable[str]) -> DataFrame:
    """Rows with the names in array columns replaced, places kept. Together the columns of `key` (nulls are equal there)
    tell rows apart; rows that are equal in them have to be equal in the arrays too."""
    key, columns = list(key), list(columns)
    names = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns])
    each = rows.select(*[F.col(k).alias(f"__{k}") for k in key], F.explode(F.array_distinct(names)).alias("node")).distinct()
    hit = each.join(sized(renames), "node")  # names that change only: rows without any have no part in the shuffle
    maps = hit.groupBy(*[f"__{k}" for k in key]).agg(F.map_from_entries(F.collect_list(F.struct("node", "new_node"))).alias("__new"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    changed = [F.when(F.col("__new").isNull(), F.col(c)).otherwise(F.transform(c, lambda n: F.coalesce(F.try_element_at("__new", n), n))).alias(c) if c in columns else F.col(c) for c in rows.columns]
    return rows.join(maps, same, "left").select(*changed)


def _rebuilt(graph: Hypergraph, renames: DataFrame, least: int) -> Hypergraph:
    pairs = rename_nodes(graph.incidence, renames)
    kept = pairs.groupBy("edge_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("edge_id")
    return Hypergraph(cut(pairs.join(kept, "edge_id", "left_semi")), cut(kept))


def simplify(graph: Hypergraph, embeddings: NodeEmbeddings, *, threshold: float = MERGE_THRESHOLD, exclude_suffixes: Iterable[str] = (), min_edge_size: int = MIN_EDGE_SIZE, transitive: bool = False, one_task_pairs: int = ONE_TASK_PAIRS) -> SimplificationResult:
    """Without pairs above the threshold the input is returned as it is; else edges left with fewer than `min_edge_size`
    nodes are dropped (also those that had fewer before), and vectors of nodes that aren't in the graph any more."""
    pairs = merge_candidates(graph, embeddings, threshold, exclude_suffixes)
    history = merge_history(pairs, graph, one_task_pairs)
    merges = history.count()
    if not merges:
        return SimplificationResult(graph, embeddings, history, 0, 0, 0)
    new = _rebuilt(graph, merge_map(history, transitive), min_edge_size)
    removed = history.select(F.col("removed_node").alias("node"))
    vectors = embeddings.remove(removed).filtered(new.nodes())
    gone = graph.edge_ids.count() - new.edge_ids.count()
    return SimplificationResult(new, vectors, history, merges, removed.distinct().count(), gone)


def simplify_and_reembed(graph: Hypergraph, embeddings: NodeEmbeddings, service: EmbeddingService | None, **options) -> SimplificationResult:
    """simplify, then new vectors for the kept nodes that are still in the graph."""
    result = simplify(graph, embeddings, **options)
    if service is None or not result.merge_count:
        return result
    kept = result.history.select(F.col("kept_node").alias("node")).distinct().join(result.graph.nodes(), "node", "left_semi")
    result.embeddings = result.embeddings.merge(service.generate(kept))
    return result


def simplify_documents(graph: Hypergraph, metadata: DataFrame, embeddings: NodeEmbeddings, threshold: float = MERGE_THRESHOLD) -> tuple[Hypergraph, DataFrame, NodeEmbeddings, DataFrame]:
    """The variant for document results: pairs of all vectors at or above the threshold, names replaced in provenance
    rows too (rows of dropped edges stay), edges of fewer than two nodes dropped. Gives graph, metadata, embeddings and
    the merge history."""
    history = merge_history(embeddings.similar_pairs(threshold), graph)
    if history.isEmpty():
        return graph, metadata, embeddings, history
    renames = merge_map(history)
    new = _rebuilt(graph, renames, 2)
    rows = rename_in_arrays(metadata, renames, ("chunk_id", "edge", "seq"), ("nodes", "source", "target")).withColumn("nodes", F.sort_array(F.array_distinct("nodes")))
    removed = history.select(F.col("removed_node").alias("node"))
    return new, rows, embeddings.remove(removed).filtered(new.nodes()), history

"""Shortest paths between nodes through shared edges, of a bounded number of nodes.

A search is a sequence of joins, one a step, for all sources (and all questions) at once: frontier nodes meet the pair
table by node, then by edge, so that an edge of k nodes costs k rows a frontier node and not k * k. Of the shortest paths
to a node the lexicographically smallest is kept, and nodes reached before are not reached again.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PATH_NODES
from ..operators.hypergraph import Hypergraph
from ..tables import cut, sized


def reach(graph: Hypergraph, sources: DataFrame, most: int = PATH_NODES, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, source, node, path): the smallest shortest path of at most `most` nodes from each of `sources` (*by, node)
    that is in the graph to every node it reaches, itself too."""
    key = [*by, "source"]
    pairs = graph.incidence
    start = sources.select(*by, "node").distinct().join(pairs.select("node").distinct(), "node", "left_semi")
    frontier = cut(start.select(*by, F.col("node").alias("source"), "node", F.array("node").alias("path")))
    seen = frontier
    for _ in range(most - 1):
        edges = pairs.join(sized(frontier), "node").groupBy(*key, "edge_id").agg(F.min("path").alias("path"))
        step = pairs.join(edges, "edge_id").select(*key, "node", F.concat("path", F.array("node")).alias("path"))
        fresh = step.join(seen.select(*key, "node"), [*key, "node"], "left_anti").groupBy(*key, "node").agg(F.min("path").alias("path"))
        frontier = cut(fresh)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return cut(seen)


def find_path(graph: Hypergraph, source, target, most: int = PATH_NODES) -> list | None:
    """The path between two nodes, [source] if they are one (even if it isn't in the graph), None if there is none."""
    if source == target:
        return [source]
    spark = graph.incidence.sparkSession
    kind = graph.incidence.schema["node"].dataType.simpleString()
    found = reach(graph, spark.createDataFrame([(source,)], f"node {kind}"), most)
    row = found.where(F.col("node") == target).select("path").first()
    return row[0] if row else None


find_path_through = find_path


def _targets_on(path: Column, targets: Column) -> Column:
    return F.size(F.array_intersect(path, targets))


def shortest_paths(graph: Hypergraph, nodes: DataFrame, most: int = PATH_NODES, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, path): paths between all pairs of `nodes` (*by, node, position; earlier to later), and, for more than two
    nodes, every tree path of at least three nodes that has two of them; each once."""
    held = cut(nodes.select(*by, "node", "position"))
    # a node's tree is the same whatever asks for it
    found = reach(graph, held.select("node"), most)
    starts = held.groupBy(*by, F.col("node").alias("source")).agg(F.min("position").alias("__from"))
    ends = held.groupBy(*by, "node").agg(F.max("position").alias("__to"))
    groups = held.groupBy(*by).agg(F.collect_set("node").alias("__targets"))
    asked = starts.join(groups, list(by)) if by else starts.crossJoin(groups)
    told = found.join(sized(cut(asked)), "source").join(sized(cut(ends)), [*by, "node"], "left")
    pair = F.col("__from") < F.col("__to")
    multi = (F.size("__targets") > 2) & (F.size("path") > 2) & (_targets_on(F.col("path"), F.col("__targets")) >= 2)
    # a path has one row for each of `by`, as its ends tell it
    return told.where(F.coalesce(pair, F.lit(False)) | multi).select(*by, "path")


def multi_node_paths(graph: Hypergraph, nodes: DataFrame, most: int = PATH_NODES) -> DataFrame:
    """(path): tree paths of at least three nodes from any of `nodes` that have two of them."""
    targets = nodes.select("node").distinct()
    found = reach(graph, targets, most).where(F.size("path") > 2)
    together = targets.agg(F.collect_set("node").alias("__targets"))
    return found.crossJoin(together).where(_targets_on(F.col("path"), F.col("__targets")) >= 2).select("path")


def path_steps(paths: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, path, step, u, v): consecutive nodes of each path."""
    longer = paths.where(F.size("path") > 1)
    at = longer.select(*by, "path", F.explode(F.sequence(F.lit(0), F.size("path") - 2)).alias("step"))
    return at.select(*by, "path", "step", F.get("path", F.col("step")).alias("u"), F.get("path", F.col("step") + 1).alias("v"))


def step_edges(graph: Hypergraph, steps: DataFrame) -> DataFrame:
    """(u, v, edge_id): the first edge by name that holds both, for the distinct (u, v) of `steps`."""
    return graph.edges_with_both(steps.select("u", "v").distinct()).groupBy("u", "v").agg(F.min("edge_id").alias("edge_id"))


def edges_along(graph: Hypergraph, paths: DataFrame) -> DataFrame:
    """(path, step, edge_id); steps without an edge are left out."""
    steps = path_steps(paths)
    return steps.join(step_edges(graph, steps), ["u", "v"]).select("path", "step", "edge_id")


def path_subgraph(graph: Hypergraph, paths: DataFrame) -> Hypergraph:
    """Edges that hold both ends of a step, cut down to the paths' nodes; those with fewer than two nodes go."""
    steps = path_steps(paths)
    used = graph.edges_with_both(steps.select("u", "v").distinct()).select("edge_id").distinct()
    nodes = paths.select(F.explode("path").alias("node")).distinct()
    return graph.restrict_to_edges(used).restrict_to_nodes(nodes).filter_by_size(2)

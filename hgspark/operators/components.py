"""Connected components: nodes that shared edges connect, each named by its smallest node.

Each edge links its nodes to the smallest of them, each node joins the smallest that it is linked to, and whoever that one
joined in turn (pointer jumping). Links are then between what is joined, and the next round has only those that still
differ: few after the first. Cost is linear in the pairs however large an edge is. Each round is cut in the shared folder.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import cut, sized
from .hypergraph import Hypergraph


def _roots(joined: DataFrame) -> DataFrame:
    """(node, component) with each component that has a row itself followed to its end."""
    joined = cut(joined)
    while True:
        own = joined.where("component <> node").select(F.col("node").alias("component"), F.col("component").alias("far"))
        jumped = cut(joined.join(sized(own), "component", "left").select("node", F.coalesce("far", "component").alias("component"), F.col("far").isNotNull().alias("moved")))
        joined = jumped.select("node", "component")
        if jumped.where("moved").isEmpty():
            return joined


def connected_components(graph: Hypergraph) -> DataFrame:
    """(node, component)"""
    low = F.min("node").over(Window.partitionBy("edge_id"))
    links = cut(graph.incidence.select("node", low.alias("low")).distinct())
    joined = labels = _roots(links.groupBy("node").agg(F.min("low").alias("component")))
    while True:
        a, b = (sized(joined.select(F.col("node").alias(x), F.col("component").alias(f"__{x}"))) for x in ("node", "low"))
        ends = links.where("node <> low").join(a, "node", "left").join(b, "low", "left").select(F.coalesce("__node", "node").alias("x"), F.coalesce("__low", "low").alias("y"))
        links = cut(ends.where("x <> y").select(F.greatest("x", "y").alias("node"), F.least("x", "y").alias("low")).distinct())
        if links.isEmpty():
            return labels
        joined = _roots(links.groupBy("node").agg(F.min("low").alias("component")))
        further = joined.select(F.col("node").alias("component"), F.col("component").alias("far"))
        labels = cut(labels.join(sized(further), "component", "left").select("node", F.coalesce("far", "component").alias("component")))


def component_sizes(components: DataFrame) -> DataFrame:
    """(component, size)"""
    return components.groupBy("component").agg(F.count("*").alias("size"))


def sorted_components(components: DataFrame) -> DataFrame:
    """(component, size, nodes): the largest first, ties by name."""
    sets = components.groupBy("component").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("node")).alias("nodes"))
    return sets.orderBy(F.desc("size"), "component")


def largest_component(components: DataFrame) -> DataFrame:
    """(node): the nodes of the largest component, of equal ones the first by name."""
    top = component_sizes(components).orderBy(F.desc("size"), "component").limit(1)
    return components.join(F.broadcast(top), "component", "left_semi").select("node")


def is_connected(graph: Hypergraph) -> bool:
    """Whether there is at most one component."""
    return connected_components(graph).select("component").distinct().limit(2).count() <= 1


def remove_small_components(graph: Hypergraph, least: int, keep_singletons: bool = False) -> Hypergraph:
    """Only components of at least `least` nodes (or of one, if singletons are kept); a threshold of 0 or less changes
    nothing, any other loses empty edges."""
    if least <= 0:
        return graph
    components = connected_components(graph)
    sizes = component_sizes(components)
    wanted = F.col("size") >= least
    if keep_singletons:
        wanted = wanted | (F.col("size") == 1)
    return graph.restrict_to_nodes(components.join(sizes.where(wanted), "component", "left_semi").select("node"))


def component_summary(graph: Hypergraph) -> DataFrame:
    """(n_components, largest) in one row; 0 and 0 for a graph without nodes."""
    sizes = component_sizes(connected_components(graph))
    return sizes.agg(F.count("*").alias("n_components"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"))

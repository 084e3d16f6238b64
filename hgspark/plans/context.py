"""Sentences from edges and paths, and their size-limited text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CONTEXT_TOKENS, MAX_SENTENCES
from ..functions.events import first_metadata, relation_of_edge, short_relation_of_edge
from ..operators.hypergraph import Hypergraph
from ..tables import cut, sized
from .paths import path_steps, step_edges

HEADER = "Relevant knowledge from the graph:"
EDGES_PER_NODE = 5


def _directed(source: Column, target: Column, relation: Column) -> Column:
    verb = F.coalesce(relation, F.lit("is related to"))
    return F.concat(F.array_join(source, ", "), F.lit(" "), verb, F.lit(" "), F.array_join(target, ", "), F.lit("."))


def _undirected(nodes: Column, relation: Column) -> Column:
    pair = F.concat(F.get(nodes, F.lit(0)), F.lit(" "), F.coalesce(relation, F.lit("is connected to")), F.lit(" "), F.get(nodes, F.lit(1)), F.lit("."))
    several = F.concat(F.array_join(nodes, ", "), F.lit(" "), F.coalesce(relation, F.lit("are connected")), F.lit("."))
    return F.when(F.size(nodes) == 2, pair).when(F.size(nodes) > 2, several).otherwise(F.concat(F.array_join(nodes, ", "), F.lit(".")))


def _relation(labels: bool) -> Column:
    return relation_of_edge(F.col("edge_id")) if labels else F.lit(None).cast("string")


def _with_provenance(edges: DataFrame, metadata: DataFrame | None) -> DataFrame:
    if metadata is None:
        return edges.select("*", F.lit(None).cast("array<string>").alias("__s"), F.lit(None).cast("array<string>").alias("__t"))
    first = first_metadata(metadata).select(F.col("edge").alias("edge_id"), F.col("source").alias("__s"), F.col("target").alias("__t"))
    return edges.join(first, "edge_id", "left")


def path_sentences(graph: Hypergraph, paths: DataFrame, metadata: DataFrame | None = None, labels: bool = True, by: tuple[str, ...] = (), ordered: bool = True) -> DataFrame:
    """(*by, sentence): one for each step of each path, from the first edge that holds both nodes; each once, sorted
    if `ordered` (a sort over all: leave it out where more follows). An edge with provenance is told from its source to its
    target, any other from the step's first node to its second."""
    steps = path_steps(paths, by).select(*by, "u", "v").distinct()
    edges = _with_provenance(step_edges(graph, steps), metadata)
    plain = F.concat(F.col("u"), F.lit(" "), F.coalesce(_relation(labels), F.lit("is related to")), F.lit(" "), F.col("v"), F.lit("."))
    told = edges.select("u", "v", F.when(F.col("__s").isNotNull(), _directed(F.col("__s"), F.col("__t"), _relation(labels))).otherwise(plain).alias("sentence"))
    found = steps.join(told, ["u", "v"]).select(*by, "sentence").distinct()
    return found.orderBy(*by, "sentence") if ordered else found


def graph_sentences(graph: Hypergraph, metadata: DataFrame | None = None, labels: bool = True, ordered: bool = True) -> DataFrame:
    """(edge_id, sentence) of every edge, sorted by sentence if `ordered`; equal sentences of different edges stay."""
    edges = _with_provenance(graph.edges(), metadata)
    told = F.when(F.col("__s").isNotNull(), _directed(F.col("__s"), F.col("__t"), _relation(labels))).otherwise(_undirected(F.col("nodes"), _relation(labels)))
    found = edges.select("edge_id", told.alias("sentence"))
    return found.orderBy("sentence", "edge_id") if ordered else found


def direct_sentences(graph: Hypergraph, nodes: DataFrame | None = None, by: tuple[str, ...] = (), ordered: bool = True) -> DataFrame:
    """(*by, sentence): for each of `nodes` (*by, node) what its first five edges say of it; no full stop. Edges that hold
    nothing else count towards the five and say nothing. Without `nodes`, (node, sentence) of all the graph's."""
    # read twice, and dear where they are made from events; an edge's nodes are brought together once, not for each of them
    edges = cut(graph.incidence.groupBy("edge_id").agg(F.sort_array(F.collect_list("node")).alias("nodes")))
    pairs = edges.select("edge_id", F.explode("nodes").alias("node"))
    if nodes is not None:
        asked = cut(nodes.select(*by, "node").distinct())
        pairs = pairs.join(sized(asked.select("node")), "node", "left_semi")
    held = Hypergraph(pairs, edges.select("edge_id")).first_edges(EDGES_PER_NODE).join(edges, "edge_id").where(F.size("nodes") > 1)
    others = F.array_join(F.array_remove(F.col("nodes"), F.col("node")), ", ")
    told = held.select("node", F.concat("node", F.lit(" "), F.coalesce(short_relation_of_edge(F.col("edge_id")), F.lit("is related to")), F.lit(" "), others).alias("sentence"))
    if nodes is None:
        by = ("node",)
    found = (told if nodes is None else asked.join(told, "node")).select(*by, "sentence").distinct()
    return found.orderBy(*by, "sentence") if ordered else found


def first_sentences(sentences: DataFrame, most: int = MAX_SENTENCES, by: tuple[str, ...] = ()) -> DataFrame:
    """The first sentences in sorted order."""
    if not by:
        return sentences.orderBy("sentence").limit(most)
    turn = Window.partitionBy(*by).orderBy("sentence")
    return sentences.select("*", F.row_number().over(turn).alias("__k")).where(F.col("__k") <= most).drop("__k")


def format_contexts(sentences: DataFrame, max_tokens: int = CONTEXT_TOKENS, header: str | None = HEADER, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, context): header, blank line and a line for each sentence while they fit into 4 characters a token, header
    included; then, if any line fitted, how many are missing. A group without sentences has no row."""
    head = f"{header}\n\n" if header is not None else ""
    turn = Window.partitionBy(*by).orderBy("sentence", "__tie")
    lines = sentences.select(*by, "sentence", F.monotonically_increasing_id().alias("__tie"), F.concat(F.lit("- "), "sentence", F.lit("\n")).alias("__line"))
    run = lines.select(*by, "sentence", "__line", F.row_number().over(turn).alias("__k"), (F.sum(F.length("__line")).over(turn.rowsBetween(Window.unboundedPreceding, 0)) + len(head)).alias("__upto"))
    # lengths are positive, so the lines that fit are a prefix
    fits = F.col("__upto") <= 4 * max_tokens
    held = run.groupBy(*by).agg(F.sort_array(F.collect_list(F.when(fits, F.struct("__k", "__line")))).alias("__in"), F.count("*").alias("__n"))
    shown = F.size("__in")
    more = F.when((shown > 0) & (shown < F.col("__n")), F.concat(F.lit("- (... and "), (F.col("__n") - shown).cast("string"), F.lit(" more relationships)\n"))).otherwise("")
    whole = F.concat(F.lit(head), F.array_join(F.col("__in.__line"), ""), more)
    return held.select(*by, F.regexp_replace(whole, r"(?U)^\s+|\s+$", "").alias("context"))


def format_context(sentences: list[str], max_tokens: int = CONTEXT_TOKENS, header: str | None = HEADER) -> str:
    """The same for a list in its order."""
    if not sentences:
        return ""
    text = f"{header}\n\n" if header is not None else ""
    for k, s in enumerate(sentences):
        line = f"- {s}\n"
        if len(text) + len(line) > 4 * max_tokens:
            if k:
                text += f"- (... and {len(sentences) - k} more relationships)\n"
            break
        text += line
    return text.strip()


def collect_and_format(graph: Hypergraph, paths: DataFrame, metadata: DataFrame | None = None, max_tokens: int = CONTEXT_TOKENS, most: int = MAX_SENTENCES) -> str:
    found = first_sentences(path_sentences(graph, paths, metadata, ordered=False), most).collect()
    return format_context([r.sentence for r in found], max_tokens)

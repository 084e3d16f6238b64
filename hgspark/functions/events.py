"""Events {source[], relation, target[]}: strict reading from JSON, edges and provenance rows made of them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.hypergraph import Hypergraph
from .text import preview

EVENTS = "struct<events: array<struct<source: array<string>, relation: string, target: array<string>>>>"
METADATA = "seq bigint, edge string, nodes array<string>, source array<string>, target array<string>, chunk_id string"


def extract_json(response: Column) -> Column:
    """The JSON part of a model's response: no code fences, nothing before its start or after its end."""
    text = F.regexp_replace(response, r"(?U)^\s*(?:```(?:json)?)?\s*", "")
    text = F.regexp_replace(text, r"(?U)\s*(?:```)?\s*$", "")
    # up to the first { or, without any, the first [
    text = F.regexp_replace(text, r"(?s)^(?![{\[])(?:[^{]*(?=\{)|[^\[]*(?=\[))", "")
    # what follows the last } or, without any, the last ]
    text = F.regexp_replace(text, r"(?s)(?<=\})[^}]*[^}\]]$", "")
    return F.regexp_replace(text, r"(?s)^([^}]*\])[^}\]]+$", "$1")


def parse_events(json: Column) -> Column:
    """The array of events, or null if anything in it is malformed: a list that isn't one, a missing part, a null."""

    def broken(e: Column) -> Column:
        lists = F.exists(e["source"], lambda n: n.isNull()) | F.exists(e["target"], lambda n: n.isNull())
        return e.isNull() | e["source"].isNull() | e["relation"].isNull() | e["target"].isNull() | F.coalesce(lists, F.lit(True))

    def checked(parsed: Column) -> Column:
        return F.when(~F.coalesce(F.exists(parsed["events"], broken), F.lit(True)), parsed["events"])

    # within an array of one, so that the text is parsed once and not wherever its value is used
    return F.get(F.transform(F.array(F.from_json(json, EVENTS)), checked), F.lit(0))


def all_nodes(event: Column) -> Column:
    return F.array_distinct(F.concat(event["source"], event["target"]))


def is_binary(event: Column) -> Column:
    return (F.size(event["source"]) == 1) & (F.size(event["target"]) == 1)


def describe_event(event: Column) -> Column:
    return F.concat(F.array_join(event["source"], ", "), F.lit(" --["), event["relation"], F.lit("]--> "), F.array_join(event["target"], ", "))


def edge_name(relation: Column, chunk_id: Column, position: Column) -> Column:
    """{relation}_chunk{id}_{position}, or {relation}_{position} without a chunk; _ in relations becomes a space."""
    name = F.regexp_replace(relation, "_", " ")
    return F.when(chunk_id.isNull(), F.concat_ws("_", name, position.cast("string"))).otherwise(F.concat(name, F.lit("_chunk"), chunk_id, F.lit("_"), position.cast("string")))


def edges_from_events(rows: DataFrame, order: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """Provenance rows (METADATA without seq, with `order`'s columns and pos) from (chunk_id, events, ...)."""
    each = rows.select(*dict.fromkeys(["chunk_id", *order]), F.posexplode("events").alias("pos", "event"))
    return each.select(*[c for c in order if c != "chunk_id"], "pos", edge_name(F.col("event.relation"), F.col("chunk_id"), F.col("pos")).alias("edge"), F.array_sort(all_nodes(F.col("event"))).alias("nodes"), F.col("event.source").alias("source"), F.col("event.target").alias("target"), "chunk_id")


def to_hypergraph(rows: DataFrame) -> tuple[Hypergraph, DataFrame]:
    """The graph of (chunk_id, events) rows and its provenance rows (METADATA). seq only orders rows: two chunks may share
    a number, (chunk_id, edge, seq) is unique."""
    edges = edges_from_events(rows)
    # Rows of a chunk follow each other in order; a hash of the chunk places them without a sort over all.
    metadata = edges.select((F.xxhash64("chunk_id").bitwiseAND(F.lit((1 << 36) - 1)) * F.lit(1 << 16) + F.col("pos")).alias("seq"), "edge", "nodes", "source", "target", "chunk_id")
    # Edges of one name are brought together as lists, which are far fewer and shorter than their pairs.
    held = edges.groupBy(F.col("edge").alias("edge_id")).agg(F.array_distinct(F.flatten(F.collect_set("nodes"))).alias("nodes"))
    pairs = held.where("edge_id is not null").select("edge_id", F.explode("nodes").alias("node")).where("node is not null")
    return Hypergraph(pairs, held.select("edge_id")), metadata


def first_metadata(metadata: DataFrame) -> DataFrame:
    """One row an edge, that of the smallest seq."""
    columns = [c for c in metadata.columns if c not in ("edge", "seq")]
    held = metadata.groupBy("edge").agg(F.min(F.struct("seq", *columns)).alias("r"))
    return held.select("edge", *[F.col(f"r.{c}").alias(c) for c in ("seq", *columns)])


def grouped_by_chunk(metadata: DataFrame) -> DataFrame:
    """(chunk_id, rows): each chunk's provenance rows in order."""
    return metadata.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("seq", "edge", "nodes", "source", "target"))).alias("rows"))


def of_chunk(metadata: DataFrame, chunk_id: str) -> DataFrame:
    return metadata.where(F.col("chunk_id") == chunk_id)


def metadata_edges(metadata: DataFrame) -> DataFrame:
    return metadata.select("edge").distinct()


def metadata_nodes(metadata: DataFrame) -> DataFrame:
    return metadata.select(F.explode("nodes").alias("node")).distinct()


def metadata_chunks(metadata: DataFrame) -> DataFrame:
    return metadata.select("chunk_id").distinct()


def event_nodes(rows: DataFrame) -> DataFrame:
    """(node): all names in (events) rows."""
    each = rows.select(F.explode("events").alias("e"))
    return each.select(F.explode(all_nodes(F.col("e"))).alias("node")).distinct()


def event_relations(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("events.relation").alias("relation")).distinct()


_FULL = r"(?i)^(.+?)_chunk([0-9A-Za-z]+)_\d+$"


def relation_of_edge(edge_id: Column) -> Column:
    """The relation in an edge's name: before _chunk{id}_{n} if the name ends so, else before the first _chunk, else the
    whole name; null if that is blank."""
    plain = F.regexp_replace(edge_id, r"^[\p{Zs}\t]+|[\p{Zs}\t]+$", "")
    full = F.regexp_replace(F.regexp_extract(edge_id, _FULL, 1), r"^[\p{Zs}\t]+|[\p{Zs}\t]+$", "")
    before = F.regexp_replace(F.regexp_extract(edge_id, r"(?is)^(.*?)_chunk", 1), r"^[\p{Zs}\t]+|[\p{Zs}\t]+$", "")
    return F.when(edge_id.rlike(_FULL), full).when(edge_id.rlike("(?i)_chunk"), before).when(plain != "", plain)


def chunk_of_edge(edge_id: Column) -> Column:
    """The chunk id in an edge's name, or null."""
    return F.when(edge_id.rlike(_FULL), F.regexp_extract(edge_id, _FULL, 2))


def short_relation_of_edge(edge_id: Column) -> Column:
    """What stands before the first _chunk, with spaces for _; null if there is none or nothing before it."""
    found = F.regexp_replace(F.regexp_extract(edge_id, r"(?is)^(.*?)_chunk", 1), "_", " ")
    return F.when(edge_id.rlike("(?i)_chunk") & (found != ""), found)


def citations(edges: DataFrame, chunk_index: DataFrame, most: int = 200) -> DataFrame:
    """`edges` (edge_id, ...) with the preview of the chunk that each names, null where there is none."""
    named = edges.withColumn("chunk_id", chunk_of_edge(F.col("edge_id")))
    found = named.join(chunk_index.select("chunk_id", F.col("text").alias("__text")), "chunk_id", "left")
    return found.withColumn("citation", preview(F.col("__text"), most)).drop("__text")

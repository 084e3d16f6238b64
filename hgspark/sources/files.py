"""Files: markdown in; graphs, provenance, vectors and chunks in and out, as JSON documents or Parquet tables.

JSON documents are single objects for exchange with other programs, with an element a line. Executors write and parse the
lines; the driver only joins the executors' files to one, byte by byte. Parquet is the form for large results.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.events import METADATA
from ..functions.text import ChunkIndex, file_stem
from ..operators.embeddings import NodeEmbeddings
from ..operators.hypergraph import Hypergraph
from ..result import ProcessingResult
from ..tables import checkpoint_folder


def _texts(reader, spark: SparkSession, path: str) -> DataFrame:
    found = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return found.select("path", file_stem(F.url_decode(F.col("path"))).alias("document_id"), "text")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, document_id, text) of one file."""
    return _texts(spark.read, spark, path)


def _markdown_bytes(spark: SparkSession, folder: str, recursive: bool) -> DataFrame:
    """(path, text) of the folder's markdown files; the text is null where the bytes aren't UTF-8. Files that vanish or
    can't be opened while they are read are passed over."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.[mM][dD]").option("recursiveFileLookup", str(recursive).lower()).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return reader.load(folder).select(F.col("_metadata.file_path").alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def read_markdown_directory(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, document_id, text) of all files with the ending md, whatever its case. Names that start with . or _ are
    hidden. An empty folder gives no rows; files that aren't UTF-8 are left out (`unreadable_files` lists them)."""
    found = _markdown_bytes(spark, folder, recursive).where("text is not null")
    return found.select("path", file_stem(F.url_decode(F.col("path"))).alias("document_id"), "text").orderBy("path")


def unreadable_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path) of the markdown files that aren't UTF-8."""
    return _markdown_bytes(spark, folder, recursive).where("text is null").select("path")


def _write_text(text: DataFrame | str, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)


def _write_json(lines: DataFrame, path: str, head: str, tail: str) -> None:
    """A document of `head`, an element a row of `lines` (one text column) in its order, and `tail`. No row goes through the
    driver: the lines are written to the shared folder and the files appended to each other."""
    spark = lines.sparkSession
    folder, fs_path = f"{checkpoint_folder(spark)}/json-{uuid.uuid4().hex}", spark._jvm.org.apache.hadoop.fs.Path
    lines.write.option("lineSep", ",\n").option("compression", "none").text(folder)
    fs = fs_path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(fs_path(folder))]
    path = os.path.abspath(path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    start = f"{head}\n".encode()
    out = spark._jvm.java.io.FileOutputStream(path)
    try:
        out.write(start)
        for name in sorted((n for n in names if n.startswith("part-")), key=lambda n: (int(n.split("-")[1]), n)):
            part = fs_path(folder, name)
            held = fs.open(part)
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(held, out, 1 << 20, False)
            finally:
                held.close()
            fs.delete(part, False)
    finally:
        out.close()
    fs.delete(fs_path(folder), True)
    with open(path, "r+b") as f:
        if f.seek(0, os.SEEK_END) > len(start):
            f.truncate(f.seek(-2, os.SEEK_END))  # the last comma
            f.write(b"\n")
        f.write(tail.encode())


def _entry(key: str, value: Column | str) -> Column:
    """"key": value"""
    whole = F.to_json(F.create_map(F.coalesce(F.col(key).cast("string"), F.lit("null")), value), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


def _bare(line: Column) -> Column:
    line = F.btrim(line, F.lit(" \t\r"))
    return F.rtrim(F.when(line.endswith(","), F.substr(line, F.lit(1), F.length(line) - 1)).otherwise(line))


def _elements(spark: SparkSession, path: str, head: str, tail: str, kind: str) -> DataFrame | None:
    """(seq, e): the elements (of the array or map type `kind`) of a document that has one a line, each as a list or map of
    one, with their places; None for a document that is laid out in another way."""
    lines = spark.read.text(path, lineSep="\n")
    squeezed, bare = F.regexp_replace("value", r"\s+", ""), _bare(F.col("value"))
    short = F.length("value") < 100
    edge = F.when(short & (squeezed == head), "head").when(short & (squeezed == tail), "tail")
    left, right = "[]" if kind.startswith("array") else "{}"
    read = lines.select("value", edge.alias("edge"), F.from_json(F.concat(F.lit(left), bare, F.lit(right)), kind).alias("e"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    part = F.shiftright("id", 33)
    one = F.coalesce(F.size("e") == 1, F.lit(False))
    counts = read.groupBy(part.alias("part")).agg(F.min("start").alias("start"), F.count("*").alias("n"), *[F.count_if(F.col("edge") == x).alias(x) for x in ("head", "tail")], F.count_if(F.col("edge").isNull() & one).alias("whole")).collect()
    heads, tails, n = (sum(r[c] for r in counts) for c in ("head", "tail", "n"))
    if (heads, tails) != (1, 1) or sum(r.whole for r in counts) != n - 2:
        return None
    before, offsets = 0, []
    for r in sorted(counts, key=lambda r: r.start):
        offsets.append((r.part, before - 1))  # the head has the first line
        before += r.n
    starts = F.broadcast(spark.createDataFrame(offsets, "part long, before long"))
    held = read.where("edge is null").select("e", part.alias("part"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("k"))
    return held.join(starts, "part").select((F.col("before") + F.col("k")).alias("seq"), "e")


def _read_json(spark: SparkSession, path: str, field: str | None, kind: str) -> DataFrame:
    """(seq, e): lists or maps of elements and the place of their first. A document of another layout is read as one text."""
    head, tail = (f'{{"{field}":{{', "}}") if field else tuple("[]" if kind.startswith("array") else "{}")
    found = _elements(spark, path, head, tail, kind)
    if found is None:
        whole = F.from_json("value", f"`{field}` {kind}")[field] if field else F.from_json("value", kind)
        found = spark.read.text(path, wholetext=True).select(F.lit(0).cast("long").alias("seq"), whole.alias("e"))
    return found


def save_graph_json(graph: Hypergraph, path: str) -> None:
    """{"incidence_dict": {edge: [nodes]}} with keys and nodes sorted."""
    _write_json(graph.edges().orderBy("edge_id").select(_entry("edge_id", "nodes")), path, '{"incidence_dict": {', "}}")


export_hypernetx = save_graph_json


def load_graph_json(spark: SparkSession, path: str) -> Hypergraph:
    held = _read_json(spark, path, "incidence_dict", "map<string, array<string>>")
    return Hypergraph.from_edges(held.select(F.explode("e").alias("edge_id", "nodes")))


def save_metadata_json(metadata: DataFrame, path: str) -> None:
    """[{"edge", "nodes", "source", "target", "chunkID"}] in order."""
    row = F.struct(F.col("chunk_id").alias("chunkID"), "edge", F.array_sort("nodes").alias("nodes"), "source", "target")
    _write_json(metadata.orderBy("seq").select(F.to_json(row, {"ignoreNullFields": "false"})), path, "[", "]")


def load_metadata_json(spark: SparkSession, path: str) -> DataFrame:
    held = _read_json(spark, path, None, "array<struct<edge: string, nodes: array<string>, source: array<string>, target: array<string>, chunkID: string>>")
    rows = held.select("seq", F.posexplode("e").alias("pos", "r"))
    return rows.select((F.col("seq") + F.col("pos")).alias("seq"), "r.edge", F.array_sort("r.nodes").alias("nodes"), "r.source", "r.target", F.col("r.chunkID").alias("chunk_id"))


def save_embeddings_json(embeddings: NodeEmbeddings, path: str) -> None:
    """{"embeddings": {node: [numbers]}}"""
    _write_json(embeddings.df.orderBy("node").select(_entry("node", F.col("embedding").cast("array<double>"))), path, '{"embeddings": {', "}}")


def load_embeddings_json(spark: SparkSession, path: str) -> NodeEmbeddings:
    held = _read_json(spark, path, "embeddings", "map<string, array<float>>")
    return NodeEmbeddings(held.select(F.explode("e").alias("node", "embedding")))


def save_chunks_json(index: ChunkIndex, path: str) -> None:
    """{chunk id: text}"""
    _write_json(index.df.orderBy("chunk_id").select(_entry("chunk_id", "text")), path, "{", "}")


def load_chunks_json(spark: SparkSession, path: str) -> ChunkIndex:
    return ChunkIndex(_read_json(spark, path, None, "map<string, string>").select(F.explode("e").alias("chunk_id", "text")))


def save_history_json(history: DataFrame, path: str) -> None:
    row = F.struct(F.col("kept_node").alias("keptNode"), F.col("kept_degree").alias("keptNodeDegree"), F.col("removed_node").alias("removedNode"), F.col("removed_degree").alias("removedNodeDegree"), "similarity")
    _write_json(history.orderBy("seq").select(F.to_json(row, {"ignoreNullFields": "false"})), path, "[", "]")


def save_graph_parquet(graph: Hypergraph, folder: str) -> None:
    graph.incidence.write.mode("overwrite").parquet(f"{folder}/incidence")
    graph.edge_ids.write.mode("overwrite").parquet(f"{folder}/edge_ids")


def load_graph_parquet(spark: SparkSession, folder: str) -> Hypergraph:
    return Hypergraph(spark.read.parquet(f"{folder}/incidence"), spark.read.parquet(f"{folder}/edge_ids"))


def save_result(result: ProcessingResult, folder: str, format: str = "json") -> None:
    """{name}_graph, _metadata, _embeddings and _chunks, named after the document or "hypergraph"."""
    base = f"{folder}/{result.document_id or 'hypergraph'}"
    if format == "json":
        save_graph_json(result.graph, f"{base}_graph.json")
        save_metadata_json(result.metadata, f"{base}_metadata.json")
        save_embeddings_json(result.embeddings, f"{base}_embeddings.json")
        save_chunks_json(result.chunk_index, f"{base}_chunks.json")
    elif format == "parquet":
        save_graph_parquet(result.graph, f"{base}_graph")
        result.metadata.write.mode("overwrite").parquet(f"{base}_metadata")
        result.embeddings.df.write.mode("overwrite").parquet(f"{base}_embeddings")
        result.chunk_index.df.write.mode("overwrite").parquet(f"{base}_chunks")
    else:
        raise ValueError(f"unknown format {format}")


def load_result(spark: SparkSession, folder: str, name: str = "hypergraph", format: str = "json") -> ProcessingResult:
    base = f"{folder}/{name}"
    if format == "json":
        return ProcessingResult(load_graph_json(spark, f"{base}_graph.json"), load_metadata_json(spark, f"{base}_metadata.json"), load_embeddings_json(spark, f"{base}_embeddings.json"), load_chunks_json(spark, f"{base}_chunks.json"), name)
    return ProcessingResult(load_graph_parquet(spark, f"{base}_graph"), spark.read.parquet(f"{base}_metadata"), NodeEmbeddings(spark.read.parquet(f"{base}_embeddings")), ChunkIndex(spark.read.parquet(f"{base}_chunks")), name)


def save_simplified(result, folder: str) -> None:
    """simplified_graph.json, simplified_embeddings.json, merge_history.json"""
    save_graph_json(result.graph, f"{folder}/simplified_graph.json")
    save_embeddings_json(result.embeddings, f"{folder}/simplified_embeddings.json")
    save_history_json(result.history, f"{folder}/merge_history.json")


__all__ = [n for n in dir() if n.startswith(("load_", "save_", "read_", "export_"))] + ["METADATA"]

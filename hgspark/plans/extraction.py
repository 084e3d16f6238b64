"""From texts to hypergraphs: chunks, events from a language model, filtering, edges, vectors, merged results."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CHUNK_SIZE, TEMPERATURE
from ..functions.events import METADATA, parse_events, to_hypergraph
from ..functions.node_filter import filter_event_lists
from ..functions.text import ChunkIndex, RecursiveSplitter, split_documents
from ..operators.embeddings import EmbeddingService, NodeEmbeddings
from ..operators.hypergraph import Hypergraph
from ..operators.simplify import simplify_documents
from ..result import ProcessingResult
from ..sources.providers import LLMProvider, ProviderError, extract_json
from ..tables import cut

EVENTS_PROMPT = 'You read a passage and list the events in it. An event has sources and targets (lists of names of things) and the relation between them (a verb or short phrase). Use names as they stand, no pronouns. Answer with JSON of the form {"events": [{"source": ["..."], "relation": "...", "target": ["..."]}]} and nothing else.'
DISTILL_PROMPT = "You restate a passage in short plain sentences, one fact each, leaving out nothing and adding nothing."


def ask_events(chunks: DataFrame, provider: LLMProvider, *, system: str = EVENTS_PROMPT, model: str | None = None, temperature: float = TEMPERATURE, distill: bool = False, distill_prompt: str = DISTILL_PROMPT) -> DataFrame:
    """(chunk_id, response, error) for each distinct chunk: a failed request is a row with an error, not a failed job."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            responses, errors = [], []
            for text in batch.column(1).to_pylist():
                try:
                    told = provider.chat(distill_prompt, text, model, temperature) if distill else text
                    responses.append(extract_json(provider.chat(system, told, model, temperature)))
                    errors.append(None)
                except (ProviderError, ValueError, OSError) as e:
                    responses.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(responses, pa.string()), pa.array(errors, pa.string())], names=["chunk_id", "response", "error"])

    distinct = chunks.groupBy("chunk_id").agg(F.first("text").alias("text"))
    return distinct.mapInArrow(ask, "chunk_id string, response string, error string")


def read_events(responses: DataFrame) -> DataFrame:
    """(chunk_id, events, error): filtered events; a malformed response has no events and an error."""
    parsed = responses.select("chunk_id", "error", "response", parse_events(F.col("response")).alias("events"))
    bad = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("events").isNull(), F.concat(F.lit("not the expected JSON: "), F.substring("response", 1, 200)))
    empty = F.from_json(F.lit("[]"), "array<struct<source: array<string>, relation: string, target: array<string>>>")
    return filter_event_lists(parsed.select("chunk_id", F.coalesce("events", empty).alias("events"), bad.alias("error")))


class HypergraphExtractor:
    def __init__(self, provider: LLMProvider, splitter: RecursiveSplitter | None = None, **options):
        self.provider, self.splitter, self.options = provider, splitter or RecursiveSplitter(CHUNK_SIZE), options

    def from_chunks(self, chunks: DataFrame) -> tuple[Hypergraph, DataFrame, DataFrame]:
        """Graph, provenance rows, errors (chunk_id, error). Answers are kept, as asking isn't free."""
        answers = cut(ask_events(chunks, self.provider, **self.options))
        events = read_events(answers)
        graph, metadata = to_hypergraph(events.select("chunk_id", "events"))
        return graph, metadata, events.where("error is not null").select("chunk_id", "error")

    def from_text(self, spark: SparkSession, text: str) -> tuple[Hypergraph, DataFrame]:
        """A whole text as one chunk."""
        chunk = spark.createDataFrame([(text,)], "text string").select(F.md5(F.col("text").cast("binary")).alias("chunk_id"), "text")
        return self.from_chunks(chunk)[:2]

    def from_documents(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[Hypergraph, DataFrame, ChunkIndex, DataFrame]:
        """Graph, provenance rows, chunk index and errors of all documents together."""
        chunks = cut(split_documents(docs, self.splitter, id_col=id_col, text_col=text_col))
        graph, metadata, errors = self.from_chunks(chunks)
        return graph, metadata, ChunkIndex.from_chunks(chunks, (id_col, "seq")), errors

    def by_document(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DocumentTables:
        """Tables by document. A chunk that several documents have is asked about once and belongs to each of them."""
        chunks = cut(split_documents(docs, self.splitter, id_col=id_col, text_col=text_col))
        graph, metadata, errors = self.from_chunks(chunks)
        held = chunks.select(id_col, "chunk_id").distinct()
        rows = cut(held.join(metadata, "chunk_id").select(id_col, *metadata.columns))
        pairs = rows.select(id_col, F.col("edge").alias("edge_id"), F.explode("nodes").alias("node")).distinct()
        return DocumentTables(pairs, rows.select(id_col, F.col("edge").alias("edge_id")).distinct(), rows, chunks, held.join(errors, "chunk_id").select(id_col, "chunk_id", "error"), id_col)


@dataclass
class DocumentTables:
    """Results of many documents at once: each table has the document's id as its first column."""

    incidence: DataFrame
    edge_ids: DataFrame
    metadata: DataFrame
    chunks: DataFrame
    errors: DataFrame
    id_col: str

    def of(self, document, embeddings: NodeEmbeddings | None = None) -> ProcessingResult:
        """One document's result; `embeddings` may hold the vectors of all."""
        own = [t.where(F.col(self.id_col) == document).drop(self.id_col) for t in (self.incidence, self.edge_ids, self.metadata, self.chunks)]
        graph = Hypergraph(own[0], own[1])
        vectors = embeddings.filtered(graph.nodes()) if embeddings else NodeEmbeddings.empty(self.incidence.sparkSession)
        return ProcessingResult(graph, own[2], vectors, ChunkIndex(own[3].select("chunk_id", "text").distinct()), str(document))


class DocumentProcessor:
    def __init__(self, provider: LLMProvider, embedder: EmbeddingService | None = None, *, chunk_size: int = CHUNK_SIZE, **options):
        self.extractor, self.embedder = HypergraphExtractor(provider, RecursiveSplitter(chunk_size), **options), embedder

    def process_documents(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", document_id: str | None = None) -> ProcessingResult:
        graph, metadata, index, _ = self.extractor.from_documents(docs, id_col=id_col, text_col=text_col)
        spark = docs.sparkSession
        vectors = self.embedder.generate(graph.nodes()) if self.embedder else NodeEmbeddings.empty(spark)
        return ProcessingResult(graph, metadata, vectors, index, document_id)

    def process_each(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DocumentTables, NodeEmbeddings]:
        """Results by document, and vectors of all their nodes."""
        tables = self.extractor.by_document(docs, id_col=id_col, text_col=text_col)
        nodes = tables.incidence.select("node").distinct()
        return tables, self.embedder.generate(nodes) if self.embedder else NodeEmbeddings.empty(docs.sparkSession)

    def process_text(self, spark: SparkSession, text: str, document_id: str | None = None) -> ProcessingResult:
        return self.process_documents(spark.createDataFrame([(0, text)], "doc_id long, text string"), document_id=document_id)

    def process_file(self, spark: SparkSession, path: str) -> ProcessingResult:
        from ..sources.files import read_markdown

        docs = read_markdown(spark, path)
        stem = docs.select("document_id").first()[0]
        return self.process_documents(docs, id_col="path", document_id=stem)

    def process_directory(self, spark: SparkSession, folder: str, recursive: bool = False) -> ProcessingResult:
        """All markdown files of a folder as one result; none give an empty one. Files that can't be read as UTF-8 are left
        out with a warning, and failed requests are counted in one."""
        from ..sources.files import read_markdown_directory, unreadable_files

        files = read_markdown_directory(spark, folder, recursive)
        bad = [r.path for r in unreadable_files(spark, folder, recursive).collect()]
        for path in bad:
            warnings.warn(f"left out, not UTF-8: {path}", stacklevel=2)
        graph, metadata, index, errors = self.extractor.from_documents(files, id_col="path")
        failed = errors.count()
        if failed:
            warnings.warn(f"{failed} chunks gave no events", stacklevel=2)
        vectors = self.embedder.generate(graph.nodes()) if self.embedder else NodeEmbeddings.empty(spark)
        return ProcessingResult(graph, metadata, vectors, index, None)

    def simplify(self, result: ProcessingResult, threshold: float) -> ProcessingResult:
        graph, metadata, vectors, _ = simplify_documents(result.graph, result.metadata, result.embeddings, threshold)
        return ProcessingResult(graph, metadata, vectors, result.chunk_index, result.document_id)


def _numbered(metadata: DataFrame) -> DataFrame:
    """The rows with seq from 0 on without gaps: sorted ranges, numbered from the counts of those before."""
    names = [c for c in metadata.columns if c != "seq"]
    ranges = cut(metadata.repartitionByRange("seq", "chunk_id", "edge").sortWithinPartitions("seq", "chunk_id", "edge").select(*names, F.spark_partition_id().alias("__r"), F.monotonically_increasing_id().alias("__i")))
    sizes = sorted(ranges.groupBy("__r").agg(F.count("*").alias("n"), F.min("__i").alias("i")).collect())
    before, shifts = 0, []
    for r, n, i in sizes:
        shifts.append((r, before - i))
        before += n
    shift = metadata.sparkSession.createDataFrame(shifts, "__r int, __shift long")
    return ranges.join(F.broadcast(shift), "__r").select((F.col("__i") + F.col("__shift")).alias("seq"), *names)


def merge_results(spark: SparkSession, results: Iterable[ProcessingResult], embedder: EmbeddingService | None = None) -> ProcessingResult:
    """Graphs merged, provenance one after the other, vectors and chunks of later results winning; then, with a service,
    vectors for nodes that have none and none for nodes that aren't in the graph."""
    parts = list(results)
    if not parts:
        return ProcessingResult.empty(spark)
    graph = parts[0].graph.union(*[p.graph for p in parts[1:]])
    columns = [c.split()[0] for c in METADATA.split(", ") if not c.startswith("seq")]
    # numbers of later results start after those of earlier ones
    tops = parts[0].metadata.agg(F.lit(0).alias("r"), F.max("seq").alias("m"))
    for k, p in enumerate(parts[1:], 1):
        tops = tops.unionByName(p.metadata.agg(F.lit(k).alias("r"), F.max("seq").alias("m")))
    top = {r.r: r.m for r in tops.collect()}
    wide = sum(1 + (m or 0) for m in top.values()) >= 1 << 62
    rows, offset = None, 0
    for k, p in enumerate(parts):
        own = _numbered(p.metadata) if wide else p.metadata
        placed = own.select((F.col("seq") + F.lit(offset)).alias("seq"), *columns)
        rows = placed if rows is None else rows.unionByName(placed)
        offset += own.count() if wide else 1 + (top[k] or 0)

    def last(tables: list[DataFrame], key: str, value: str) -> DataFrame:
        together = tables[0].select(F.lit(0).alias("r"), key, value)
        for k, t in enumerate(tables[1:], 1):
            together = together.unionByName(t.select(F.lit(k).alias("r"), key, value))
        return together.groupBy(key).agg(F.max_by(value, "r").alias(value))

    vectors = NodeEmbeddings(last([p.embeddings.df for p in parts], "node", "embedding"))
    index = ChunkIndex(last([p.chunk_index.df for p in parts], "chunk_id", "text"))
    if embedder is not None:
        vectors = embedder.update(graph.nodes(), vectors)
    return ProcessingResult(graph, rows, vectors, index, None)


def events_json(events: list[dict]) -> str:
    """The JSON of some events, as a model is asked to answer."""
    return json.dumps({"events": events}, ensure_ascii=False)

"""python -m hgspark process | extract | embed | simplify | info | query | pipeline"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config
from .operators.components import component_sizes, connected_components
from .operators.embeddings import EmbeddingService, NodeEmbeddings
from .operators.simplify import simplify, simplify_and_reembed
from .plans.extraction import DocumentProcessor
from .plans.service import GraphRAG
from .sources import files
from .sources.providers import CloudServer, HashingEmbedder, LocalServer, RuleBasedLLM


def _llm(args):
    if args.provider == "offline":
        return RuleBasedLLM()
    if args.provider == "cloud":
        return CloudServer(args.api_key or os.environ.get("LLM_API_KEY", ""), args.url or os.environ.get("LLM_URL", ""), args.chat_model or "")
    return LocalServer(args.url or "http://localhost:11434", args.chat_model or config.CHAT_MODEL)


def _embedder(args):
    """Vectors come from a local server also where the chat model is hosted; only offline are they hashed."""
    if args.provider == "offline":
        return HashingEmbedder()
    own = args.url if args.provider == "local" else None
    return LocalServer(args.embedding_url or own or "http://localhost:11434")


def _service(args) -> EmbeddingService:
    return EmbeddingService(_embedder(args), args.embedding_model)


def process(spark: SparkSession, args) -> None:
    processor = DocumentProcessor(_llm(args), None if args.skip_embeddings else _service(args), chunk_size=args.chunk_size)
    result = processor.process_directory(spark, args.input, args.recursive) if os.path.isdir(args.input) else processor.process_file(spark, args.input)
    result.save(args.output)
    print(f"Saved to {args.output}: {result.graph.describe()}")


def extract(spark: SparkSession, args) -> None:
    text = open(args.input, encoding="utf-8").read() if args.file else args.input
    result = DocumentProcessor(_llm(args)).process_text(spark, text)
    stem = os.path.splitext(args.output)[0]
    files.save_graph_json(result.graph, args.output)
    files.save_metadata_json(result.metadata, f"{stem}.metadata.json")
    files.save_chunks_json(result.chunk_index, f"{stem}.chunks.json")
    print(result.graph.describe())


def embed(spark: SparkSession, args) -> None:
    graph = files.load_graph_json(spark, args.graph)
    vectors = _service(args).generate(graph.nodes())
    files.save_embeddings_json(vectors, args.output)
    print(f"Saved {vectors.count()} vectors to {args.output}")


def simplify_command(spark: SparkSession, args) -> None:
    if not 0 <= args.threshold <= 1:
        raise SystemExit("the threshold must be between 0 and 1")
    graph, vectors = files.load_graph_json(spark, args.graph), files.load_embeddings_json(spark, args.embeddings)
    suffixes = [s for s in (x.strip() for x in (args.exclude_suffixes or "").split(",")) if s]
    options = {"threshold": args.threshold, "exclude_suffixes": suffixes}
    result = simplify_and_reembed(graph, vectors, _service(args), **options) if args.recompute_embeddings else simplify(graph, vectors, **options)
    files.save_simplified(result, args.output)
    print(f"Merges: {result.merge_count}, nodes removed: {result.nodes_removed}, edges removed: {result.edges_removed}")
    if args.verbose:
        for r in result.history.orderBy("seq").limit(20).collect():
            print(f"  {r.removed_node} -> {r.kept_node} ({r.similarity:.3f})")


def info(spark: SparkSession, args) -> None:
    graph = files.load_graph_json(spark, args.graph)
    print(f"Nodes: {graph.node_count()}\nEdges: {graph.edge_count()}")
    sizes = component_sizes(connected_components(graph)).agg(F.count("*").alias("n"), F.max("size").alias("m")).first()
    print(f"Components: {sizes.n}, largest: {sizes.m or 0}\nEdge sizes:")
    for r in graph.size_distribution().orderBy("size").collect():
        print(f"  {r['size']}: {r.n_edges}")
    print("Nodes of highest degree:")
    for r in graph.top_nodes().collect():
        print(f"  {r.label}: {r.degree}")


def query(spark: SparkSession, args) -> None:
    graph = files.load_graph_json(spark, args.graph)
    vectors = files.load_embeddings_json(spark, args.embeddings) if args.embeddings else NodeEmbeddings.empty(spark)
    metadata = files.load_metadata_json(spark, args.metadata) if args.metadata else None
    chunks = files.load_chunks_json(spark, args.chunks).df if args.chunks else None
    service = GraphRAG(graph, vectors, metadata, chunks, _llm(args), _embedder(args), args.chat_model, args.embedding_model)
    if args.context_only or args.simple_keywords:
        find = service.retrieve_context_simple if args.simple_keywords else service.retrieve_context
        context = find(args.question, top_k=args.top_k, max_path_length=args.max_path_length, threshold=args.threshold)
        answer = None if args.context_only else service.llm.chat("Answer from the facts.", f"{context.formatted}\n\nQuestion: {args.question}")
    else:
        response = service.query(args.question, args.top_k, args.max_path_length, args.threshold)
        context, answer = response.context, response.answer
    if args.verbose:
        print("Keywords:", ", ".join(context.keywords))
        print("Nodes:", ", ".join(context.matched_nodes[:10]))
        for p in context.paths[:5]:
            print("Path:", " -> ".join(p))
    if args.context_only or args.show_context or answer is None:
        print(context.formatted or "No relevant context.")
    if answer is not None:
        print(answer)


def pipeline(spark: SparkSession, args) -> None:
    """Process, simplify, describe, and answer a question if there is one."""
    args.recursive, args.skip_embeddings = args.recursive, False
    process(spark, args)
    base = os.path.splitext(os.path.basename(args.input))[0] if os.path.isfile(args.input) else "hypergraph"
    args.graph, args.embeddings = f"{args.output}/{base}_graph.json", f"{args.output}/{base}_embeddings.json"
    out, args.output = args.output, f"{args.output}/simplified"
    args.exclude_suffixes, args.recompute_embeddings = None, True
    simplify_command(spark, args)
    args.graph, args.embeddings = f"{args.output}/simplified_graph.json", f"{args.output}/simplified_embeddings.json"
    info(spark, args)
    if args.question:
        args.metadata, args.chunks = None, f"{out}/{base}_chunks.json"
        args.context_only, args.simple_keywords, args.show_context = True, True, True
        args.top_k, args.max_path_length, args.threshold = config.TOP_K, config.PATH_NODES, config.MATCH_THRESHOLD
        query(spark, args)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="hgspark", description="Knowledge hypergraphs on Spark")
    top.add_argument("--version", action="version", version=config.VERSION)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *arguments) -> None:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        for flags, options in arguments:
            p.add_argument(*flags, **options)
        p.add_argument("--provider", choices=["local", "cloud", "offline"], default="local")
        p.add_argument("--url")
        p.add_argument("--embedding-url")
        p.add_argument("--api-key")
        p.add_argument("--chat-model")
        p.add_argument("--embedding-model", "--model", default=config.EMBEDDING_MODEL)
        p.add_argument("-v", "--verbose", action="store_true")

    def on(*flags, **options):
        return flags, options

    source = [on("input"), on("--recursive", action="store_true"), on("--chunk-size", type=int, default=config.CHUNK_SIZE)]
    command("process", process, *source, on("-o", "--output", default="./output"), on("--skip-embeddings", action="store_true"))
    command("extract", extract, on("input"), on("--file", action="store_true"), on("-o", "--output", default="hypergraph.json"))
    command("embed", embed, on("graph"), on("-o", "--output", default="embeddings.json"))
    command("simplify", simplify_command, on("graph"), on("-e", "--embeddings", required=True), on("-o", "--output", default="./simplified"), on("--threshold", type=float, default=config.MERGE_THRESHOLD), on("--exclude-suffixes"), on("--recompute-embeddings", action="store_true"))
    command("info", info, on("graph"))
    command("query", query, on("question"), on("-g", "--graph", required=True), on("-e", "--embeddings"), on("-m", "--metadata"), on("--chunks"), on("--top-k", type=int, default=config.TOP_K), on("--max-path-length", type=int, default=config.PATH_NODES), on("--threshold", type=float, default=config.MATCH_THRESHOLD), on("--show-context", action="store_true"), on("--simple-keywords", action="store_true"), on("--context-only", action="store_true"))
    command("pipeline", pipeline, *source, on("-o", "--output", default="./output"), on("--threshold", type=float, default=config.MERGE_THRESHOLD), on("--question"))
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(arguments)
    args.run(spark or SparkSession.builder.appName("hgspark").getOrCreate(), args)


if __name__ == "__main__":
    main(sys.argv[1:])

"""Questions to a graph: keywords, matching nodes, paths between them, sentences, context, answer."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ANSWER_TEMPERATURE, CONTEXT_TOKENS, EMBEDDING_MODEL, MATCH_THRESHOLD, PATH_NODES, TOP_K
from ..operators.embeddings import NodeEmbeddings
from ..operators.hypergraph import Hypergraph
from ..sources.providers import EmbeddingProvider, LLMProvider
from ..tables import cut
from .context import direct_sentences, format_context, format_contexts, path_sentences
from .keywords import keywords_of, llm_keywords, simple_keywords
from .matcher import best_per_node, find_matches, keyword_table, matching_nodes
from .paths import shortest_paths

ANSWER_PROMPT = "You answer questions. Rely on the facts you are given, say which you used, and say so if they aren't enough."


@dataclass
class RAGContext:
    query: str
    keywords: list[str] = field(default_factory=list)
    matched_nodes: list[str] = field(default_factory=list)
    paths: list[list[str]] = field(default_factory=list)
    sentences: list[str] = field(default_factory=list)
    formatted: str = ""

    def __repr__(self) -> str:
        return f"RAGContext(keywords: {len(self.keywords)}, nodes: {len(self.matched_nodes)}, paths: {len(self.paths)}, sentences: {len(self.sentences)})"


@dataclass
class RAGResponse:
    answer: str
    context: RAGContext


class GraphRAG:
    def __init__(self, graph: Hypergraph, embeddings: NodeEmbeddings, metadata: DataFrame | None = None, chunk_index: DataFrame | None = None, llm: LLMProvider | None = None, embedder: EmbeddingProvider | None = None, chat_model: str | None = None, embedding_model: str = EMBEDDING_MODEL):
        self.graph, self.embeddings, self.metadata, self.chunk_index = graph, embeddings, metadata, chunk_index
        self.llm, self.embedder, self.chat_model, self.embedding_model = llm, embedder, chat_model, embedding_model
        self.spark = graph.incidence.sparkSession

    def match(self, keywords: list[str], top_k: int = TOP_K, threshold: float = MATCH_THRESHOLD) -> DataFrame:
        return matching_nodes(keyword_table(self.spark, keywords), self.embeddings.df, self.embedder, model=self.embedding_model, top_k=top_k, threshold=threshold)

    def _context(self, query: str, keywords: list[str], nodes: list[str], most: int, max_tokens: int) -> RAGContext:
        table = self.spark.createDataFrame([(n, i) for i, n in enumerate(nodes)], "node string, position int")
        found = cut(shortest_paths(self.graph, table, most)) if len(nodes) > 1 else None
        paths = [list(r.path) for r in found.orderBy(F.size("path"), "path").collect()] if found is not None else []
        told = path_sentences(self.graph, found, self.metadata) if paths else direct_sentences(self.graph, table)
        sentences = [r.sentence for r in told.collect()]
        return RAGContext(query, keywords, nodes, paths, sentences, format_context(sentences, max_tokens))

    def retrieve_context(self, query: str, top_k: int = TOP_K, max_path_length: int = PATH_NODES, threshold: float = MATCH_THRESHOLD, max_tokens: int = CONTEXT_TOKENS) -> RAGContext:
        """With the model's keywords; without any, or without matches, the rest stays empty."""
        keywords = llm_keywords(self.llm, query, model=self.chat_model)
        if not keywords:
            return RAGContext(query)
        nodes = [r.node for r in self.match(keywords, top_k, threshold).collect()]
        if not nodes:
            return RAGContext(query, keywords)
        return self._context(query, keywords, nodes, max_path_length, max_tokens)

    def retrieve_context_simple(self, query: str, top_k: int = TOP_K, max_tokens: int = CONTEXT_TOKENS, max_path_length: int = PATH_NODES, threshold: float = MATCH_THRESHOLD) -> RAGContext:
        """With keywords taken from the question's words."""
        keywords = keywords_of(self.spark, query)
        nodes = [r.node for r in self.match(keywords, top_k, threshold).collect()] if keywords else []
        return self._context(query, keywords, nodes, max_path_length, max_tokens)

    def query(self, question: str, top_k: int = TOP_K, max_path_length: int = PATH_NODES, threshold: float = MATCH_THRESHOLD) -> RAGResponse:
        context = self.retrieve_context(question, top_k, max_path_length, threshold)
        facts = context.formatted or "(no facts were found)"
        answer = self.llm.chat(ANSWER_PROMPT, f"{facts}\n\nQuestion: {question}", self.chat_model, ANSWER_TEMPERATURE)
        return RAGResponse(answer, context)

    def contexts_simple(self, questions: DataFrame, max_path_length: int = PATH_NODES, max_tokens: int = CONTEXT_TOKENS) -> DataFrame:
        """(query_id, context) for rows (query_id, query), many at once: every stage is one plan over all questions."""
        return contexts_simple(self.graph, self.embeddings.df, questions, self.metadata, self.embedder, max_path_length=max_path_length, max_tokens=max_tokens)


def contexts_simple(graph: Hypergraph, embeddings: DataFrame, questions: DataFrame, metadata: DataFrame | None = None, embedder: EmbeddingProvider | None = None, *, max_path_length: int = PATH_NODES, max_tokens: int = CONTEXT_TOKENS) -> DataFrame:
    asked = questions.select("query_id", F.posexplode(simple_keywords(F.col("query"))).alias("keyword_seq", "keyword")).select("query_id", "keyword", "keyword_seq")
    found = cut(best_per_node(find_matches(asked, embeddings, embedder), ("query_id",)))
    nodes = found.select("query_id", "node", F.struct((-F.col("similarity")).alias("s"), "node").alias("position"))
    paths = cut(shortest_paths(graph, nodes, max_path_length, ("query_id",)))
    told = path_sentences(graph, paths, metadata, by=("query_id",), ordered=False)
    lonely = nodes.join(paths.select("query_id").distinct(), "query_id", "left_anti")
    return format_contexts(told.unionByName(direct_sentences(graph, lonely, ("query_id",), ordered=False)), max_tokens, by=("query_id",))

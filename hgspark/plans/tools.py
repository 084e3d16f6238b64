"""Graph questions as tools for a language model, and a small loop that lets one use them."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..operators.vectors import find_similar
from ..sources.providers import LLMProvider, extract_json
from .service import GraphRAG, RAGContext

NODE_SEARCH_THRESHOLD = 0.4


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    parameters: dict
    call: Callable[..., str]

    def schema(self) -> dict:
        """A JSON-schema description of the tool."""
        needed = [k for k, v in self.parameters.items() if "default" not in v]
        return {"name": self.name, "description": self.description, "parameters": {"type": "object", "properties": self.parameters, "required": needed}}


@dataclass(frozen=True)
class ToolSummary:
    keywords: int
    matched_nodes: int
    paths: int
    sentences: int
    text: str

    @staticmethod
    def of(context: RAGContext) -> ToolSummary:
        return ToolSummary(len(context.keywords), len(context.matched_nodes), len(context.paths), len(context.sentences), context.formatted)


def search_tool(service: GraphRAG) -> Tool:
    def search(query: str, top_k: int = 5, max_path_length: int = 4) -> str:
        context = service.retrieve_context(query, top_k, max_path_length) if service.llm else service.retrieve_context_simple(query, top_k, max_path_length=max_path_length)
        if not context.formatted:
            return f"No relevant information was found for: {query}"
        return f"{context.formatted}\n\nKeywords: {', '.join(context.keywords)}\nNodes: {', '.join(context.matched_nodes[:5])}"

    parameters = {"query": {"type": "string"}, "top_k": {"type": "integer", "default": 5}, "max_path_length": {"type": "integer", "default": 4}}
    return Tool("graph_rag_search", "Finds what the graph says about a query.", parameters, search)


def answer_tool(service: GraphRAG) -> Tool:
    def ask(question: str) -> str:
        response = service.query(question)
        return response.answer if response.context.formatted else f"{response.answer}\n\n(The graph held nothing on this.)"

    return Tool("graph_rag_query", "Answers a question with the graph's knowledge.", {"question": {"type": "string"}}, ask)


def node_report(service: GraphRAG, entity: str, limit: int = 10, threshold: float = NODE_SEARCH_THRESHOLD):
    """(node, similarity, degree, neighbors): nodes like an entity, with their three first neighbours."""
    vector = service.embedder.embed([entity], service.embedding_model)[0]
    found = find_similar(service.embeddings.df, list(vector), limit, threshold)
    graph = service.graph
    near = found.select("node")
    own = graph.incidence.join(F.broadcast(near), "node")
    degrees = own.groupBy("node").agg(F.count("*").alias("degree"))
    others = own.join(graph.incidence.select("edge_id", F.col("node").alias("other")), "edge_id").where("other <> node").groupBy("node").agg(F.slice(F.array_sort(F.collect_set("other")), 1, 3).alias("neighbors"))
    full = found.join(degrees, "node", "left").join(others, "node", "left")
    return full.select("node", "similarity", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("neighbors", F.array().cast("array<string>")).alias("neighbors")).orderBy(F.desc("similarity"), "node")


def node_tool(service: GraphRAG) -> Tool:
    def find(entity: str, limit: int = 10) -> str:
        rows = node_report(service, entity, limit).collect()
        if not rows:
            return f"No node is like: {entity}"
        return "\n".join(f"- {r.node} (similarity {r.similarity:.2f}, degree {r.degree})" + (f": {', '.join(r.neighbors)}" if r.neighbors else "") for r in rows)

    return Tool("graph_node_search", "Lists nodes whose names are like an entity.", {"entity": {"type": "string"}, "limit": {"type": "integer", "default": 10}}, find)


@dataclass
class AgentConfig:
    iterations: int = 5
    seconds: float = 120
    prompt: str = "Use the tools to look things up before you answer."

    @staticmethod
    def research() -> AgentConfig:
        return AgentConfig(10, 300, "Look a question up from several sides with the tools, then give a thorough answer.")


@dataclass
class Agent:
    """Lets a model call tools until it answers: each turn it gives {"tool", "arguments"} or {"answer"}."""

    llm: LLMProvider
    tools: list[Tool]
    config: AgentConfig = field(default_factory=AgentConfig)

    def run(self, question: str) -> str:
        listed = json.dumps([t.schema() for t in self.tools])
        system = f'{self.config.prompt}\nTools: {listed}\nAnswer with JSON only: {{"tool": name, "arguments": {{}}}} or {{"answer": text}}.'
        said, began = [f"Question: {question}"], time.monotonic()
        for _ in range(self.config.iterations):
            if time.monotonic() - began > self.config.seconds:
                break
            text = self.llm.chat(system, "\n".join(said))
            try:
                turn = json.loads(extract_json(text))
            except ValueError:
                return text
            if "answer" in turn:
                return str(turn["answer"])
            tool = next((t for t in self.tools if t.name == turn.get("tool")), None)
            if tool is None:
                return text
            try:
                seen = tool.call(**turn.get("arguments", {}))
            except TypeError as e:
                seen = f"wrong arguments: {e}"
            said.append(f"{tool.name}: {seen}")
        return "No answer within the limits."


def search_agent(service: GraphRAG) -> Agent:
    return Agent(service.llm, [search_tool(service)])


def node_agent(service: GraphRAG) -> Agent:
    return Agent(service.llm, [search_tool(service), node_tool(service)])


def full_agent(service: GraphRAG, config: AgentConfig | None = None) -> Agent:
    return Agent(service.llm, [search_tool(service), answer_tool(service), node_tool(service)], config or AgentConfig())


def research_agent(service: GraphRAG) -> Agent:
    return full_agent(service, AgentConfig.research())


def custom_agent(service: GraphRAG, tools: list[Tool], config: AgentConfig | None = None) -> Agent:
    return Agent(service.llm, tools, config or AgentConfig())

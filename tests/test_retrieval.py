import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from hgspark.functions.events import METADATA
from hgspark.operators.embeddings import EmbeddingService, NodeEmbeddings
from hgspark.operators.hypergraph import Hypergraph
from hgspark.plans import context as X
from hgspark.plans import matcher as M
from hgspark.plans import paths as P
from hgspark.plans.service import GraphRAG
from hgspark.plans.tools import Agent, answer_tool, full_agent, node_report, node_tool, research_agent, search_tool
from hgspark.sources.providers import HashingEmbedder, RuleBasedLLM, ScriptedLLM


def graph(spark, edges):
    return Hypergraph.from_dict(spark, edges)


def nodes(spark, names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "node string, position int")


def path_table(spark, *paths):
    return spark.createDataFrame([(list(p),) for p in paths], "path array<string>")


def bfs(edges, source, most):
    """Smallest shortest paths by a queue with sorted neighbours."""
    near = {}
    for ns in edges.values():
        for a in ns:
            near.setdefault(a, set()).update(b for b in ns if b != a)
    if source not in near:
        return {}
    out, queue = {source: [source]}, deque([source])
    while queue:
        n = queue.popleft()
        if len(out[n]) < most:
            for m in sorted(near[n]):
                if m not in out:
                    out[m] = [*out[n], m]
                    queue.append(m)
    return out


def test_reach_matches_a_queue(spark):
    rng = random.Random(2)
    for _ in range(3):
        edges = {f"e{i}": sorted({f"n{rng.randrange(12):02}" for _ in range(rng.randint(1, 3))}) for i in range(12)}
        g = graph(spark, edges)
        found = P.reach(g, nodes(spark, ["n00", "n01", "zz"]), 4).collect()
        for s in ("n00", "n01", "zz"):
            assert {r.node: list(r.path) for r in found if r.source == s} == bfs(edges, s, 4)


def test_single_paths(spark):
    g = graph(spark, {"e1": "AB", "e2": "BC", "e3": "CD", "e4": "DE", "e5": "X"})
    assert P.find_path(g, "A", "D") == ["A", "B", "C", "D"]
    assert P.find_path(g, "A", "E") is None
    assert P.find_path(g, "A", "E", 5) == list("ABCDE")
    assert P.find_path(g, "Q", "Q") == ["Q"]
    assert P.find_path(g, "Q", "A") is None
    assert P.find_path_through(g, "A", "X") is None


def test_paths_between_several_nodes(spark):
    g = graph(spark, {"e1": "AB", "e2": "BC", "e3": "CD"})
    two = {tuple(r.path) for r in P.shortest_paths(g, nodes(spark, "CA")).collect()}
    assert two == {("C", "B", "A")}
    three = {tuple(r.path) for r in P.shortest_paths(g, nodes(spark, "ABC")).collect()}
    # with three targets tree paths come in, also those that go on past the last target
    assert three == {("A", "B"), ("A", "B", "C"), ("B", "C"), ("A", "B", "C", "D"), ("B", "C", "D"), ("C", "B", "A")}
    assert {tuple(r.path) for r in P.multi_node_paths(g, nodes(spark, "AC")).collect()} == {("A", "B", "C"), ("A", "B", "C", "D"), ("C", "B", "A")}
    assert P.shortest_paths(g, nodes(spark, "A")).count() == 0


def test_path_edges_and_subgraph(spark):
    g = graph(spark, {"e2": "ABZ", "e1": "AB", "e3": "BC", "e4": "Z"})
    paths = path_table(spark, "ABC", "A", "AQ", "")
    assert [(r.step, r.edge_id) for r in P.edges_along(g, paths).orderBy("step").collect()] == [(0, "e1"), (1, "e3")]
    sub = P.path_subgraph(g, path_table(spark, "ABC"))
    assert {r.edge_id: list(r.nodes) for r in sub.edges().collect()} == {"e1": ["A", "B"], "e2": ["A", "B"], "e3": ["B", "C"]}


def metadata(spark):
    return spark.createDataFrame([(0, "likes_chunkab_0", ["A", "B"], ["B", "A"], ["A"], "ab")], METADATA)


def sentences(df):
    return [r.sentence for r in df.collect()]


def test_sentences(spark):
    g = graph(spark, {"likes_chunkab_0": "AB", "near_chunkab_1": "BC", "x y": "ABC", "one": "Q", "_chunkzz_9": "CD", "none": []})
    assert sentences(X.path_sentences(g, path_table(spark, "ABC", "AB"))) == ["A likes B.", "B near C."]
    assert sentences(X.path_sentences(g, path_table(spark, "AB"), metadata(spark))) == ["B, A likes A."]
    assert sentences(X.path_sentences(g, path_table(spark, "AB"), labels=False)) == ["A is related to B."]
    told = {r.edge_id: r.sentence for r in X.graph_sentences(g, metadata(spark)).collect()}
    assert told == {"likes_chunkab_0": "B, A likes A.", "near_chunkab_1": "B near C.", "x y": "A, B, C x y.", "one": "Q.", "_chunkzz_9": "C  D.", "none": "."}
    plain = {r.edge_id: r.sentence for r in X.graph_sentences(g, labels=False).collect()}
    assert plain["near_chunkab_1"] == "B is connected to C."
    assert plain["x y"] == "A, B, C are connected."


def test_direct_sentences(spark):
    edges = {f"a{i}": ["N"] for i in range(4)} | {"lies_in_chunkx_0": ["N", "M", "L"], "z": ["N", "P"], "zz": ["N", "Q"]}
    g = graph(spark, edges)
    # five edges count, of which four say nothing
    assert sentences(X.direct_sentences(g, nodes(spark, "N"))) == ["N lies in L, M"]
    assert sentences(X.direct_sentences(g, nodes(spark, "P"))) == ["P is related to N"]


def test_context_text(spark):
    lines = [f"sentence number {i}." for i in range(9)]
    df = spark.createDataFrame([(s,) for s in lines], "sentence string")
    for tokens in (8, 12, 17, 30, 2000):
        found = X.format_contexts(df, tokens).collect()
        assert found[0].context == X.format_context(lines, tokens)
    assert X.format_context([]) == ""
    assert X.format_context(["a", "b"], header=None) == "- a\n- b"
    assert X.format_context(["a" * 40, "b" * 40], 22).endswith("(... and 1 more relationships)") or X.format_context(["a" * 40, "b" * 40], 22).endswith("a" * 40)
    assert X.format_contexts(df.limit(0)).count() in (0, 1)
    g = graph(spark, {"likes_chunkab_0": "AB"})
    assert X.collect_and_format(g, path_table(spark, "AB")) == "Relevant knowledge from the graph:\n\n- A likes B."


def test_name_matches(spark):
    keys = M.keyword_table(spark, ["silk", "web", ""])
    names = spark.createDataFrame([("Silk",), ("spider silk",), ("si",), ("",), ("stone",)], "node string")
    got = {(r.keyword, r.node): (round(r.similarity, 3), r.match_type) for r in M.name_matches(keys, names).collect()}
    assert got == {("silk", "Silk"): (1.0, "exact"), ("silk", "spider silk"): (0.8, "substring"), ("silk", "si"): (0.8, "substring")}


@pytest.fixture
def rag(spark):
    g = graph(spark, {"makes_chunkab_0": ["spider", "silk"], "holds_chunkab_1": ["silk", "water"], "other": ["stone"]})
    vectors = EmbeddingService(HashingEmbedder()).generate(g.nodes())
    return GraphRAG(g, vectors, llm=ScriptedLLM({"spider": '{"keywords": ["Spider", "water"]}', "nothing": '{"keywords": []}', "Question": "An answer."}), embedder=HashingEmbedder())


def test_matching_falls_back_to_vectors(spark, rag):
    found = {(r.keyword, r.node, r.match_type) for r in M.find_matches(M.keyword_table(spark, ["silk", "stones", "sto ne"]), rag.embeddings.df, HashingEmbedder(), threshold=0.2).collect()}
    assert ("silk", "silk", "exact") in found
    assert ("stones", "stone", "substring") in found
    assert ("sto ne", "stone", "embedding") in found
    best = {r.keyword: r.node for r in M.best_matches(M.keyword_table(spark, ["silk", "spiders"]), rag.embeddings.df, HashingEmbedder()).collect()}
    assert best == {"silk": "silk", "spiders": "spider"}


def test_best_match_per_node(spark):
    rows = [("b", 1, "n", 0.9, "substring"), ("a", 0, "n", 0.9, "substring"), ("a", 0, "m", 0.5, "embedding")]
    m = spark.createDataFrame(rows, M.MATCHES)
    assert {(r.node, r.keyword) for r in M.best_per_node(m).collect()} == {("n", "a"), ("m", "a")}
    assert [(r.node, r.similarity) for r in M.unique_nodes(m).collect()] == [("n", 0.9), ("m", 0.5)]
    assert (M.at_least(m, 0.6).count(), M.unique_node_count(m)) == (2, 2)


def test_retrieval(rag):
    c = rag.retrieve_context("How does the spider use water?")
    assert c.keywords == ["spider", "water"]
    assert c.matched_nodes == ["spider", "water"]
    assert ["spider", "silk", "water"] in c.paths
    assert c.sentences == ["silk holds water.", "spider makes silk."]
    assert c.formatted.startswith("Relevant knowledge from the graph:")
    assert rag.retrieve_context("nothing").matched_nodes == []
    simple = rag.retrieve_context_simple("Is silk fine?")
    assert "silk" in simple.matched_nodes
    answer = rag.query("spider?")
    assert answer.context.matched_nodes == ["spider", "water"]


def test_batch_of_questions(spark, rag):
    asked = spark.createDataFrame([(1, "how spider water"), (2, "about stone"), (3, "stone silk"), (4, "zzz")], "query_id int, query string")
    got = {r.query_id: r.context for r in rag.contexts_simple(asked).collect()}
    assert "- silk holds water." in got[1]
    assert "- spider makes silk." in got[1]
    assert 2 not in got  # stone's only edge holds nothing else
    assert "silk" in got[3]


def test_tools_and_agents(spark, rag):
    assert "spider makes silk" in search_tool(rag).call("spider")
    assert "No relevant" in search_tool(rag).call("nothing")
    assert node_tool(rag).call("silk").startswith("- silk (similarity 1.00, degree 2): spider, water")
    assert node_report(rag, "silk", 1).first().degree == 2
    assert search_tool(rag).schema()["parameters"]["required"] == ["query"]
    script = ScriptedLLM({"graph_node_search:": '{"answer": "done"}', "go": '{"tool": "graph_node_search", "arguments": {"entity": "silk"}}', "loop": '{"tool": "graph_node_search", "arguments": {}}'}, "plain words")
    rag.llm = script
    assert full_agent(rag).run("go") == "done"
    assert research_agent(rag).config.iterations == 10
    assert Agent(script, []).run("hm") == "plain words"
    assert answer_tool(rag).name == "graph_rag_query"


def test_streamed_answers():
    seen = []
    assert RuleBasedLLM().stream("", "one two three", seen.append) == "one two three"
    assert len(seen) == 3


def test_empty_vectors(spark, rag):
    empty = GraphRAG(rag.graph, NodeEmbeddings.empty(spark), llm=rag.llm, embedder=rag.embedder)
    assert empty.retrieve_context_simple("silk").formatted == ""


def test_pairs_at_a_node_of_many_edges_cost_what_their_other_ends_have(spark):
    n = 3000
    g = Hypergraph.from_dict(spark, {f"e{k}": ["hub", f"n{k}"] for k in range(n)} | {"f": ["n1", "hub", "n2"]})
    pairs = spark.createDataFrame([("hub", f"n{k}", k) if k % 2 else (f"n{k}", "hub", k) for k in range(n)] + [("n1", "n2", -1), ("n1", "absent", -2)], "u string, v string, k int")
    found = g.edges_with_both(pairs)
    got = {(r.u, r.v, r.k, r.edge_id) for r in found.collect()}
    assert len(got) == n + 3 and ("n1", "n2", -1, "f") in got and ("hub", "n1", 1, "f") in got and ("n2", "hub", 2, "e2") in got

    def rows(node):
        yield from ([node.metrics().apply("numOutputRows").value()] if node.metrics().contains("numOutputRows") else [])
        inner = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if node.nodeName().endswith("QueryStage") else None
        kids = [inner] if inner is not None else [node.children().apply(k) for k in range(node.children().size())]
        for kid in kids:
            yield from rows(kid)

    assert n <= max(rows(found._jdf.queryExecution().executedPlan())) < 10 * n


def test_trees_are_shared_by_the_questions(spark):
    g = Hypergraph.from_dict(spark, {"e1": "ab", "e2": "bc", "e3": "cd", "e4": "bx"})
    nodes = spark.createDataFrame([(q, n, p) for q in (1, 2) for p, n in enumerate("abd"[: q + 1])], "q int, node string, position int")
    got = sorted((r.q, "".join(r.path)) for r in P.shortest_paths(g, nodes, 4, ("q",)).collect())
    one = [sorted((q, "".join(r.path)) for r in P.shortest_paths(g, nodes.where(F.col("q") == q).drop("q"), 4).collect()) for q in (1, 2)]
    assert got == one[0] + one[1] and (1, "ab") in got and (2, "abx") in got and (1, "abx") not in got


def test_direct_sentences_gather_an_edge_once(spark, monkeypatch):
    names = [f"n{k:03}" for k in range(60)]
    edges = {f"said_of_chunk{k}_0": names[k : k + 20] for k in range(41)} | {"zz": ["n000"], "lone": ["q"]}
    g = graph(spark, edges)
    want = set()
    for n in [*names, "q"]:
        for e in sorted(e for e, held in edges.items() if n in held)[:5]:
            if len(edges[e]) > 1:
                want.add((n, f"{n} {'said of' if e.startswith('said') else 'is related to'} {', '.join(m for m in sorted(edges[e]) if m != n)}"))
    found = X.direct_sentences(g, g.nodes().select("node", F.col("node").alias("about")), ("about",), ordered=False)
    assert {(r.about, r.sentence) for r in found.collect()} == want
    whole = X.direct_sentences(g, ordered=False)
    assert {tuple(r) for r in whole.collect()} == want
    for df in (found, whole):
        assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()  # the edges are cut, with all nodes

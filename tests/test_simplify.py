import random

from hgspark.operators import simplify as S
from hgspark.operators.embeddings import EmbeddingService, NodeEmbeddings
from hgspark.operators.hypergraph import Hypergraph
from hgspark.operators.simplify import greedy_one_task, greedy_rounds, merge_map, rename_in_arrays, simplify, simplify_and_reembed, simplify_documents
from hgspark.sources.providers import HashingEmbedder


def build(spark, edges, vectors):
    return Hypergraph.from_dict(spark, edges), NodeEmbeddings.from_dict(spark, vectors)


def as_dict(g):
    return {r.edge_id: list(r.nodes) for r in g.edges().collect()}


def test_nothing_to_merge_changes_nothing(spark):
    g, e = build(spark, {"e1": "AB", "e2": "CD", "e3": "A"}, {n: [float(n == m) for m in "ABCD"] for n in "ABCD"})
    r = simplify(g, e)
    assert (r.graph, r.embeddings, r.merge_count) == (g, e, 0)


def test_higher_degree_stays(spark):
    g, e = build(spark, {"e1": "AC", "e2": "AD", "e3": "BE"}, {"A": [1, 0, 0], "B": [0.99, 0.01, 0], "C": [0, 1, 0], "D": [0, 0, 1], "E": [0, 1, -1]})
    r = simplify(g, e)
    assert as_dict(r.graph) == {"e1": ["A", "C"], "e2": ["A", "D"], "e3": ["A", "E"]}
    row = r.history.first()
    assert (row.kept_node, row.removed_node, row.kept_degree, row.removed_degree) == ("A", "B", 2, 1)
    assert sorted(x.node for x in r.embeddings.df.collect()) == ["A", "C", "D", "E"]


def test_edges_that_shrink_to_one_node_go(spark):
    g, e = build(spark, {"e1": "AB", "e2": "CD", "e0": "C"}, {"A": [1, 0, 0], "B": [1, 0, 0], "C": [0, 1, 0], "D": [0, 0, 1]})
    r = simplify(g, e)
    assert as_dict(r.graph) == {"e2": ["C", "D"]}
    assert (r.merge_count, r.nodes_removed, r.edges_removed) == (1, 1, 2)
    assert sorted(x.node for x in r.embeddings.df.collect()) == ["C", "D"]


def test_excluded_suffixes(spark):
    g, e = build(spark, {"e1": ["A", "B", "image.png"]}, {n: [1, 0] for n in ("A", "B", "image.png")})
    r = simplify(g, e, exclude_suffixes=[".png"])
    assert as_dict(r.graph) == {"e1": ["A", "image.png"]}


def test_one_step_renaming_brings_a_removed_node_back(spark):
    # b absorbs c first, then a absorbs b: c's edges name b again
    g, e = build(spark, {"e1": ["c", "x"], "e2": ["b", "x"], "e3": ["b", "y"], "e4": ["a", "x"], "e5": ["a", "y"], "e6": ["a", "z"]}, {"a": [1.0, 0.3], "b": [1.0, 0.05], "c": [1.0, 0.0], "x": [-1, 0], "y": [0, -1], "z": [-1, -1]})
    r = simplify(g, e, threshold=0.96)
    assert [(h.kept_node, h.removed_node) for h in r.history.orderBy("seq").collect()] == [("b", "c"), ("a", "b")]
    assert as_dict(r.graph)["e1"] == ["b", "x"]
    assert "b" not in {x.node for x in r.embeddings.df.collect()}
    assert as_dict(simplify(g, e, threshold=0.96, transitive=True).graph)["e1"] == ["a", "x"]


def plain_scan(pairs):
    removed, out = set(), []
    for i, j, s, di, dj in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if i not in removed and j not in removed:
            kept, gone = (i, j) if di >= dj else (j, i)
            removed.add(gone)
            out.append((kept, gone))
    return out


def test_both_greedy_forms_match_a_plain_scan(spark):
    rng = random.Random(3)
    for _ in range(4):
        degree = {f"n{k:02}": rng.randint(1, 4) for k in range(14)}
        names = sorted(degree)
        pairs = [(i, j, rng.choice([0.91, 0.93, 0.95, 0.97]), degree[i], degree[j]) for a, i in enumerate(names) for j in names[a + 1 :] if rng.random() < 0.3]
        df = spark.createDataFrame(pairs, "i string, j string, similarity double, degree_i long, degree_j long")
        for form in (greedy_one_task, greedy_rounds):
            found = [(r.kept_node, r.removed_node) for r in form(df).orderBy("seq").collect()]
            assert found == plain_scan(pairs)


def test_empty_pairs(spark):
    df = spark.createDataFrame([], "i string, j string, similarity double, degree_i long, degree_j long")
    assert greedy_rounds(df).count() == 0
    assert merge_map(greedy_rounds(df)).count() == 0


def test_reembedding(spark):
    g, e = build(spark, {"e1": ["apple", "tree"], "e2": ["apples", "tree"]}, {"apple": [1, 0], "apples": [1, 0], "tree": [0, 1]})
    r = simplify_and_reembed(g, e, EmbeddingService(HashingEmbedder(8)))
    assert len(r.embeddings.get("apple")) == 8
    assert r.embeddings.get("tree") == [0, 1]


def test_document_variant_renames_provenance(spark):
    g, e = build(spark, {"e1": "AB", "e2": "BC"}, {"A": [1, 0], "B": [1, 0], "C": [0, 1]})
    m = spark.createDataFrame([(0, "e1", ["A", "B"], ["A"], ["B"], "c"), (1, "e2", ["B", "C"], ["B", "B"], ["C"], "c")], "seq long, edge string, nodes array<string>, source array<string>, target array<string>, chunk_id string")
    graph, rows, vectors, history = simplify_documents(g, m, e, 0.9)
    assert as_dict(graph) == {"e2": ["B", "C"]}
    got = {r.edge: (list(r.nodes), list(r.source), list(r.target)) for r in rows.collect()}
    assert got == {"e1": (["B"], ["B"], ["B"]), "e2": (["B", "C"], ["B", "B"], ["C"])}
    assert sorted(r.node for r in vectors.df.collect()) == ["B", "C"]
    assert history.count() == 1


def test_documents_query_keeps_all_targets_of_a_large_edge(spark, tmp_path):
    from hgspark.queries import queries

    rng = random.Random(8)
    rows = [(20 * i, [rng.gauss(0, 1) for _ in range(64)], 1) for i in range(1102)]  # one edge
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries()["hg_simplify_documents"](spark, str(tmp_path)).collect()
    assert [len(r.target.split("|")) for r in found] == [1101]


def test_provenance_rows_of_one_number_keep_their_names(spark):
    kind = "seq long, edge string, nodes array<string>, source array<string>, target array<string>, chunk_id string"
    rows = spark.createDataFrame([(7, "e1", ["A", "X"], ["A"], ["X"], "c1"), (7, "e2", ["B", "Y"], ["B", "A"], [], "c2"), (7, "e3", ["B"], None, ["B", "B"], None), (8, "e4", ["Z"], ["Z"], ["Z"], None)], kind)
    renames = spark.createDataFrame([("A", "B")], "node string, new_node string")
    out = {r.edge: (r.nodes, r.source, r.target) for r in rename_in_arrays(rows, renames, ("chunk_id", "edge", "seq"), ("nodes", "source", "target")).collect()}
    assert out == {"e1": (["B", "X"], ["B"], ["X"]), "e2": (["B", "Y"], ["B", "B"], []), "e3": (["B"], None, ["B", "B"]), "e4": (["Z"], ["Z"], ["Z"])}


def test_a_chain_of_pairs_takes_few_rounds(spark, monkeypatch):
    pairs = [(f"n{k:03}", f"n{k + 1:03}", 1 - k / 1000, 1, 1) for k in range(120)]  # each waits for the one before
    df = spark.createDataFrame(pairs, "i string, j string, similarity double, degree_i long, degree_j long").repartition(3)
    calls = []
    monkeypatch.setattr(S, "cut", lambda d, cut=S.cut: calls.append(1) or cut(d))
    for most in (25, 1000):
        found = [(r.kept_node, r.removed_node) for r in S.greedy_rounds(df, most).orderBy("seq").collect()]
        assert found == plain_scan(pairs)
    assert len(calls) < 30


def test_rounds_of_few_pairs_match_a_plain_scan(spark):
    rng = random.Random(4)
    degree = {f"n{k:02}": rng.randint(1, 4) for k in range(25)}
    pairs = [(i, j, rng.choice([0.91, 0.93, 0.95, 0.97]), degree[i], degree[j]) for i in sorted(degree) for j in sorted(degree) if i < j and rng.random() < 0.5]
    df = spark.createDataFrame(pairs, "i string, j string, similarity double, degree_i long, degree_j long")
    found = S.greedy_rounds(df, 10).orderBy("seq").collect()
    assert [(r.kept_node, r.removed_node) for r in found] == plain_scan(pairs) and [r.seq for r in found] == list(range(len(found)))

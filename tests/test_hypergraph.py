from pyspark.sql import functions as F

from hgspark.operators.components import component_summary, connected_components, is_connected, largest_component, remove_small_components, sorted_components
from hgspark.operators.hypergraph import Hypergraph


def as_dict(g):
    return {r.edge_id: list(r.nodes) for r in g.edges().collect()}


def graph(spark, d):
    return Hypergraph.from_dict(spark, d)


def names(df):
    return sorted(r[0] for r in df.collect())


def test_counts_and_description(spark):
    g = graph(spark, {"e1": "ABC", "e2": "BCD", "e3": "DE"})
    assert (g.node_count(), g.edge_count()) == (5, 3)
    assert g.describe() == "Hypergraph(nodes: 5, edges: 3)"
    assert Hypergraph.empty(spark).describe() == "Hypergraph(nodes: 0, edges: 0)"


def test_repeated_nodes_collapse_and_empty_edges_stay(spark):
    g = graph(spark, {"e1": ["A", "A"], "e2": []})
    assert as_dict(g) == {"e1": ["A"], "e2": []}
    assert g.edge_count() == 2
    assert {r["size"]: r.n_edges for r in g.size_distribution().collect()} == {0: 1, 1: 1}


def test_degrees(spark):
    g = graph(spark, {"e1": "AB", "e2": "AC", "e3": "ABC"})
    assert {r.node: r.degree for r in g.degrees().collect()} == {"A": 3, "B": 2, "C": 2}
    assert (g.degree_of("A"), g.degree_of("X")) == (3, 0)
    assert [r.node for r in g.top_nodes(2).collect()] == ["A", "B"]


def test_long_names_are_cut_in_labels(spark):
    g = graph(spark, {"e": ["x" * 41, "y" * 40]})
    assert {r.label for r in g.top_nodes().collect()} == {"x" * 37 + "...", "y" * 40}


def test_neighbours(spark):
    g = graph(spark, {"e1": "AB", "e2": "BC"})
    assert [names(g.neighbors(n)) for n in "ABC"] == [["B"], ["A", "C"], ["B"]]
    assert {(r.src, r.dst) for r in g.adjacency().collect()} == {("A", "B"), ("B", "A"), ("B", "C"), ("C", "B")}


def test_edge_lookups(spark):
    g = graph(spark, {"e1": "ABC", "e2": "D"})
    assert (g.size_of("e1"), g.size_of("e2"), g.size_of("no")) == (3, 1, 0)
    assert g.nodes_in("e1") == ["A", "B", "C"]
    assert g.nodes_in("no") is None


def test_add_edge_replaces(spark):
    g = graph(spark, {"e1": "AB"}).add_edge("e1", "CC").add_edge("e2", [])
    assert as_dict(g) == {"e1": ["C"], "e2": []}
    assert as_dict(g.replace_edges(graph(spark, {"e1": "X"}))) == {"e1": ["X"], "e2": []}


def test_remove_edge(spark):
    g = graph(spark, {"e1": "AB", "e2": "C"})
    rest, nodes = g.remove_edge("e1")
    assert (as_dict(rest), nodes) == ({"e2": ["C"]}, ["A", "B"])
    assert g.remove_edge("no")[1] is None


def test_remove_node(spark):
    g = graph(spark, {"e1": "ABC", "e2": "BC", "e3": "B", "e4": []}).remove_node("B")
    assert as_dict(g) == {"e1": ["A", "C"], "e2": ["C"], "e4": []}


def test_union_merges_and_obeys_its_laws(spark):
    a, b, c = graph(spark, {"e1": "AB", "e2": []}), graph(spark, {"e1": "BC"}), graph(spark, {"e3": "Z", "e2": "Q"})
    assert as_dict(a.union(b)) == {"e1": ["A", "B", "C"], "e2": []}
    assert a.union(b).same_as(b.union(a))
    assert a.union(b).union(c).same_as(a.union(b.union(c)))
    assert a.union(a).same_as(a)
    assert not a.same_as(b)
    assert as_dict(a.intersect(b)) == {"e1": ["B"]}


def test_restrictions(spark):
    g = graph(spark, {"e1": "ABC", "e2": "CD", "e3": "X"})
    kept = spark.createDataFrame([("A",), ("B",), ("C",)], "node string")
    assert as_dict(g.restrict_to_nodes(kept)) == {"e1": ["A", "B", "C"], "e2": ["C"]}
    assert as_dict(g.subhypergraph(kept)) == {"e1": ["A", "B", "C"], "e2": ["C"]}
    assert as_dict(g.restrict_to_edges(spark.createDataFrame([("e3",), ("no",)], "edge_id string"))) == {"e3": ["X"]}


def test_edge_filters(spark):
    g = graph(spark, {"e1": "ABC", "e2": "CD", "e3": [], "e4": "X"})
    assert sorted(as_dict(g.filter_by_size(2))) == ["e1", "e2"]
    assert sorted(as_dict(g.filter_by_size(0))) == ["e1", "e2", "e3", "e4"]
    assert sorted(as_dict(g.filter_edges(F.array_contains("nodes", "C")))) == ["e1", "e2"]
    assert sorted(as_dict(g.filter_edges(lambda e, n: e == "e3" or len(n) == 1))) == ["e3", "e4"]


def test_first_edges(spark):
    g = graph(spark, {f"e{i}": "A" for i in range(9)})
    assert [r.edge_id for r in g.first_edges(5).orderBy("edge_id").collect()] == ["e0", "e1", "e2", "e3", "e4"]


def test_components(spark):
    g = graph(spark, {"e1": "AB", "e2": "BC", "e3": "XY"})
    c = connected_components(g)
    assert {r.node: r.component for r in c.collect()} == {"A": "A", "B": "A", "C": "A", "X": "X", "Y": "X"}
    assert [(r["size"], list(r.nodes)) for r in sorted_components(c).collect()] == [(3, ["A", "B", "C"]), (2, ["X", "Y"])]
    assert names(largest_component(c)) == ["A", "B", "C"]
    assert not is_connected(g)
    assert is_connected(graph(spark, {"e1": "AB"}))
    assert is_connected(Hypergraph.empty(spark))
    assert tuple(component_summary(Hypergraph.empty(spark)).first()) == (0, 0)


def test_long_chain_and_random_graphs_match_union_find(spark):
    import random

    rng = random.Random(4)
    edges = {f"chain{i:03}": [f"n{i:03}", f"n{i + 1:03}"] for i in range(60)}
    edges |= {f"r{i}": [f"m{rng.randrange(80):03}" for _ in range(rng.randint(1, 3))] for i in range(50)}
    root = {n: n for ns in edges.values() for n in ns}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for ns in edges.values():
        for n in ns[1:]:
            a, b = top(ns[0]), top(n)
            root[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in connected_components(graph(spark, edges)).collect()}
    assert found == {n: top(n) for n in root}


def test_remove_small_components(spark):
    g = graph(spark, {"e1": "ABC", "e2": "X", "e3": [], "e4": "YZ"})
    assert as_dict(remove_small_components(g, 2)) == {"e1": ["A", "B", "C"], "e4": ["Y", "Z"]}
    assert as_dict(remove_small_components(g, 3, keep_singletons=True)) == {"e1": ["A", "B", "C"], "e2": ["X"]}
    assert remove_small_components(g, 0) is g


def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch):
    import random

    from hgspark.operators import components as K

    names = [f"n{k:03}" for k in range(300)]
    random.Random(2).shuffle(names)
    g = Hypergraph.from_dict(spark, {f"e{k}": names[k : k + 2] for k in range(299)} | {"one": ["z"], "big": ["x1", "x2", "x3"], "none": []})
    calls = []
    monkeypatch.setattr(K, "cut", lambda d, cut=K.cut: calls.append(1) or cut(d))
    got = {r.node: r.component for r in K.connected_components(g).collect()}
    assert got == {n: "n000" for n in names} | {"z": "z", "x1": "x1", "x2": "x1", "x3": "x1"}
    assert len(calls) < 45
    rng = random.Random(7)
    for _ in range(3):
        edges = {f"e{k}": [rng.randrange(60) for _ in range(rng.randint(1, 3))] for k in range(32)}
        want = {n: n for e in edges.values() for n in e}
        for _ in range(60):
            for e in edges.values():
                low = min(want[n] for n in e)
                want.update({n: low for n in e})
        ints = Hypergraph.from_edges(spark.createDataFrame(list(edges.items()), "edge_id string, nodes array<int>"))
        assert {r.node: r.component for r in K.connected_components(ints).collect()} == want


def test_adjacency_tells_pairs_apart_in_one_order(spark):
    g = Hypergraph.from_dict(spark, {"e1": "ABC", "e2": "BC", "e3": "D", "e4": "DA"})
    found = g.adjacency()
    assert sorted(r.src + r.dst for r in found.collect()) == ["AB", "AC", "AD", "BA", "BC", "CA", "CB", "DA"]
    assert "(src" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and " < dst" in plan

import json

from pyspark.sql import functions as F

from hgspark.functions import events as E
from hgspark.sources.providers import extract_json


def events(spark, *rows):
    return spark.createDataFrame(rows, "chunk_id string, events array<struct<source: array<string>, relation: string, target: array<string>>>")


def one(spark, value, column, kind="v string"):
    return spark.createDataFrame([(value,)], kind).select(column).first()[0]


def test_graph_of_events(spark):
    df = events(spark, ("test123", [(["A"], "is", ["B"]), (["C", "A"], "has_part", ["D", "A"])]))
    graph, metadata = E.to_hypergraph(df)
    rows = {r.edge: r for r in metadata.collect()}
    assert sorted(rows) == ["has part_chunktest123_1", "is_chunktest123_0"]
    assert (graph.edge_count(), graph.node_count()) == (2, 4)
    assert list(rows["has part_chunktest123_1"].nodes) == ["A", "C", "D"]
    assert list(rows["has part_chunktest123_1"].source) == ["C", "A"]
    assert {r.chunk_id for r in E.metadata_chunks(metadata).collect()} == {"test123"}
    assert [r.edge for r in metadata.orderBy("seq").collect()] == ["is_chunktest123_0", "has part_chunktest123_1"]
    assert {r.node for r in E.metadata_nodes(metadata).collect()} == {r.node for r in E.event_nodes(df).collect()} == set("ABCD")
    assert {r.relation for r in E.event_relations(df).collect()} == {"is", "has_part"}
    assert E.of_chunk(metadata, "test123").count() == 2
    assert len(E.grouped_by_chunk(metadata).first().rows) == 2


def test_names_without_a_chunk(spark):
    edges = E.edges_from_events(events(spark, (None, [(["A"], "a_b", ["B"])])))
    assert edges.first().edge == "a b_0"


def test_binary_and_description(spark):
    kind = "v struct<source: array<string>, relation: string, target: array<string>>"
    assert one(spark, (["A"], "is", ["B"]), E.is_binary(F.col("v")), kind)
    assert not one(spark, (["A", "B"], "is", ["C"]), E.is_binary(F.col("v")), kind)
    assert one(spark, (["A", "B"], "is", ["C"]), E.describe_event(F.col("v")), kind) == "A, B --[is]--> C"


RESPONSES = ['{"a": 1}', '```json\n{"a": 1}\n```', '```\n[1]\n```', 'Sure: {"a": {"b": 2}} done', "list: [1, 2] end", "nothing", "", '  {"a": 1} trailing', 'x [1] {"a": 2} y']


def test_json_is_cut_out_alike_in_python_and_spark(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(RESPONSES)], "i int, v string")
    got = [r.j for r in df.select("i", E.extract_json(F.col("v")).alias("j")).orderBy("i").collect()]
    assert got == [extract_json(r) for r in RESPONSES]
    assert got[:5] == ['{"a": 1}', '{"a": 1}', "[1]", '{"a": {"b": 2}}', "[1, 2]"]


def test_strict_reading(spark):
    good = {"source": ["A"], "relation": "r", "target": ["B"]}
    cases = [([good], 1), ([], 0), ([good, {"source": ["A"], "relation": "r"}], None), ([{**good, "target": "B"}], None), ([{**good, "source": ["A", None]}], None), ([{**good, "relation": None}], None)]
    for value, want in cases:
        got = one(spark, json.dumps({"events": value}), E.parse_events(F.col("v")))
        assert (len(got) if got is not None else None) == want, value
    assert one(spark, "no json", E.parse_events(F.col("v"))) is None
    assert one(spark, "{}", E.parse_events(F.col("v"))) is None


def test_edge_names_are_read(spark):
    cases = {"is part of_chunkab12_0": ("is part of", "ab12", "is part of"), "x_chunk": ("x", None, "x"), "a_b": ("a_b", None, None), "_chunkab_1": ("", None, None), "A_CHUNKab_3": ("A", "ab", "A"), "a_b_chunkx_2": ("a_b", "x", "a b"), " ": (None, None, None)}
    for edge, want in cases.items():
        e = F.col("v")
        row = spark.createDataFrame([(edge,)], "v string").select(E.relation_of_edge(e), E.chunk_of_edge(e), E.short_relation_of_edge(e)).first()
        assert tuple(row) == want, edge


def test_first_metadata_and_citations(spark):
    m = spark.createDataFrame([(2, "e", ["B"], ["B"], ["B"], "c2"), (1, "e", ["A"], ["A"], ["A"], "c1")], E.METADATA)
    assert E.first_metadata(m).first().chunk_id == "c1"
    edges = spark.createDataFrame([("r_chunkab_0",), ("r_chunkzz_0",), ("plain",)], "edge_id string")
    index = spark.createDataFrame([("ab", "t" * 201)], "chunk_id string, text string")
    got = {r.edge_id: r.citation for r in E.citations(edges, index).collect()}
    assert got == {"r_chunkab_0": "t" * 200 + "...", "r_chunkzz_0": None, "plain": None}


def test_edges_of_one_name_are_one_and_meet_as_lists(spark):
    kind = "chunk_id string, events array<struct<source: array<string>, relation: string, target: array<string>>>"
    rows = [("c", [(["a"], "r_s", ["b", None, "a"])]), ("c", [(["a"], "r_s", ["b", None, "a"])]), ("c", [(["d"], "r_s", [])]), (None, [(["x"], None, ["y"]), ([], "q", [])])]
    graph, metadata = E.to_hypergraph(spark.createDataFrame(rows, kind))
    assert sorted((r.edge_id, r.node) for r in graph.incidence.collect()) == [("0", "x"), ("0", "y"), *(("r s_chunkc_0", n) for n in "abd")]
    assert sorted(str(r.edge_id) for r in graph.edge_ids.collect()) == sorted(str(r.edge) for r in metadata.select("edge").distinct().collect())
    plan = graph.incidence._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.split("\n") if "hashpartitioning(" in x]
    assert exchanges and all("node" not in x.split("hashpartitioning(")[1].split(")")[0] for x in exchanges)

import http.server
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from hgspark import cli
from hgspark.functions.text import ChunkIndex
from hgspark.operators.embeddings import EmbeddingService, NodeEmbeddings
from hgspark.operators.hypergraph import Hypergraph
from hgspark.plans.extraction import DocumentProcessor, HypergraphExtractor, ask_events, merge_results, read_events
from hgspark.result import ProcessingResult
from hgspark.sources import files
from hgspark.sources import providers as R
from hgspark.streaming.ingest import ingest, read_graph, stream_degrees

GOOD = json.dumps({"events": [{"source": ["silk"], "relation": "binds_to", "target": ["water"]}, {"source": ["it"], "relation": "is", "target": ["x"]}]})


def test_events_and_errors(spark):
    chunks = spark.createDataFrame([("a", "good one"), ("b", "bad one"), ("c", "down"), ("a", "good one")], "chunk_id string, text string")
    llm = R.ScriptedLLM({"good": "Here: " + GOOD, "bad": '{"events": [{"source": "x"}]}', "down": "ERROR"})
    rows = {r.chunk_id: r for r in read_events(ask_events(chunks, llm)).collect()}
    assert len(rows) == 3
    assert [list(e.source) for e in rows["a"].events] == [["silk"]]
    assert rows["a"].error is None
    assert "expected JSON" in rows["b"].error
    assert "ConnectionFailed" in rows["c"].error


def test_documents_become_one_graph(spark):
    docs = spark.createDataFrame([(1, "good text"), (2, "down"), (3, None), (4, "")], "doc_id long, text string")
    x = HypergraphExtractor(R.ScriptedLLM({"good": GOOD, "down": "ERROR"}))
    graph, metadata, index, errors = x.from_documents(docs)
    assert (graph.edge_count(), metadata.count(), index.count(), errors.count()) == (1, 1, 2, 1)
    assert graph.edge_ids.first()[0].startswith("binds to_chunk")
    assert x.from_text(spark, "good")[0].node_count() == 2


def test_distilling_asks_twice(spark):
    chunks = spark.createDataFrame([("a", "long")], "chunk_id string, text string")
    llm = R.ScriptedLLM({"long": "short", "short": GOOD})
    assert read_events(ask_events(chunks, llm, distill=True)).first().error is None


def processor():
    return DocumentProcessor(R.RuleBasedLLM(), EmbeddingService(R.HashingEmbedder(8)), chunk_size=100)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "One.md").write_text("Spiders make silk. Silk holds water.")
    (tmp_path / "in" / "two.MD").write_text("Silk resists tearing.")
    (tmp_path / "in" / "deep" / "three.md").write_text("Worms make silk.")
    (tmp_path / "in" / "no.txt").write_text("Nobody reads this.")
    (tmp_path / "in" / ".hidden.md").write_text("Nobody reads that.")
    return tmp_path


def test_reading_markdown(spark, folder):
    flat = files.read_markdown_directory(spark, str(folder / "in")).collect()
    assert [r.document_id for r in flat] == ["One", "two"]
    assert flat[0].text == "Spiders make silk. Silk holds water."
    assert files.read_markdown_directory(spark, str(folder / "in"), True).count() == 3


def test_bundle_round_trips(spark, folder):
    r = processor().process_directory(spark, str(folder / "in"), True)
    for form in ("json", "parquet"):
        out = str(folder / form)
        r.save(out, form)
        back = files.load_result(spark, out, format=form)
        assert back.graph.same_as(r.graph)
        assert {(m.edge, *m.source, *m.target, m.chunk_id) for m in back.metadata.collect()} == {(m.edge, *m.source, *m.target, m.chunk_id) for m in r.metadata.collect()}
        assert {x.node: list(x.embedding) for x in back.embeddings.df.collect()} == {x.node: list(x.embedding) for x in r.embeddings.df.collect()}
        assert back.chunk_index.df.exceptAll(r.chunk_index.df).isEmpty()
    with pytest.raises(ValueError, match="format"):
        r.save(str(folder), "plist")
    assert sorted(os.listdir(folder / "json")) == ["hypergraph_chunks.json", "hypergraph_embeddings.json", "hypergraph_graph.json", "hypergraph_metadata.json"]


def test_single_file_names_its_document(spark, folder):
    r = processor().process_file(spark, str(folder / "in" / "One.md"))
    assert r.document_id == "One"
    assert r.describe().startswith("ProcessingResult(Hypergraph(")


def test_graph_json_keeps_empty_edges(spark, tmp_path):
    g = Hypergraph.from_dict(spark, {"e1": "BA", "e2": []})
    path = str(tmp_path / "g.json")
    files.export_hypernetx(g, path)
    assert json.load(open(path)) == {"incidence_dict": {"e1": ["A", "B"], "e2": []}}
    assert files.load_graph_json(spark, path).same_as(g)


def test_merging_results(spark):
    a, b = (processor().process_text(spark, t) for t in ("Spiders make silk.", "Worms make silk."))
    m = merge_results(spark, [a, b])
    assert (m.graph.edge_count(), m.metadata.count(), m.chunk_index.count()) == (2, 2, 2)
    assert m.metadata.orderBy("seq").first().source[0] == "Spiders"
    assert merge_results(spark, []).graph.node_count() == 0
    assert merge_results(spark, [a, ProcessingResult.empty(spark)], EmbeddingService(R.HashingEmbedder(8))).embeddings.count() == 2


def test_processor_simplifies(spark):
    r = processor().process_text(spark, "Spider makes silk. Spiders makes silk.")
    s = processor().simplify(r, 0.5)
    assert s.graph.node_count() < r.graph.node_count()


def test_commands(spark, folder, capsys):
    out = str(folder / "out")
    cli.main(["process", str(folder / "in"), "-o", out, "--provider", "offline", "--chunk-size", "100"], spark)
    cli.main(["info", f"{out}/hypergraph_graph.json"], spark)
    cli.main(["simplify", f"{out}/hypergraph_graph.json", "-e", f"{out}/hypergraph_embeddings.json", "-o", f"{out}/s", "--threshold", "0.5", "--provider", "offline", "-v", "--recompute-embeddings"], spark)
    cli.main(["query", "What about silk and water?", "-g", f"{out}/hypergraph_graph.json", "-e", f"{out}/hypergraph_embeddings.json", "-m", f"{out}/hypergraph_metadata.json", "--chunks", f"{out}/hypergraph_chunks.json", "--simple-keywords", "--context-only", "-v", "--provider", "offline"], spark)
    cli.main(["extract", "Spiders make silk.", "-o", f"{out}/x.json", "--provider", "offline"], spark)
    cli.main(["embed", f"{out}/x.json", "-o", f"{out}/x_emb.json", "--provider", "offline"], spark)
    text = capsys.readouterr().out
    for part in ("Nodes:", "Components:", "Merges:", "Relevant knowledge", "Saved 2 vectors"):
        assert part in text
    assert {"simplified_graph.json", "simplified_embeddings.json", "merge_history.json"} <= set(os.listdir(f"{out}/s"))
    with pytest.raises(SystemExit):
        cli.main(["simplify", "g", "-e", "e", "--threshold", "2"], spark)


def test_pipeline_command(spark, folder, capsys):
    cli.main(["pipeline", str(folder / "in"), "-o", str(folder / "p"), "--provider", "offline", "--question", "Is Silk strong?"], spark)
    assert "Relevant knowledge" in capsys.readouterr().out


def test_http_errors_are_mapped():
    for code, kind in ((401, R.ConfigurationError), (404, R.ModelNotAvailable), (429, R.ConnectionFailed), (500, R.InvalidResponse)):
        assert type(R._status_error(code, "")) is kind
    with pytest.raises(R.ConfigurationError):
        R.CloudServer("", "http://localhost", "m")
    with pytest.raises(R.ConnectionFailed):
        R.LocalServer("http://127.0.0.1:9", seconds=1).chat("s", "u")
    with pytest.raises(R.DecodingError):
        R.ScriptedLLM({}, "no json").generate("s", "u")


def test_streamed_documents_grow_a_graph(spark, tmp_path):
    source = tmp_path / "stream"
    docs = spark.createDataFrame([(1, "Spiders make silk."), (2, "Worms make silk.")], "doc_id long, text string")
    docs.write.parquet(str(source))
    stream = spark.readStream.schema(docs.schema).parquet(str(source))
    for _ in range(2):
        ingest(stream, HypergraphExtractor(R.RuleBasedLLM()), str(tmp_path / "graph"), str(tmp_path / "cp")).awaitTermination(120)
    graph = read_graph(spark, str(tmp_path / "graph"))
    assert (graph.edge_count(), graph.node_count()) == (2, 3)


def test_streamed_degrees(spark, tmp_path):
    rows = spark.createDataFrame([("e1", "a", "2024-01-01 00:10:00"), ("e2", "a", "2024-01-01 00:20:00")], "edge_id string, node string, ts string").selectExpr("edge_id", "node", "timestamp(ts) AS ts")
    rows.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s"))
    q = stream_degrees(stream).writeStream.format("memory").queryName("degrees").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.node, r.degree) for r in spark.table("degrees").collect()] == [("a", 2)]


class _Stub(http.server.BaseHTTPRequestHandler):
    """Answers like a local and a hosted model server, a part of the answer at a time."""

    def log_message(self, *args):
        pass

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.server.seen.append((self.path, body))
        self.send_response(200)
        self.end_headers()
        if self.path == "/api/embed":
            self.wfile.write(json.dumps({"embeddings": [[1.0, len(t)] for t in body["input"]]}).encode())
        elif self.path == "/api/chat":
            for part in ("one ", "two ", ""):
                self.wfile.write(json.dumps({"message": {"content": part}, "done": not part}).encode() + b"\n")
        elif body.get("stream"):
            for part in ("three ", "four"):
                self.wfile.write(b"data: " + json.dumps({"choices": [{"delta": {"content": part}}]}).encode() + b"\n\n")
            self.wfile.write(b": comment\n\ndata: [DONE]\n\n")
        else:
            self.wfile.write(json.dumps({"choices": [{"message": {"content": '{"events": []}'}}]}).encode())


@pytest.fixture
def server():
    held = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Stub)
    held.seen = []
    thread = threading.Thread(target=held.serve_forever, daemon=True)
    thread.start()
    yield held, f"http://127.0.0.1:{held.server_address[1]}"
    held.shutdown()


def test_answers_stream_in_parts(server):
    held, url = server
    for llm, parts in ((R.LocalServer(url), ["one ", "two "]), (R.CloudServer("k", url, "m"), ["three ", "four"])):
        told = []
        assert llm.stream("s", "u", told.append) == "".join(parts)
        assert told == parts
    assert all(body["stream"] for _, body in held.seen)


def test_hosted_chat_has_vectors_of_the_local_server(spark, folder, server):
    held, url = server
    args = cli.parser().parse_args(["embed", "g.json", "--provider", "cloud", "--embedding-url", url])
    assert cli._embedder(args).embed(["abc"], "m") == [[1.0, 3]]
    assert isinstance(cli._embedder(cli.parser().parse_args(["embed", "g", "--provider", "cloud"])), R.LocalServer)
    assert isinstance(cli._embedder(cli.parser().parse_args(["embed", "g", "--provider", "offline"])), R.HashingEmbedder)


def test_results_by_document(spark):
    docs = spark.createDataFrame([(1, "Spiders make silk."), (2, "Worms make silk."), (3, "Spiders make silk."), (4, None)], "doc_id long, text string")
    tables, vectors = processor().process_each(docs)
    one, three = tables.of(1, vectors), tables.of(3, vectors)
    assert one.graph.same_as(three.graph)
    assert (one.graph.edge_count(), one.metadata.count(), one.embeddings.count(), one.chunk_index.count()) == (1, 1, 2, 1)
    assert {r.doc_id for r in tables.edge_ids.collect()} == {1, 2, 3}
    assert tables.of(4).graph.edge_count() == 0


def test_unreadable_files_are_left_out_with_a_warning(spark, folder):
    (folder / "in" / "bad.md").write_bytes(b"Silk \xff\xfe is bad.")
    with pytest.warns(UserWarning, match=r"not UTF-8: .*bad\.md"):
        r = processor().process_directory(spark, str(folder / "in"))
    assert r.chunk_index.count() == 2


def test_numbers_of_merged_results_stay_apart(spark):
    parts = [processor().process_text(spark, t) for t in ("Spiders make silk.", "Worms make silk. Silk holds water.")]
    for p in parts:
        p.metadata = p.metadata.withColumn("seq", F.col("seq") + (1 << 62))
    rows = merge_results(spark, parts).metadata.orderBy("seq").collect()
    assert [r.seq for r in rows] == [0, 1, 2]
    assert rows[0].source[0] == "Spiders"


def test_json_documents_go_by_lines_and_not_through_the_driver(spark, tmp_path, monkeypatch):
    kind = "seq long, edge string, nodes array<string>, source array<string>, target array<string>, chunk_id string"
    rows = [(k, f"e{k}", ["b", 'a "q"\n'], ["Ä\u2028"], [], None if k % 7 == 0 else f"c{k}") for k in range(200)]
    metadata = spark.createDataFrame(rows[::-1], kind).repartition(5)
    chunks = ChunkIndex(spark.createDataFrame([(f"c{k}", "{\n" if k else "}\n,") for k in range(50)], "chunk_id string, text string"))
    vectors = NodeEmbeddings.from_dict(spark, {f"n{k}": [k / 3, -1.5] for k in range(50)})
    with monkeypatch.context() as m:
        for name in ("toLocalIterator", "collect", "toPandas"):
            m.setattr(type(metadata), name, None)
        files.save_metadata_json(metadata, str(tmp_path / "m.json"))
        files.save_chunks_json(chunks, str(tmp_path / "c.json"))
        files.save_embeddings_json(vectors, str(tmp_path / "v.json"))
    held = json.load(open(tmp_path / "m.json", encoding="utf-8"))
    assert [r["edge"] for r in held] == [f"e{k}" for k in range(200)] and held[7] == {"chunkID": None, "edge": "e7", "nodes": ['a "q"\n', "b"], "source": ["Ä\u2028"], "target": []}
    assert json.load(open(tmp_path / "c.json")) == {r.chunk_id: r.text for r in chunks.df.collect()}
    json.dump(held, open(tmp_path / "pretty.json", "w"), indent=2)
    json.dump(held, open(tmp_path / "compact.json", "w"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        read = files.load_metadata_json(spark, str(tmp_path / "m.json"))
        assert read.rdd.getNumPartitions() > 4
        for name in ("m", "pretty", "compact"):
            got = files.load_metadata_json(spark, str(tmp_path / f"{name}.json")).orderBy("seq").collect()
            assert [(r.seq, r.edge, sorted(r.nodes), r.source, r.target, r.chunk_id) for r in got] == [(s, e, sorted(n), a, b, c) for s, e, n, a, b, c in rows]
        assert files.load_chunks_json(spark, str(tmp_path / "c.json")).df.exceptAll(chunks.df).isEmpty()
        assert files.load_embeddings_json(spark, str(tmp_path / "v.json")).df.exceptAll(vectors.df).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    files.save_metadata_json(metadata.limit(0), str(tmp_path / "none.json"))
    assert json.load(open(tmp_path / "none.json")) == [] and files.load_metadata_json(spark, str(tmp_path / "none.json")).isEmpty()

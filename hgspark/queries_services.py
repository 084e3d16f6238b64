"""Registered queries of services, files and results; see queries.py."""

import uuid

from pyspark.sql import functions as F

from .functions import events as E
from .functions.text import ChunkIndex, content_id
from .operators import components as C
from .operators import vectors as V
from .operators.embeddings import EmbeddingService, NodeEmbeddings
from .operators.hypergraph import Hypergraph
from .plans import context as X
from .plans import matcher as M
from .plans.extraction import DocumentProcessor, merge_results
from .queries import _DIRECT, _EVT, _HITS, _VEC, _asked, _hashed_sql, _names, _neighbour_vectors, _register, _table, _tagged, _values, _values_sql, ctx_direct, customer_orders, order_events, order_parts, vector_graph
from .result import ProcessingResult
from .sources import files
from .sources.providers import HashingEmbedder, RuleBasedLLM
from .tables import checkpoint_folder


@_register("SELECT 'customers' AS graph, (SELECT count(DISTINCT o_custkey) <= 1 FROM orders) AS connected UNION ALL SELECT 'one edge', true")
def hg_is_connected(spark, d):
    one = Hypergraph.from_dict(spark, {"e": ["a", "b", "c"]})
    return spark.createDataFrame([("customers", C.is_connected(customer_orders(spark, d))), ("one edge", C.is_connected(one))], "graph string, connected boolean")


@_register("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE round(list_cosine_similarity(x, y), 6) END AS similarity FROM (SELECT a.vec_id, a.embedding::DOUBLE[] x, b.embedding::DOUBLE[] y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)")
def vec_cosine_strict(spark, d):
    """A third of the vectors are made zero ones, which are similar to nothing."""
    x = F.when(F.col("vec_id") % 3 == 0, F.transform("x", lambda v: v * 0)).otherwise(F.col("x"))
    return _neighbour_vectors(spark, d).select("vec_id", F.round(V.cosine_strict(x, F.col("y")), 6).alias("similarity"))


@_register(_values_sql("SELECT 'v' || vec_id AS node, CASE WHEN vec_id = 0 THEN [1.0, 2.0] ELSE embedding::DOUBLE[] END AS e FROM embeddings WHERE vec_id NOT IN (1, 2)"))
def emb_point(spark, d):
    return _values(vector_graph(spark, d)[1].set("v0", [1.0, 2.0]).remove(["v1", "v2", "absent"]))


_HAVE = "SELECT DISTINCT p_name AS node FROM part WHERE p_name LIKE '%bolt'"
_ENSURED = f"SELECT node, 0 AS position, 1.0::DOUBLE AS value FROM ({_HAVE}) UNION ALL SELECT node, position, round(value, 4) FROM ({_hashed_sql('SELECT p_name AS node FROM part WHERE p_name NOT LIKE ' + repr('%bolt'))})"


def _partly(spark, d) -> NodeEmbeddings:
    return NodeEmbeddings(_names(spark, d).where(F.col("node").endswith("bolt")).select("node", F.array(F.lit(1.0)).cast("array<float>").alias("embedding")))


@_register(_ENSURED)
def emb_ensure(spark, d):
    return _values(EmbeddingService(HashingEmbedder()).ensure(_names(spark, d), _partly(spark, d)))


@_register(f"SELECT * FROM ({_ENSURED}) WHERE node NOT LIKE 'cold%'")
def emb_update(spark, d):
    wanted = _names(spark, d).where(~F.col("node").startswith("cold"))
    return _values(EmbeddingService(HashingEmbedder()).update(wanted, _partly(spark, d)))


@_register(f"WITH v AS ({_hashed_sql('SELECT p_name AS node FROM part')}), q AS ({_hashed_sql('SELECT ' + repr('large bold bolts') + ' AS node')}) SELECT v.node, round(sum(v.value * q.value), 5) AS similarity FROM v JOIN q USING (position) GROUP BY v.node HAVING sum(v.value * q.value) >= 0.2137")
def emb_similar_text(spark, d):
    service = EmbeddingService(HashingEmbedder())
    found = service.find_similar_nodes("large bold bolts", service.generate(_names(spark, d)), 1000, 0.2137)
    return found.select("node", F.round("similarity", 5).alias("similarity"))


@_register("SELECT md5(text) AS chunk_id, CASE WHEN length(text) <= 50 THEN text ELSE left(text, 50) || '...' END AS preview FROM documents WHERE doc_id <> 0 AND md5(text) <> (SELECT md5(text) FROM documents WHERE doc_id = 0) GROUP BY text UNION ALL SELECT 'own', 'a text of its own'")
def txt_chunk_point(spark, d):
    docs = _table(spark, d, "documents")
    gone = docs.where("doc_id = 0").select(content_id(F.col("text"))).first()[0]
    index = ChunkIndex.from_chunks(docs.select("doc_id", F.lit(0).alias("seq"), content_id(F.col("text")).alias("chunk_id"), "text"))
    held = index.remove(gone).add("own", "a text of its own").df
    return held.select("chunk_id", F.when(F.length("text") <= 50, F.col("text")).otherwise(F.concat(F.substring("text", 1, 50), F.lit("..."))).alias("preview"))


@_register(f"SELECT count(DISTINCT node) AS n FROM {_HITS} WHERE s >= 0.5")
def match_unique_count(spark, d):
    n = M.unique_node_count(M.at_least(M.name_matches(_asked(spark, d), _names(spark, d)), 0.5))
    return spark.createDataFrame([(n,)], "n long")


@_register(f"SELECT node, sentence FROM (SELECT node, sentence, row_number() OVER (PARTITION BY node ORDER BY sentence) k FROM (SELECT DISTINCT node, sentence FROM {_DIRECT})) WHERE k <= 2")
def ctx_first_sentences(spark, d):
    return X.first_sentences(ctx_direct(spark, d), 2, ("node",))


def _parts_of_results(spark, d) -> list[ProcessingResult]:
    """Two results that share the orders of one customer in three."""
    events, out = order_events(spark, d), []
    third = F.xxhash64("chunk_id") % 3
    for wanted in (third != 0, third != 1):
        graph, metadata = E.to_hypergraph(events.where(wanted))
        chunks = ChunkIndex(events.where(wanted).select("chunk_id", F.col("events")[0]["source"][0].alias("text")))
        out.append(ProcessingResult(graph, metadata, NodeEmbeddings.empty(spark), chunks))
    return out


@_register(f"SELECT edge AS edge_id, unnest(list_append(parts, c_name)) AS node FROM {_EVT}")
def res_merge_graph(spark, d):
    return merge_results(spark, _parts_of_results(spark, d)).graph.incidence


@_register(f"SELECT chunk_id, c_name AS text FROM {_EVT}")
def res_merge_chunks(spark, d):
    return merge_results(spark, _parts_of_results(spark, d)).chunk_index.df


_LAND = "'L' || n_nationkey"
_TOLD = f"(SELECT s_suppkey, 'S' || s_suppkey || ' sells in ' || {_LAND} || '. ' || {_LAND} || ' lies within R' || n_regionkey || '.' AS text, 'S' || s_suppkey AS s, {_LAND} AS land, 'R' || n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_TOLD_PAIRS = f"""SELECT s_suppkey AS doc_id, edge_id, unnest(nodes) AS node FROM (
 SELECT s_suppkey, 'sells_chunk' || md5(text) || '_0' AS edge_id, [s, land] AS nodes FROM {_TOLD}
 UNION ALL SELECT s_suppkey, 'lies_chunk' || md5(text) || '_1', [land, r] FROM {_TOLD})"""


def _told(spark, d):
    s, n = _table(spark, d, "supplier"), _table(spark, d, "nation")
    land = _tagged("L", "n_nationkey")
    text = F.concat(_tagged("S", "s_suppkey"), F.lit(" sells in "), land, F.lit(". "), land, F.lit(" lies within "), _tagged("R", "n_regionkey"), F.lit("."))
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("doc_id"), text.alias("text"))


def _processor() -> DocumentProcessor:
    return DocumentProcessor(RuleBasedLLM(), EmbeddingService(HashingEmbedder()))


@_register(f"SELECT edge_id, node FROM ({_TOLD_PAIRS})")
def ext_documents(spark, d):
    return _processor().process_documents(_told(spark, d)).graph.incidence


@_register(_TOLD_PAIRS)
def ext_by_document(spark, d):
    return _processor().process_each(_told(spark, d))[0].incidence


@_register(f"SELECT node, position, round(value, 4) AS value FROM ({_hashed_sql(f'SELECT node FROM ({_TOLD_PAIRS})')})")
def ext_vectors(spark, d):
    return _values(_processor().process_documents(_told(spark, d)).embeddings)


@_register(f"SELECT md5(text) AS chunk_id, text FROM {_TOLD}")
def ext_chunks(spark, d):
    return _processor().process_documents(_told(spark, d)).chunk_index.df


@_register(f"SELECT 'lies_chunk' || md5(text) || '_1' AS edge, land AS source, 'lies' AS relation, r AS target FROM {_TOLD} UNION ALL SELECT 'sells_chunk' || md5(text) || '_0', s, 'sells', land FROM {_TOLD}")
def ext_metadata(spark, d):
    m = _processor().process_documents(_told(spark, d)).metadata
    return m.select("edge", F.array_join("source", "|").alias("source"), E.relation_of_edge(F.col("edge")).alias("relation"), F.array_join("target", "|").alias("target"))


@_register(f"SELECT s || ' --[sells]--> ' || land AS described, true AS binary FROM {_TOLD}")
def evt_describe(spark, d):
    s = _told(spark, d).select(F.split("text", r"[ .]+").alias("w"))
    event = F.struct(F.array(F.col("w")[0]).alias("source"), F.col("w")[1].alias("relation"), F.array(F.col("w")[3]).alias("target"))
    return s.select(event.alias("e")).select(E.describe_event(F.col("e")).alias("described"), E.is_binary(F.col("e")).alias("binary"))


# files: what is written into the shared folder and read again


def _folder(spark) -> str:
    """A new folder under the shared one, as a path that the driver can write to."""
    return f"{checkpoint_folder(spark).removeprefix('file://')}/files-{uuid.uuid4().hex}"


@_register("SELECT 'region' || n_regionkey AS edge_id, n_name AS node FROM nation")
def io_graph_json(spark, d):
    path = f"{_folder(spark)}/graph.json"
    n = _table(spark, d, "nation")
    files.save_graph_json(Hypergraph.from_incidence(n.select(_tagged("region", "n_regionkey").alias("edge_id"), F.col("n_name").alias("node"))), path)
    return files.load_graph_json(spark, path).incidence


@_register("SELECT DISTINCT 'o' || l_orderkey AS edge_id, 'p' || l_partkey AS node FROM lineitem")
def io_graph_parquet(spark, d):
    folder = _folder(spark)
    files.save_graph_parquet(order_parts(spark, d), folder)
    return files.load_graph_parquet(spark, folder).incidence


@_register(f"SELECT edge, c_name AS source, array_to_string(parts, '|') AS target, chunk_id FROM {_EVT}")
def io_metadata_json(spark, d):
    path = f"{_folder(spark)}/metadata.json"
    files.save_metadata_json(E.to_hypergraph(order_events(spark, d))[1], path)
    return files.load_metadata_json(spark, path).select("edge", F.array_join("source", "|").alias("source"), F.array_join("target", "|").alias("target"), "chunk_id")


@_register(_values_sql(f"SELECT node, e FROM {_VEC}"))
def io_embeddings_json(spark, d):
    path = f"{_folder(spark)}/embeddings.json"
    files.save_embeddings_json(vector_graph(spark, d)[1], path)
    return _values(files.load_embeddings_json(spark, path))


@_register("SELECT DISTINCT md5(text) AS chunk_id, text FROM conversations")
def io_chunks_json(spark, d):
    path = f"{_folder(spark)}/chunks.json"
    files.save_chunks_json(ChunkIndex(_table(spark, d, "conversations").select(content_id(F.col("text")).alias("chunk_id"), "text").distinct()), path)
    return files.load_chunks_json(spark, path).df


def _nation_files(spark, d) -> str:
    folder = _folder(spark)
    for r in _table(spark, d, "nation").collect():
        ending = "md" if r.n_nationkey % 3 else "MD" if r.n_nationkey % 2 else "txt"
        files._write_text(f"# {r.n_name}\n\nIt lies in region {r.n_regionkey}.", f"{folder}/{'deep/' if r.n_nationkey % 5 == 0 else ''}n{r.n_nationkey}.{ending}")
    return folder


_FILES = "(SELECT n_nationkey, 'n' || n_nationkey AS document_id, '# ' || n_name || chr(10) || chr(10) || 'It lies in region ' || n_regionkey || '.' AS text FROM nation WHERE n_nationkey % 3 > 0 OR n_nationkey % 2 = 1)"


@_register(f"SELECT document_id, text FROM {_FILES}")
def io_markdown_folder(spark, d):
    return files.read_markdown_directory(spark, _nation_files(spark, d), True).select("document_id", "text")


@_register(f"SELECT document_id, text FROM {_FILES} WHERE n_nationkey % 5 > 0")
def io_markdown_flat(spark, d):
    return files.read_markdown_directory(spark, _nation_files(spark, d)).select("document_id", "text")


@_register(f"SELECT document_id, text FROM {_FILES} WHERE n_nationkey = 7")
def io_markdown_file(spark, d):
    return files.read_markdown(spark, f"{_nation_files(spark, d)}/n7.md").select("document_id", "text")


@_register(f"SELECT edge_id, node FROM ({_TOLD_PAIRS})")
def io_result_bundle(spark, d):
    """Saved as JSON, read, saved as Parquet and read again."""
    folder = _folder(spark)
    result = _processor().process_documents(_told(spark, d))
    result.save(folder)
    files.save_result(files.load_result(spark, folder), folder, "parquet")
    return files.load_result(spark, folder, format="parquet").graph.incidence

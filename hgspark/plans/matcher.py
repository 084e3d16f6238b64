"""Matching of keywords to nodes: equal or contained names first, similar vectors only where there are none."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EMBEDDING_MODEL, MATCH_THRESHOLD, TOP_K
from ..operators.vectors import top_k_batch
from ..sources.providers import EmbeddingProvider
from ..tables import cut, sized

MATCHES = "keyword string, keyword_seq int, node string, similarity double, match_type string"


def name_score(keyword: Column, node: Column) -> Column:
    """1 for equal names, else the shorter length over the longer, at least 0.8."""
    k, n = F.lower(keyword), F.lower(node)
    share = F.least(F.length(k), F.length(n)) / F.greatest(F.length(k), F.length(n))
    return F.when(k == n, F.lit(1.0)).otherwise(F.greatest(F.lit(0.8), share))


def name_matches(keywords: DataFrame, nodes: DataFrame) -> DataFrame:
    """`keywords` (keyword, keyword_seq, ...) with nodes whose name equals, holds or is held by the keyword, ignoring
    case. Keywords are few: each node is read once and compared with all. Empty names match nothing."""
    k, n = F.lower("keyword"), F.lower("node")
    hit = (F.length("keyword") > 0) & (F.length("node") > 0) & (F.contains(n, k) | F.contains(k, n))
    asked = sized(cut(keywords))
    found = nodes.select("node").join(asked, hit)
    return found.select(*keywords.columns, "node", name_score(F.col("keyword"), F.col("node")).alias("similarity"), F.when(k == n, "exact").otherwise("substring").alias("match_type"))


def find_matches(keywords: DataFrame, embeddings: DataFrame, provider: EmbeddingProvider | None = None, *, model: str = EMBEDDING_MODEL, top_k: int = TOP_K, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """All matches of each keyword (MATCHES). Name matches ignore `top_k` and `threshold`; a keyword with any of them
    isn't compared by vector."""
    named = cut(name_matches(keywords, embeddings))
    if provider is None:
        return named
    rest = keywords.join(named.select("keyword").distinct(), "keyword", "left_anti")
    asked = sorted({r.keyword for r in rest.select("keyword").distinct().collect()})
    if not asked:
        return named
    vectors = provider.embed(asked, model)
    queries = embeddings.sparkSession.createDataFrame([(k, [float(x) for x in v]) for k, v in zip(asked, vectors, strict=True) if v], "query string, vector array<double>")
    near = top_k_batch(queries, embeddings, top_k, threshold)
    similar = rest.join(near.withColumnRenamed("query", "keyword"), "keyword")
    return named.unionByName(similar.select(*keywords.columns, "node", "similarity", F.lit("embedding").alias("match_type")))


def best_per_node(matches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One match a node (within `by`): the most similar, of equal ones the first keyword's."""
    turn = Window.partitionBy(*by, "node").orderBy(F.desc("similarity"), "keyword_seq")
    return matches.select("*", F.row_number().over(turn).alias("__k")).where("__k = 1").drop("__k")


def matching_nodes(keywords: DataFrame, embeddings: DataFrame, provider: EmbeddingProvider | None = None, **options) -> DataFrame:
    """The nodes that match any keyword, each once, most similar first, ties by name."""
    return best_per_node(find_matches(keywords, embeddings, provider, **options)).orderBy(F.desc("similarity"), "node")


def best_matches(keywords: DataFrame, embeddings: DataFrame, provider: EmbeddingProvider | None = None, *, threshold: float = MATCH_THRESHOLD, **options) -> DataFrame:
    """(keyword, node): each keyword's most similar node."""
    found = find_matches(keywords, embeddings, provider, top_k=1, threshold=threshold, **options)
    return found.groupBy("keyword").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "node")).alias("b")).select("keyword", F.col("b.node").alias("node"))


def unique_nodes(matches: DataFrame) -> DataFrame:
    """(node, similarity): each node with its highest similarity, most similar first."""
    return matches.groupBy("node").agg(F.max("similarity").alias("similarity")).orderBy(F.desc("similarity"), "node")


def at_least(matches: DataFrame, threshold: float) -> DataFrame:
    return matches.where(F.col("similarity") >= threshold)


def unique_node_count(matches: DataFrame) -> int:
    return matches.select("node").distinct().count()


def keyword_table(spark, keywords: list[str]) -> DataFrame:
    return spark.createDataFrame([(k, i) for i, k in enumerate(keywords)], "keyword string, keyword_seq int")

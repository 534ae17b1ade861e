"""Queries on vectors, rankings and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.functions import vectors as vx
from weftline.operators import graph, ingest, retrieval, terms
from weftline.plans.registry import query, table

_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
_COS = "list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_DIST = f"greatest(0, least(2, 1 - {_COS}))"


@query("cosine_distance", f"SELECT a.vec_id, round({_DIST}, 6) AS distance FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def cosine_distance(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = retrieval.literal(retrieval.vector_of(e, 0))
    return e.select("vec_id", F.round(vx.cosine_distance(F.col("embedding"), q), 6).alias("distance"))


_TOP = f"SELECT vec_id AS id, round(1 - {_DIST}, 9) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, id LIMIT 20"


@query(
    "vector_topk",
    f"""SELECT query_id, CAST(i AS INTEGER) AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS i FROM (
    SELECT q.vec_id AS query_id, a.vec_id AS id, round({_COS}, 9) AS score FROM embeddings q, embeddings a WHERE q.vec_id % 100 = 0)) WHERE i <= 20""",
)
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 100, among all rows."""
    return retrieval.vector_search_all(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0).withColumn("score", F.round("score", 6))


_TERMS = "SELECT {key} AS key, ('0x' || substr(md5(w), 1, 4))::INTEGER % 256 AS d, count(*)::DOUBLE AS n FROM (SELECT {key}, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM {of}) GROUP BY ALL"
_UNIT = "(SELECT key, d, n / sqrt(sum(n * n) OVER (PARTITION BY key)) AS v FROM ({}))"


@query(
    "text_topk",
    f"""SELECT query_id, CAST(i AS INTEGER) AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS i FROM (
    SELECT q.key AS query_id, a.key AS id, round(sum(q.v * a.v), 9) AS score FROM {_UNIT.format(_TERMS.format(key='item_id', of='benchmark'))} q JOIN {_UNIT.format(_TERMS.format(key='doc_id', of='documents'))} a ON q.d = a.d GROUP BY ALL)) WHERE i <= 20""",
)
def text_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 documents nearest to each benchmark text, by an encoder that both share."""
    docs = terms.encode(table(spark, sf, "documents"))
    asked = terms.encode(table(spark, sf, "benchmark"), id_col="item_id")
    return retrieval.text_search(docs, asked).withColumn("score", F.round("score", 6))


@query("pairwise_cosine", f"SELECT q.vec_id AS a, a.vec_id AS b, round({_COS}, 6) AS similarity FROM embeddings q, embeddings a WHERE q.vec_id % 100 = 0")
def pairwise_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """The stated rows of the similarity matrix, those of ids divisible by 100, in blocks of matrix products."""
    return ingest.similarity_rows(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0).withColumn("similarity", F.round("similarity", 6))


_EDGES = "(SELECT vec_id AS src, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS dst FROM embeddings) WHERE dst IS NOT NULL"
_FUSED = f"""v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({_TOP})),
b AS (SELECT (SELECT id FROM v WHERE rank = 1) AS node, 0 AS depth UNION ALL SELECT e.dst, b.depth + 1 FROM b JOIN edges e ON e.src = b.node WHERE b.depth < 2),
g AS (SELECT node AS id, row_number() OVER (ORDER BY depth, node) AS rank FROM (SELECT node, min(depth) AS depth FROM b GROUP BY node)),
f AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM g) GROUP BY id)"""
_WITH = f"WITH RECURSIVE edges AS (SELECT * FROM {_EDGES}), {_FUSED}"


def _rankings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    hits = retrieval.vector_search(e, retrieval.vector_of(e, 0))
    near = graph.bfs(retrieval.sequence_graph(e), [hits.first()[0]], 2)
    by_graph = retrieval.ranked_all(near.withColumnRenamed("node", "id"), F.col("depth"), F.col("id"))
    return retrieval.rrf([retrieval.ranked(hits, F.desc("score"), F.col("id")), by_graph])


@query("rrf_fusion", f"{_WITH} SELECT id, score FROM f")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _rankings(spark, sf)


@query("fused_to_chunks", f"{_WITH} SELECT id, score, text FROM f JOIN documents ON doc_id = id")
def fused_to_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs.join(_rankings(spark, sf), "id").select("id", "score", "text")


def _kept(source: str, keys: str, order: str, budget: int) -> str:
    """DuckDB: texts within a budget; the first that does not fit is cut to sentences."""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""z AS (SELECT *, greatest(1, length(text) // 4) AS tokens, sum(greatest(1, length(text) // 4)) OVER ({part} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS used FROM {source}),
y AS (SELECT *, {budget} - (used - tokens) AS room FROM z WHERE used - tokens < {budget}),
s AS (SELECT uid, s, i, room, sum(greatest(1, length(s) // 4)) OVER (PARTITION BY uid ORDER BY i) AS su FROM (
  SELECT uid, room, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT uid, room, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS x FROM y WHERE used > {budget}))),
c AS (SELECT uid, string_agg(s, ' ' ORDER BY i) AS cut FROM s WHERE su <= room GROUP BY uid),
k AS (SELECT y.*, CASE WHEN used <= {budget} THEN text ELSE coalesce(cut, '') END AS kept FROM y LEFT JOIN c ON y.uid = c.uid)"""


@query("hybrid_context", f"{_WITH}, h AS (SELECT id, id AS uid, score, text FROM f JOIN documents ON doc_id = id), {_kept('h', '', 'score DESC, id', 4096)} SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS pos, id, score, kept FROM k WHERE kept <> ''")
def hybrid_context(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.hybrid_context(e, retrieval.sequence_graph(e), docs, retrieval.vector_of(e, 0))


@query("budget_allocate", f"WITH h AS (SELECT doc_id AS uid, lang, source, text FROM documents), {_kept('h', 'lang, source', 'uid', 4096)} SELECT uid AS doc_id, lang, source, kept FROM k WHERE kept <> ''")
def budget_allocate(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    return retrieval.allocate(docs, 4096, [F.col("doc_id")], ["lang", "source"]).select("doc_id", "lang", "source", "kept")


_LINKS = """SELECT page_id, concat('p:', page_id) AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages"""


@query("graph_nodes", f"WITH l AS ({_LINKS}) SELECT DISTINCT node FROM (SELECT src AS node FROM l UNION ALL SELECT dst FROM l)")
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.nodes(ingest.page_links(table(spark, sf, "pages")))


@query("graph_stats", f"WITH l AS ({_LINKS}) SELECT (SELECT count(*) FROM l) AS n_edges, (SELECT count(DISTINCT node) FROM (SELECT src AS node FROM l UNION ALL SELECT dst FROM l)) AS n_nodes")
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return graph.stats(ingest.page_links(table(spark, sf, "pages")))


@query("in_degree", f"WITH l AS ({_LINKS}) SELECT dst AS node, count(*) AS in_degree FROM l GROUP BY dst")
def in_degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.in_degree(ingest.page_links(table(spark, sf, "pages")))


_TREE = """edges AS (SELECT concat('r:', n_regionkey) AS src, concat('n:', n_nationkey) AS dst FROM nation
  UNION ALL SELECT concat('n:', c_nationkey), concat('c:', c_custkey) FROM customer)"""


def tree(spark: SparkSession, sf: str) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nations = table(spark, sf, "nation").select(key("r:", "n_regionkey").alias("src"), key("n:", "n_nationkey").alias("dst"))
    return nations.unionByName(table(spark, sf, "customer").select(key("n:", "c_nationkey").alias("src"), key("c:", "c_custkey").alias("dst")))


@query("bfs_khop", f"WITH RECURSIVE {_TREE}, b AS (SELECT 'r:1' AS node, 0 AS depth UNION ALL SELECT e.dst, depth + 1 FROM b JOIN edges e ON e.src = b.node WHERE depth < 2) SELECT node, min(depth) AS depth FROM b GROUP BY node")
def bfs_khop(spark: SparkSession, sf: str) -> DataFrame:
    return graph.bfs(tree(spark, sf), ["r:1"], 2)


@query("descendants", f"WITH RECURSIVE {_TREE}, b AS (SELECT dst AS node, 1 AS depth FROM edges WHERE src = 'r:2' UNION ALL SELECT e.dst, depth + 1 FROM b JOIN edges e ON e.src = b.node WHERE depth < 64) SELECT node, min(depth) AS depth FROM b GROUP BY node")
def descendants(spark: SparkSession, sf: str) -> DataFrame:
    return graph.descendants(tree(spark, sf), "r:2")


@query("ancestors", f"WITH RECURSIVE {_TREE}, b AS (SELECT src AS node, 1 AS depth FROM edges WHERE dst = 'c:7' UNION ALL SELECT e.src, depth + 1 FROM b JOIN edges e ON e.dst = b.node WHERE depth < 64) SELECT node, min(depth) AS depth FROM b GROUP BY node")
def ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return graph.ancestors(tree(spark, sf), "c:7")


@query("transitive_closure", f"WITH RECURSIVE edges AS (SELECT * FROM {_EDGES}), b AS (SELECT src, dst, 1 AS hops FROM edges UNION ALL SELECT b.src, e.dst, hops + 1 FROM b JOIN edges e ON e.src = b.dst WHERE hops < 3) SELECT src, dst, min(hops) AS hops FROM b WHERE src <> dst GROUP BY ALL")
def transitive_closure(spark: SparkSession, sf: str) -> DataFrame:
    return graph.closure(retrieval.sequence_graph(table(spark, sf, "embeddings")), 3)


@query("closure_edges", f"""WITH edges AS (SELECT * FROM {_EDGES}), two AS (SELECT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src), three AS (SELECT a.src, b.dst FROM two a JOIN edges b ON a.dst = b.src)
  SELECT src, dst, 'chunk_sequence' AS edge_type, 0.8::DOUBLE AS weight, false AS is_transitive FROM edges
  UNION ALL SELECT src, dst, 'chunk_sequence', 0.4::DOUBLE, true FROM two UNION ALL SELECT src, dst, 'chunk_sequence', 0.4::DOUBLE, true FROM three""")
def closure_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = retrieval.sequence_graph(table(spark, sf, "embeddings"))
    return graph.closure_edges(e.select("*", F.lit("chunk_sequence").alias("edge_type"), F.lit(0.8).alias("weight")))


@query("dangling_edges", f"WITH edges AS (SELECT * FROM {_EDGES}) SELECT src, dst FROM edges WHERE dst % 3 = 0 AND src % 3 <> 0")
def dangling_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return graph.dangling(retrieval.sequence_graph(e), e.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("node")))


@query("edge_weights", """SELECT l_orderkey, src_turn, dst_turn, edge_type, round(CASE edge_type WHEN 'chunk_sequence' THEN 0.8 WHEN 'schema_field_dep' THEN 0.9 ELSE 1.0 END::DOUBLE / (1 + abs(src_turn - dst_turn)), 6) AS weight
  FROM (SELECT l_orderkey, l_linenumber AS src_turn, CAST(l_quantity AS INTEGER) AS dst_turn, CASE l_suppkey % 3 WHEN 0 THEN 'chunk_sequence' WHEN 1 THEN 'schema_field_dep' ELSE 'other' END AS edge_type FROM lineitem)""")
def edge_weights(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.expr("CASE l_suppkey % 3 WHEN 0 THEN 'chunk_sequence' WHEN 1 THEN 'schema_field_dep' ELSE 'other' END")
    made = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("src_turn"), F.col("l_quantity").cast("int").alias("dst_turn"), kind.alias("edge_type"))
    return graph.edge_weights(made)


@query(
    "ingest_pages",
    r"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages),
    w AS (SELECT page_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM t),
    p AS (SELECT page_id, ws, unnest(range(0, greatest(0, CAST(ceil((len(ws) - 256) / 224.0) AS BIGINT)) + 1)) AS pos FROM w WHERE len(ws) > 0)
    SELECT concat('p:', page_id, ':chunk:', pos) AS chunk_id, concat('p:', page_id) AS doc_id, md5(array_to_string(ws[pos * 224 + 1 : pos * 224 + 256], ' ')) AS digest FROM p""",
)
def ingest_pages(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.page_chunks(table(spark, sf, "pages")).select("chunk_id", "doc_id", F.md5("chunk").alias("digest"))


@query(
    "import_edges",
    r"""WITH c AS (SELECT p_partkey, concat('import ', replace(lower(p_brand), '#', '_'), chr(10), 'from m', p_size, ' import x') AS text FROM part)
    SELECT concat('part:', p_partkey) AS src, string_split(unnest(regexp_extract_all(text, '(?m)^\s*(?:import|from)\s+([A-Za-z0-9_.]+)', 1)), '.')[1] AS dst FROM c""",
)
def import_edges(spark: SparkSession, sf: str) -> DataFrame:
    code = F.concat(F.lit("import "), F.regexp_replace(F.lower("p_brand"), "#", "_"), F.lit("\nfrom m"), F.col("p_size").cast("string"), F.lit(" import x"))
    files = table(spark, sf, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("doc_id"), code.alias("content"), F.lit("py").alias("file_type"))
    return ingest.import_edges(files)

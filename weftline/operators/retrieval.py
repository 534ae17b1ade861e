"""Vector search, rank fusion, budgeted snippets, and the hybrid retrieval that joins them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.config import DEFAULT
from weftline.functions import text as tx
from weftline.functions import vectors as vx
from weftline.operators import graph, ingest
from weftline.sources.scratch import materialize


def vector_of(vectors: DataFrame, key, id_col: str = "vec_id", vector_col: str = "embedding") -> list[float]:
    """The vector of one row: the query of a search."""
    row = vectors.filter(F.col(id_col) == key).select(vector_col).first()
    return list(row[0]) if row else []


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector]).cast("array<double>")


def vector_search(vectors: DataFrame, query: list[float], k: int = DEFAULT.top_k, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and score of the k vectors nearest to the query; ties by id. One pass and a top-k in each task."""
    score = F.round(1 - vx.cosine_distance(F.col(vector_col), literal(query)), 9)
    return vectors.select(F.col(id_col).alias("id"), score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def vector_search_all(vectors: DataFrame, asked: Column, k: int = DEFAULT.top_k, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id and score: the k vectors nearest to each of the stated rows, in blocks of matrix products; ties by id."""
    rows = ingest.similarity_rows(vectors, asked, best=k, id_col=id_col, vector_col=vector_col).withColumn("score", F.round("similarity", 9))
    best = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(F.col("a").alias("query_id"), "rank", F.col("b").alias("id"), "score")


def text_search(texts: DataFrame, asked: DataFrame, k: int = DEFAULT.top_k) -> DataFrame:
    """query_id, rank, id and score of the k texts nearest to each query; both are (id, vector) of one encoder."""
    # queries have odd keys and texts even ones, so that one table holds both
    both = texts.select((2 * F.col("id")).alias("vec_id"), F.col("vector").alias("embedding")).unionByName(asked.select((2 * F.col("id") + 1).alias("vec_id"), F.col("vector").alias("embedding")))
    near = ingest.similarity_rows(both, F.col("vec_id") % 2 == 1, best=k, among=F.col("vec_id") % 2 == 0)
    rows = near.select(F.shiftright("a", 1).alias("query_id"), F.shiftright("b", 1).alias("id"), F.round("similarity", 9).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def ranked(items: DataFrame, *order: Column) -> DataFrame:
    """Adds rank from 1. For lists already cut to k items: the window has no partitions."""
    return items.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def ranked_all(items: DataFrame, *order: Column) -> DataFrame:
    """Adds rank from 1 to a list of any length: rows are sorted by ranges, and the sizes of the ranges before are added."""
    tasks = max(8, items.sparkSession.sparkContext.defaultParallelism)
    dealt = items.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    # the lower 33 bits number the rows of a task
    dealt = materialize(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n"))  # a row for each task
    ahead = sizes.select(F.col("_part").alias("_of"), F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    return dealt.join(ahead, F.col("_part") == F.col("_of")).withColumn("rank", (F.col("_ahead") + F.col("_place") + 1).cast("int")).drop("_part", "_place", "_of", "_ahead")


def rrf(rankings: list[DataFrame], k: int = DEFAULT.rrf_k) -> DataFrame:
    """Reciprocal rank fusion of (id, rank) lists: id and score, a sum over lists of 1 / (k + rank)."""
    whole = rankings[0].select("id", "rank")
    for other in rankings[1:]:
        whole = whole.unionByName(other.select("id", "rank"))
    return whole.groupBy("id").agg(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 9).alias("score"))


def allocate(items: DataFrame, budget: int, order: list[Column], keys: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Texts in order until the budget of tokens is used.

    The first that does not fit is cut to whole sentences if any fit into what is left; nothing after it is taken.
    Every text takes a token or more, so texts beyond the first `budget` of a key can't be taken; Spark drops
    them before the shuffle, and a hot key is no more than that in one task.
    """
    keys = keys or []
    own = Window.partitionBy(*keys).orderBy(*order)
    first = items.withColumn("i", F.row_number().over(own)).filter(F.col("i") <= budget).drop("i")
    sized = first.withColumn("tokens", tx.token_estimate(F.col(text_col)))
    summed = sized.withColumn("used", F.sum("tokens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.lit(budget) - (F.col("used") - F.col("tokens"))
    cut = summed.filter(left > 0).withColumn("kept", F.when(F.col("used") <= budget, F.col(text_col)).otherwise(tx.leading_sentences(F.col(text_col), left.cast("int"))))
    return cut.filter(F.col("kept") != "").drop("tokens", "used")


def sequence_graph(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """src and dst: each vector to the next of its label.

    Rows are sorted by ranges of label and id, so a label may span as many tasks as it needs; what follows
    the last row of a range is the first of that label's next range, and of those there are as many as tasks and labels.
    """
    tasks = max(8, vectors.sparkSession.sparkContext.defaultParallelism)
    dealt = vectors.select(F.col(label_col).alias("label"), F.col(id_col).alias("id")).repartitionByRange(tasks, "label", "id")
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()), "label-ranges")
    own = F.lead("id").over(Window.partitionBy("label", "part").orderBy("id"))
    first = dealt.groupBy("label", "part").agg(F.min("id").alias("first"))
    after = F.lead("first").over(Window.partitionBy("label").orderBy("part"))
    ends = first.select(F.col("label").alias("e_label"), F.col("part").alias("e_part"), after.alias("after"))
    linked = dealt.select("label", "part", F.col("id").alias("src"), own.alias("own"))
    joined = linked.join(ends, F.col("label").eqNullSafe(F.col("e_label")) & (F.col("part") == F.col("e_part")))
    return joined.select("src", F.coalesce("own", "after").alias("dst")).filter(F.col("dst").isNotNull())


def hybrid_context(vectors: DataFrame, edges: DataFrame, texts: DataFrame, query: list[float], k: int = DEFAULT.top_k, hops: int = DEFAULT.hops, budget: int = DEFAULT.token_budget) -> DataFrame:
    """pos, id, score and kept: texts for a query, found by vectors and by the graph around the best hit, within a budget.

    texts: id and text. Ids without a text are dropped, and only ids whose text is used are cited.
    """
    hits = vector_search(vectors, query, k)
    by_vector = ranked(hits, F.desc("score"), F.col("id"))
    root = hits.orderBy(F.desc("score"), "id").select("id").first()
    near = graph.bfs(edges, [root[0]] if root else [], hops)
    by_graph = ranked_all(near.withColumnRenamed("node", "id"), F.col("depth"), F.col("id"))
    found = texts.join(rrf([by_vector, by_graph]), "id")
    kept = allocate(found, budget, [F.desc("score"), F.col("id")])
    return kept.select(F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("pos"), "id", "score", "kept")

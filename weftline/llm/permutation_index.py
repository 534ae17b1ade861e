"""Approximate nearest neighbours by a permutation index.

Equal vectors are one node, so copies cost nothing. Pivots are the nodes of smallest seeded hash,
about pivots_per_root * sqrt(nodes) of them and at most max_pivots: a uniform sample, so a crowd of
near copies gets pivots of its own and its files stay small. A node is represented by its `prefix`
nearest pivots in order, and posted in the inverted files of the first `post` of them. A query opens
the files of its `probe` nearest pivots only. There it adds up, over the pivots of its order,
prefix - max(its place, the node's place): that is what is left of the Spearman footrule distance of
the two orders once places beyond the prefix count as prefix, so the largest sums are the smallest
footrule distances. The best `share` of what it finds in a file, and at least 2 k, is ranked again by
the exact inner product in double precision. A node that is in several opened files is ranked in the
first of them.

A file holds about post / pivots_per_root * sqrt(n) nodes, so a query meets
probe * post / pivots_per_root * sqrt(n) of them at most, and the work of all queries is n^1.5 / 20
times a constant, not n^2. Files beyond file_rows nodes, and the queries of a file beyond query_rows,
are dealt to several tasks by hash, so a task's memory is bounded. Every vector is indexed. What is
found is cut to the best k + 1 of each file; no pair of rows is emitted otherwise.

Largest inner product is not a distance, so vectors get one more component,
sqrt(max norm^2 - norm^2), for the orders of pivots: angles then rank as inner products do.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part,
nor do those of another length than most; a query id on several rows is answered for each row;
rows with the query's id other than its own row are candidates; ties go to the smaller id, null last; a
null id is a candidate and no query; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.runtime import materialize

FOUND = "q_node long, node long, least long, score double"
NO_ID = np.iinfo(np.int64).max


def valid(v: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def pivot_orders(x: np.ndarray, pivots: np.ndarray, prefix: int, top: float) -> np.ndarray:
    """The `prefix` nearest pivots of each row of x, nearest first."""
    norm = (x * x).sum(axis=1)
    more = np.sqrt(np.maximum(top - norm, 0))[:, None]
    far = -(np.hstack([x, more]) @ pivots.T)
    if prefix < far.shape[1]:
        near = np.sort(np.argpartition(far, prefix - 1, axis=1)[:, :prefix], axis=1)
        return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)
    return np.argsort(far, axis=1, kind="stable")


def _index(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, prefix: int, top: float, files: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            x = np.asarray(part.column(2).flatten(), dtype=np.float64).reshape(part.num_rows, -1)
            orders = pivot_orders(x, pivots, prefix, top)
            raw = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x, orders.astype(np.uint16))]
            first = pa.array(orders[:, :files].astype(np.int32).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *raw, first], names=["node", "least", "vector", "places", "files"])


def search_file(pivot: int, least, x, orders, q, q_orders, n_pivots: int, post: int, probe: int, k: int, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the nodes of its nearest candidates in the file of a pivot, and their scores."""
    n, prefix = orders.shape
    place = np.full((n_pivots, n), prefix, dtype=np.uint8)
    place[orders.astype(np.int64).T, np.arange(n)[None, :]] = np.arange(prefix, dtype=np.uint8)[:, None]
    own = np.arange(prefix, dtype=np.uint8)[:, None]
    for j in range(len(q)):
        opened = q_orders[j].astype(np.int64)
        there = place[opened]
        earlier = (there[: int(np.flatnonzero(opened[:probe] == pivot)[0])] < post).any(axis=0)
        near = prefix * prefix - np.maximum(there, own).sum(axis=0, dtype=np.int32)
        new = np.flatnonzero(~earlier)
        keep = max(2 * k, int(np.ceil(share * len(new))))
        if keep < len(new):
            new = new[near[new] >= np.partition(near[new], len(new) - keep)[len(new) - keep]]
        score = (x[new] * q[j]).sum(axis=1)
        best = np.lexsort((least[new], -score))[: k + 1]
        yield new[best], score[best]


def _search(table: pa.Table, n_pivots: int, post: int, probe: int, k: int, share: float) -> pa.Table:
    names = [x.split()[0] for x in FOUND.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    is_query = table.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
    if is_query.all() or not is_query.any():
        return pa.table([pa.array([], t) for t in types], names=names)
    node, least = (table.column(c).to_numpy() for c in ("node", "least"))
    stack = lambda c, kind: np.stack([np.frombuffer(v, kind) for v in table.column(c).to_pylist()])
    x, orders = stack("vector", np.float64), stack("places", np.uint16)
    at = np.argsort(node, kind="stable")
    c, q = at[~is_query[at]], at[is_query[at]]
    out: list[list] = [[], [], [], []]
    for j, (found, score) in enumerate(search_file(table.column("pivot")[0].as_py(), least[c], x[c], orders[c], x[q], orders[q], n_pivots, post, probe, k, share)):
        for held, part in zip(out, (np.full(len(found), node[q[j]]), node[c][found], least[c][found], score), strict=True):
            held.append(part)
    return pa.table([pa.array(np.concatenate(a), t) for a, t in zip(out, types, strict=True)], names=names)


def build(base: DataFrame, n: int, top: float, pivots_per_root: float, max_pivots: int, prefix: int, files: int, seed: int) -> tuple[DataFrame, int]:
    """The index (node, least, vector, places, files) of nodes (node, least, v), and the number of pivots."""
    wanted = min(n, max_pivots, int(np.ceil(pivots_per_root * n**0.5)))
    rows = base.orderBy(F.xxhash64(F.lit(seed), F.col("node")), "node").limit(wanted).select("v").collect()  # at most max_pivots rows
    p = np.array([r[0] for r in rows], dtype=np.float64)
    p = np.hstack([p, np.sqrt(np.maximum(top - (p * p).sum(axis=1), 0))[:, None]])
    p /= np.sqrt((p * p).sum(axis=1))[:, None]
    length = min(prefix, len(p))
    made = base.select("node", "least", "v").mapInArrow(lambda b: _index(b, p, length, top, files), "node long, least long, vector binary, places binary, files array<int>")
    return materialize(made, "ann-index"), len(p)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, pivots_per_root: float = 4.0, max_pivots: int = 1 << 15, prefix: int = 128, post: int = 8, probe: int = 64, share: float = 0.35,
    file_rows: int = 2048, query_rows: int = 1024, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score. is_query: a condition on vec_id. prefix is at most 255."""
    spark = vectors.sparkSession
    base = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    base = base.filter(valid(F.col("v"))).select("*", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(seed), F.col("v")).alias("h2"))
    base = materialize(base, "ann-rows")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sizes = base.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("top")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = base.filter(F.size("v") == sizes[0]["dim"])
    nodes = base.groupBy("h1", "h2").agg(F.min("row").alias("node"), F.coalesce(F.min("vec_id"), F.lit(NO_ID)).alias("least"), F.min_by("v", "row").alias("v"))
    nodes = materialize(nodes, "ann-nodes")
    index, n_pivots = build(nodes, nodes.count(), sizes[0]["top"], pivots_per_root, max_pivots, prefix, max(post, probe), seed)

    named = nodes.select(F.col("h1").alias("n1"), F.col("h2").alias("n2"), "node").hint("merge")
    of_node = (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2"))
    asked = materialize(base.filter(is_query).select("row", "vec_id", "h1", "h2").join(named, of_node).select("row", F.col("vec_id").alias("query_id"), F.col("node").alias("q_node")), "ann-queries")
    # of the rows of a node, the k + 1 of smallest id are all that a query may need
    in_node = Window.partitionBy("h1", "h2").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    members = base.select("row", "vec_id", "h1", "h2").withColumn("place", F.row_number().over(in_node)).filter(F.col("place") <= k + 1)
    members = materialize(members.join(named, of_node).select(F.col("node").alias("m_node"), "row", "vec_id"), "ann-members")

    queries = index.join(asked.select(F.col("q_node").alias("node")).distinct().hint("merge"), "node", "left_semi")
    posted = index.select("node", "least", "vector", "places", F.lit(False).alias("is_query"), F.explode(F.slice("files", 1, post)).alias("pivot"))
    opened = queries.select("node", "least", "vector", "places", F.lit(True).alias("is_query"), F.explode(F.slice("files", 1, probe)).alias("pivot"))
    # a row for each pivot, at most max_pivots
    of_pivot = posted.select("pivot", "is_query").unionByName(opened.select("pivot", "is_query")).groupBy(F.col("pivot").alias("s_pivot"))
    sized = of_pivot.agg(F.count_if(~F.col("is_query")).alias("n"), F.count_if("is_query").alias("q"))
    sized = materialize(sized.select("s_pivot", F.greatest(F.ceil(F.col("n") / file_rows), F.lit(1)).cast("int").alias("parts"), F.greatest(F.ceil(F.col("q") / query_rows), F.lit(1)).cast("int").alias("q_parts")), "ann-files")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    deal = lambda m: F.pmod(F.xxhash64("node"), F.col(m)).cast("int")
    side = lambda rows, own, other: rows.join(F.broadcast(sized), F.col("pivot") == F.col("s_pivot")).withColumn(own[1], deal(own[0])).withColumn(other[1], every(other[0])).drop("s_pivot", "parts", "q_parts")
    left = side(posted, ("parts", "part"), ("q_parts", "q_part"))
    right = side(opened, ("q_parts", "q_part"), ("parts", "part"))
    found = left.unionByName(right).groupBy("pivot", "part", "q_part").applyInArrow(lambda t: _search(t, n_pivots, min(post, n_pivots), probe, k, share), FOUND)

    best = Window.partitionBy("q_node").orderBy(F.desc("score"), "least", "node")
    found = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).select("q_node", "node", "score")
    rows = found.join(members, F.col("node") == F.col("m_node")).select("q_node", "score", "vec_id", "row")
    order = Window.partitionBy("q_node").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    rows = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    lists = rows.groupBy(F.col("q_node").alias("l_node")).agg(F.sort_array(F.collect_list(F.struct("place", "row", "vec_id", "score"))).alias("found"))  # k + 1 at most
    told = asked.join(lists, F.col("q_node") == F.col("l_node")).select("query_id", F.slice(F.filter("found", lambda x: x["row"] != F.col("row")), 1, k).alias("found"))
    return told.select("query_id", F.posexplode("found").alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), "x.vec_id", "x.score")

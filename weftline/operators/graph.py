"""Graphs as edge tables: node sets, degrees, reachability and closure.

Traversals go hop by hop with a join of the frontier to the edges. The frontier is a table of
distinct nodes; each hop's result is checkpointed, so that plans stay short and lost executors
lose nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.config import DEFAULT
from weftline.sources.scratch import materialize


def nodes(edges: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Distinct nodes of edges, and of a table of nodes."""
    out = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    if extra is not None:
        out = out.unionByName(extra.select("node"))
    return out.distinct()


def upsert_nodes(old: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """Nodes by id, the latest of each."""
    both = old.unionByName(new)
    return both.groupBy("node").agg(F.max_by(F.struct(*[c for c in both.columns if c != "node"]), order).alias("x")).select("node", "x.*")


def in_degree(edges: DataFrame) -> DataFrame:
    """node and in_degree; repeated edges count."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))


def stats(edges: DataFrame) -> DataFrame:
    """n_edges and n_nodes."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    return ends.agg(F.coalesce(F.expr("sum(n) div 2"), F.lit(0)).alias("n_edges"), F.count("*").alias("n_nodes"))


def bfs(edges: DataFrame, starts: list, hops: int = DEFAULT.hops) -> DataFrame:
    """node and depth of all that is reached from the starts, which are in the result even if unknown."""
    spark, kind = edges.sparkSession, edges.schema["src"].dataType.simpleString()
    seen = spark.createDataFrame([(s, 0) for s in starts], f"node {kind}, depth int")
    return spread(edges, seen, hops)


def spread(edges: DataFrame, seen: DataFrame, hops: int, depth_from: int = 1) -> DataFrame:
    """Adds to (node, depth) what is reached from it, up to depth `hops`."""
    frontier = seen
    for depth in range(depth_from, hops + 1):
        reached = edges.join(frontier, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct()
        frontier = materialize(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        seen = seen.unionByName(frontier)
        if frontier.limit(1).count() == 0:
            break
    return seen


def descendants(edges: DataFrame, start, hops: int = 64) -> DataFrame:
    """node and depth of what is reached from start, without start unless a cycle leads back."""
    first = edges.filter(F.col("src") == start).select(F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(1))
    return spread(edges, materialize(first, "frontier"), hops, 2)


def ancestors(edges: DataFrame, start, hops: int = 64) -> DataFrame:
    return descendants(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, hops)


def closure(edges: DataFrame, hops: int = DEFAULT.max_hops) -> DataFrame:
    """src, dst and the least number of hops of all pairs within `hops`, semi-naive: each round extends only new pairs."""
    base = materialize(edges.select("src", "dst").filter("src <> dst").distinct().withColumn("hops", F.lit(1)), "closure")
    step = base.select(F.col("src").alias("mid"), F.col("dst").alias("to"))
    known, new = base, base
    for n in range(2, hops + 1):
        longer = new.join(step, F.col("dst") == F.col("mid")).select("src", F.col("to").alias("dst")).filter("src <> dst").distinct()
        new = materialize(longer.join(known.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("hops", F.lit(n)), "closure")
        known = known.unionByName(new)
        if new.limit(1).count() == 0:
            break
    return known


def closure_edges(edges: DataFrame, hops: int = DEFAULT.max_hops, weight: float = DEFAULT.transitive_weight) -> DataFrame:
    """The edges and the transitive ones they lack; a transitive edge has half the weight and the type of its last edge."""
    have = edges.select("src", "dst", "edge_type", "weight", F.lit(False).alias("is_transitive"))
    reached = closure(edges, hops)
    pairs = reached.filter("hops > 1")
    last = edges.select(F.col("src").alias("l_src"), F.col("dst").alias("l_dst"), "edge_type", "weight")
    before = reached.select(F.col("src").alias("b_src"), F.col("dst").alias("b_dst"), (F.col("hops") + 1).alias("b_hops"))
    ends = pairs.join(before, (F.col("src") == F.col("b_src")) & (F.col("hops") == F.col("b_hops"))).join(last, (F.col("b_dst") == F.col("l_src")) & (F.col("dst") == F.col("l_dst")))
    made = ends.groupBy("src", "dst").agg(F.min(F.struct("b_dst", "edge_type", "weight")).alias("x"))
    return have.unionByName(made.select("src", "dst", "x.edge_type", (F.col("x.weight") * weight).alias("weight"), F.lit(True).alias("is_transitive")))


def dangling(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges into the selection whose source is not selected."""
    chosen = selected.select("node")
    into = edges.join(chosen, F.col("dst") == F.col("node"), "left_semi")
    return into.join(chosen, F.col("src") == F.col("node"), "left_anti")


#: Weights of edges by type.
EDGE_WEIGHTS = {
    "var_def_to_ref": 1.0,
    "func_def_to_call": 1.0,
    "class_def_to_use": 1.0,
    "import_to_use": 1.0,
    "schema_field_dep": 0.9,
    "tool_field_to_code_ref": 0.9,
    "chunk_sequence": 0.8,
    "coref_antecedent": 0.5,
}


def edge_weights(edges: DataFrame) -> DataFrame:
    """Weight of the type, divided by 1 + the distance in turns."""
    kinds = F.create_map(*[x for k, v in EDGE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    far = F.abs(F.col("src_turn") - F.col("dst_turn"))
    return edges.withColumn("weight", F.round(F.coalesce(kinds[F.col("edge_type")], F.lit(1.0)) / (1 + far), 6))

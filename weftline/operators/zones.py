"""Conversations: rows of turns, zones by token budget, graduation, assembly, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.config import DEFAULT
from weftline.functions import text as tx


def parse_messages(raw: DataFrame, base: Column | None = None, count=tx.token_estimate) -> DataFrame:
    """session, role (user by default), content, token_count and turn_index of turns (session, seq, role, content).

    count: a function of a text column to its number of tokens; a pandas UDF of a tokenizer will do.
    """
    start = F.lit(0) if base is None else base
    return raw.select(
        "session", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("content", F.lit("")).alias("content"),
        count(F.coalesce("content", F.lit(""))).cast("int").alias("token_count"), (start + F.col("seq")).cast("int").alias("turn_index"),
    )


def assign_zones(turns: DataFrame, tail: int = DEFAULT.tail_tokens) -> DataFrame:
    """Adds zone: P for the system's turns, R for the latest turns that fit into the tail, T for the rest."""
    newest = Window.partitionBy("session").orderBy(F.desc("turn_index")).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.when(F.col("role") == "system", 0).otherwise(F.col("token_count"))).over(newest)
    return turns.withColumn("zone", F.when(F.col("role") == "system", "P").when(used <= tail, "R").otherwise("T"))


def graduate(zoned: DataFrame, retention: int = DEFAULT.retention) -> DataFrame:
    """Turns of zone R that are at least `retention` turns older than the last one move to T."""
    age = F.max("turn_index").over(Window.partitionBy("session")) - F.col("turn_index")
    return zoned.withColumn("zone", F.when((F.col("zone") == "R") & (age >= retention), "T").otherwise(F.col("zone")))


def zone_summary(zoned: DataFrame, total: int = DEFAULT.total_tokens, tail: int = DEFAULT.tail_tokens, block: int = DEFAULT.block) -> DataFrame:
    """Tokens of each zone, the budget of T, and whether compaction is needed. P is padded to whole blocks."""
    tokens = lambda z: F.sum(F.when(F.col("zone") == z, F.col("token_count")).otherwise(0)).cast("long")
    out = zoned.groupBy("session").agg(tokens("P").alias("p"), tokens("T").alias("t"), tokens("R").alias("r"))
    p = F.ceil(F.col("p") / block) * block
    return out.select("session", p.cast("long").alias("p_tokens"), F.col("t").alias("t_tokens"), F.col("r").alias("r_tokens"), (total - p - tail).cast("long").alias("t_budget")).withColumn(
        "compaction_required", F.col("t_tokens") > F.col("t_budget")
    )


def zone_violations(summary: DataFrame, total: int = DEFAULT.total_tokens, tail: int = DEFAULT.tail_tokens) -> DataFrame:
    """Sessions that break a rule, with the first rule that they break."""
    rule = F.when(F.col("r_tokens") > tail, "tail").when(F.col("p_tokens") + tail > total, "prefix").when(F.col("p_tokens") + F.col("t_tokens") + F.col("r_tokens") > total, "total")
    return summary.select("session", rule.alias("rule")).filter(F.col("rule").isNotNull())


def zone_offsets(zoned: DataFrame) -> DataFrame:
    """Adds start_token and end_token: where each turn lies in the assembled sequence P, T, R of its session."""
    part = F.when(F.col("zone") == "P", 0).when(F.col("zone") == "T", 1).otherwise(2)
    so_far = F.sum("token_count").over(Window.partitionBy("session").orderBy(part, "turn_index").rowsBetween(Window.unboundedPreceding, 0))
    return zoned.withColumn("end_token", so_far).withColumn("start_token", F.col("end_token") - F.col("token_count"))


def session_stats(turns: DataFrame) -> DataFrame:
    return turns.groupBy("session").agg(F.max("turn_index").alias("last_turn"), F.count("*").alias("n_turns"), F.sum("token_count").cast("long").alias("tokens"))


def replace_prefix(turns: DataFrame, prefix: str) -> DataFrame:
    """The content of system turns becomes the prefix, and the count of tokens with it."""
    system = F.col("role") == "system"
    content = F.when(system, F.lit(prefix)).otherwise(F.col("content"))
    return turns.withColumn("content", content).withColumn("token_count", tx.token_estimate(F.col("content")))


def assemble(zoned: DataFrame, memory: DataFrame | None = None, compacted: DataFrame | None = None) -> DataFrame:
    """The messages of each session in order (P, memory block, T or its compacted text, R), joined, with tokens_in.

    memory and compacted: session and content. A session is one row, so its turns meet in one task.
    """
    part = F.when(F.col("zone") == "P", 0).when(F.col("zone") == "T", 2).otherwise(3)
    rows = zoned.select("session", part.alias("part"), "turn_index", "role", "content")
    if compacted is not None:
        done = compacted.select("session")
        rows = rows.join(done.withColumn("part", F.lit(2)), ["session", "part"], "left_anti").unionByName(
            compacted.select("session", F.lit(2).alias("part"), F.lit(0).alias("turn_index"), F.lit("user").alias("role"), "content")
        )
    if memory is not None:
        rows = rows.unionByName(memory.filter("content <> ''").select("session", F.lit(1).alias("part"), F.lit(0).alias("turn_index"), F.lit("system").alias("role"), "content"))
    ordered = F.sort_array(F.collect_list(F.struct("part", "turn_index", "role", "content")))
    joined = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")
    tokens = F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.floor(F.length(x["content"]) / 4))
    return rows.groupBy("session").agg(ordered.alias("m")).select("session", F.size("m").alias("n_messages"), joined.alias("payload"), tokens.alias("tokens_in"))


def upsert_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshots by session: the new one wins, created_at of the old one stays."""
    o = old.select("session", *[F.col(c).alias(f"o_{c}") for c in old.columns if c != "session"])
    joined = new.withColumn("is_new", F.lit(True)).join(o, "session", "full")
    pick = lambda c: F.when(F.col("is_new"), F.col(c)).otherwise(F.col(f"o_{c}")).alias(c)
    return joined.select("session", *[F.coalesce("o_created_at", "created_at").alias(c) if c == "created_at" else pick(c) for c in old.columns if c != "session"])

"""Mix sources to target weights by capped water-filling.

Each source asks for its weight's share of all words, but no source is repeated more than
max_epochs times: a source above that stops there and the rest is shared again by weight until
none is above. The fixed point has a closed form: with sources in order of cap / weight, the
first so many are full and the others get level * weight, so one sorted pass over the table of
sources (not of documents) gives the targets.

Documents are then taken by whole repetitions, floor(target / size of the source), and a
fraction: in the order of a seeded hash, documents are added until the source's rest is
reached, and the one that crosses the line is added if that comes nearer. The crossing document
is found without a running sum over a source: two passes add up sizes by the leading 12 bits
and by the next 12 bits of the hash, and only the documents in the crossing bucket of each
source, one in 16 million, are ordered. So a hot source is never in one task.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a
null id hashes as an empty string; rows with equal id and source are taken or left together; a
source of size 0 has target 0 and nothing is taken; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.runtime import WORD, materialize

#: Bits of the two passes and of what is left of a 60-bit hash.
BITS, REST = 12, 36


def seeded_hash(key: Column, seed: int) -> Column:
    """60 bits, the same in every engine that has md5."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def water_fill(sources: DataFrame, weights: list[float], max_epochs: float) -> DataFrame:
    """source, source_size, target. sources: source and source_size, a row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    weighed = sources.select("source", "source_size", w.alias("weight"))
    caps = weighed.select("*", (max_epochs * F.col("source_size")).alias("cap"))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    stepped = caps.select(
        "*",
        ((F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"),
    )
    # the level of the first source that its cap does not hold back
    found = stepped.select("*", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(whole)["level"].alias("final"))
    return found.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def allot(sized: DataFrame, weights: tuple[float, ...], max_epochs: float) -> DataFrame:
    """p_source, source_size, target, whole repetitions, and the limit up to which a hash is taken once more.

    sized: source, size and h of each document.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = materialize(
        water_fill(totals, list(weights), max_epochs).select("*", F.floor(ratio).alias("whole")).select("*", (F.col("target") - F.col("whole") * F.col("source_size")).alias("part")), "mix-plan"
    ).select(F.col("source").alias("p_source"), "source_size", "target", "whole", "part")
    same = F.col("source").eqNullSafe(F.col("p_source"))
    top, mid = F.shiftright("h", REST + BITS), F.shiftright("h", REST)

    # the crossing bucket of each source, twice finer; ahead: words in the buckets before it
    def cross(buckets: DataFrame) -> DataFrame:
        run = Window.partitionBy("p_source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        summed = buckets.select("*", (F.col("ahead") + F.sum("size").over(run)).alias("after"))
        return summed.filter((F.col("after") >= F.col("part")) & (F.col("after") - F.col("size") < F.col("part"))).select("p_source", "part", "b", (F.col("after") - F.col("size")).alias("ahead"))

    first = sized.groupBy("source", top.alias("b")).agg(F.sum("size").alias("size")).join(plan, same)
    at1 = cross(first.select("p_source", "part", "b", "size", F.lit(0).cast("long").alias("ahead")))
    at1 = materialize(at1, "mix-cross").withColumnsRenamed({"b": "b1"})
    second = sized.join(at1, same & (top == F.col("b1"))).groupBy("p_source", "part", "ahead", mid.alias("b")).agg(F.sum("size").alias("size"))
    at2 = materialize(cross(second), "mix-cross").withColumnsRenamed({"b": "b2"})
    third = sized.join(at2, same & (mid == F.col("b2"))).groupBy("p_source", "part", "ahead", "h").agg(F.sum("size").alias("size"))
    run = Window.partitionBy("p_source").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    last = third.select("*", (F.col("ahead") + F.sum("size").over(run)).alias("after"))
    # every hash up to the limit is taken once more
    limits = last.filter((2 * F.col("after") - F.col("size")) < 2 * F.col("part")).groupBy("p_source").agg(F.max("h").alias("limit"))
    edge = at2.select("p_source", F.shiftleft("b2", REST).alias("edge"))
    full = plan.join(edge.withColumnRenamed("p_source", "e_source"), F.col("p_source").eqNullSafe(F.col("e_source")), "left").join(limits.withColumnRenamed("p_source", "l_source"), F.col("p_source").eqNullSafe(F.col("l_source")), "left")
    return full.select("p_source", "source_size", "target", "whole", F.coalesce("limit", F.col("edge") - 1, F.lit(-1).cast("long")).alias("limit"))


def _repeats(h: Column) -> Column:
    return (F.col("whole") + F.when(h <= F.col("limit"), 1).otherwise(0)).cast("long")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3, seed: int = 17, id_col: str = "doc_id",
    source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """doc_id, size, source_size, target, taken (words) and repeats of every document."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), seeded_hash(F.col(id_col), seed).alias("h")), "mix-sizes")
    full = materialize(allot(sized, weights, max_epochs), "mix-limits")
    out = sized.join(full, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("repeats", _repeats(F.col("h")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")


def mixed(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3, seed: int = 17, id_col: str = "doc_id",
    source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The documents, each as often as the mix takes it, with all their columns."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    sized = materialize(docs.select(F.col(source_col).alias("source"), size.alias("size"), seeded_hash(F.col(id_col), seed).alias("h")), "mix-sizes")
    full = materialize(allot(sized, weights, max_epochs).select("p_source", "whole", "limit"), "mix-limits")
    whole = docs.select(F.struct("*").alias("doc"))
    joined = whole.join(full, F.col(f"doc.{source_col}").eqNullSafe(F.col("p_source")))
    times = F.sequence(F.lit(1).cast("long"), _repeats(seeded_hash(F.col(f"doc.{id_col}"), seed)))
    return joined.filter(_repeats(seeded_hash(F.col(f"doc.{id_col}"), seed)) > 0).select("doc", F.explode(times)).select("doc.*")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17'), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS size FROM d GROUP BY source),
k AS (SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
o AS (SELECT *, 3 * size AS cap, 3 * size / w AS need, row_number() OVER (ORDER BY 3 * size / w, encode(source) NULLS LAST) AS i FROM k),
f AS (SELECT *, ((SELECT sum(size) FROM k) - coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / ((SELECT sum(w) FROM k) - coalesce(sum(w) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM o),
t AS (SELECT source, size, least(cap, w * coalesce((SELECT level FROM f WHERE level * w <= cap ORDER BY i LIMIT 1), cap / w)) AS target FROM f),
p AS (SELECT *, CASE WHEN size > 0 THEN floor(target / size) ELSE 0 END AS whole FROM t),
x AS (SELECT d.*, p.size AS source_size, target, whole, target - whole * p.size AS part,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS after,
    sum(d.size) OVER (PARTITION BY d.source, h) AS tied FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * (whole + CASE WHEN 2 * after - tied < 2 * part THEN 1 ELSE 0 END) AS BIGINT) AS taken,
  CAST(whole + CASE WHEN 2 * after - tied < 2 * part THEN 1 ELSE 0 END AS BIGINT) AS repeats FROM x
"""

"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from weftline.llm import bag_minhash, line_dedup, mixing, packing, permutation_index, pu_classifier, quality_rules, secret_scan, training_order, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later copies of repeated runs of lines: text, lines before, and numbers of the deleted lines."""
    out = line_dedup.line_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines", F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record in the archives says: size, digest, kind, and the response that a revisit refers to."""
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: counts, whether the base rules or the fences of its language and source reject it, and which."""
    return quality_rules.quality_rules(_read(spark, sf_dir, "documents"))


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all vectors."""
    return permutation_index.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its size, what its source has and is to give, and the words that the mix takes of it."""
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every training sequence as it is read back from its slot in its shard."""
    return training_order.round_trip(_read(spark, sf_dir, "documents"))


def op7_pu_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: whether it is held out, its score, and the prediction at 0.3."""
    return pu_classifier.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, and its place in a training sequence."""
    return packing.pack(_read(spark, sf_dir, "documents"))


def op9_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its class of near copies, and whether it is the one that stays."""
    return bag_minhash.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "keep")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: counts and a digest of the base spans, and all spans."""
    return secret_scan.digest(secret_scan.secret_scan(_read(spark, sf_dir, "documents")))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op2_warc": warc.SQL, "op3_quality_rules": quality_rules.SQL, "op5_mixing": mixing.SQL}

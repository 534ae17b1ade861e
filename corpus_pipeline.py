"""Documents to training sequences, in five stages.

Every stage takes any rows with the columns of documents: a null text counts as empty, a null id, language or source is
kept as it is, and columns besides these pass through all stages but the last. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bag_minhash, line_dedup, mixing, packing, pu_classifier
from weftline.llm.runtime import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like any other; repeated rows have one score, so all or none of them stay; a very long
    text is described whole. Without labels nothing is rejected.
    """
    return pu_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and the documents of which no word is left by that.

    A null or empty text has no lines and stays; of equal texts that of the smallest id keeps its lines, then the row read
    first; texts of any length are compared whole. n_chars is counted anew.
    """
    out = line_dedup.line_dedup(docs)
    emptied = (F.size("removed_lines") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.filter(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id, then the row read first.

    Texts without words, null ones too, are no copies of each other and stay; repeated rows leave one; texts of any length
    are compared whole.
    """
    return bag_minhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated until each source has its share of words.

    Texts without words weigh nothing and are taken or left by the seeded order like others; a null source is one of its
    own; rows of equal id and source are taken or left together; a document of any length is taken whole, at most three
    times.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a training sequence.

    A null or empty text is the single id 0; repeated rows, as mixing makes them, are packed each; a very long text is cut
    into whole sequences and a rest.
    """
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-duplicates", near), ("mixing", mix), ("packing", pack)]

#: Token ids, signatures and the fitted classifier are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Shared-folder tables and small helpers of the operators."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word rule: a word is a run of other characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all runs in one process, a local one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{root.rstrip('/')}/weftline"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 1 << 22):
    """Arrow batches of few rows and bytes, so that long texts don't fill the Python workers."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder, at a level of zstd, and read it back.

    Survives lost executors: the files lie in the shared folder, not on an executor.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def drop_table(df: DataFrame | None) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    path = getattr(df, "_weftline_path", None)
    if path:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def deal(table: DataFrame, n: int, tasks: int) -> DataFrame:
    """The n rows of a small table, of jobs, dealt evenly to at most `tasks` tasks of their own."""
    parts = max(1, min(n, tasks))
    numbered = table.withColumn("_job", F.row_number().over(Window.orderBy(*table.columns)))
    return numbered.repartitionById(parts, F.pmod(F.col("_job"), F.lit(parts)).cast("int")).drop("_job")


def let(value: Column, body) -> Column:
    """Evaluate value once and bind it in body: Catalyst would copy it into each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text; null gives none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))

"""Tables in the shared folder, to cut lineage in loops."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from weftline.config import ConfigError


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where that is unset and all runs in one process, a local folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ConfigError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{root.rstrip('/')}/weftline"


def spread(df: DataFrame) -> DataFrame:
    """Rows for work that costs much more than its input: dealt to all cores where the input has fewer splits, as they are beyond."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024, size: int = 1 << 24) -> Iterator[None]:
    """Arrow batches of few rows and bytes while a table is written, so that long texts don't fill the Python workers."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

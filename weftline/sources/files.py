"""Files as documents: dispatch by suffix, text, pages, PDF and inline text."""

from __future__ import annotations

import importlib.util

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from weftline.config import InputError
from weftline.functions import text as tx


@pandas_udf(StringType())
def _pdf_text(contents: pd.Series) -> pd.Series:
    import io

    from pypdf import PdfReader

    pages = contents.map(lambda b: [p.extract_text() or "" for p in PdfReader(io.BytesIO(b)).pages])
    return pages.map(lambda ps: "\n".join(p for p in ps if p))


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """doc_id (the file's name), path, file_type and text. Bad bytes become replacement characters.

    PDF text needs pypdf; without it a PDF is read as text.
    """
    try:
        raw = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise InputError(f"no such file: {', '.join(paths)}") from e
        raise
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    decoded = F.make_valid_utf8(F.col("content").cast("string"))  # bad bytes are no error
    base = raw.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), "path", F.when(suffix == "", "text").otherwise(suffix).alias("file_type"), "content", decoded.alias("plain"))
    html = F.col("file_type").isin("html", "htm")
    if importlib.util.find_spec("pypdf"):
        pdf = base.filter("file_type = 'pdf'").select("doc_id", "path", "file_type", _pdf_text("content").alias("text"))
        rest = base.filter("file_type <> 'pdf'")
        return rest.select("doc_id", "path", "file_type", F.when(html, tx.html_text(F.col("plain"))).otherwise(F.col("plain")).alias("text")).unionByName(pdf)
    return base.select("doc_id", "path", "file_type", F.when(html, tx.html_text(F.col("plain"))).otherwise(F.col("plain")).alias("text"))


def read_text(spark: SparkSession, *paths: str) -> DataFrame:
    """doc_id and text, one row for each file."""
    rows = spark.read.text(list(paths), wholetext=True).select("value", F.input_file_name().alias("path"))
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), F.col("value").alias("text"))


def inline(spark: SparkSession, text: str | list[str], doc_id: str = "inline") -> DataFrame:
    """A document from the caller's text; a list is joined by empty lines."""
    whole, name = (text, doc_id) if isinstance(text, str) else ("\n\n".join(text), "doc_batch" if doc_id == "inline" else doc_id)
    return spark.createDataFrame([(name, "inline", whole)], "doc_id string, file_type string, text string")


def ingest(spark: SparkSession, source: str | list[str], doc_id: str = "inline") -> DataFrame:
    """doc_id, file_type, text of an existing path, of a text, or of a list of texts."""
    if isinstance(source, str) and source and "\n" not in source and len(source) < 4096:
        p = spark._jvm.org.apache.hadoop.fs.Path(source) if ":" not in source.split("/")[0] or "://" in source else None
        if p is not None and p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return read_files(spark, source).select("doc_id", "file_type", "text")
    return inline(spark, source, doc_id)

"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.plans import catalog

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None or str(v) in ("<NA>", "NaT", "nan"):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype") and not getattr(v, "shape", None):
        return round(float(v), 4) if math.isfinite(float(v)) else str(v)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    d = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        d.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return d


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    ours, theirs = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda df: sorted((tuple(norm(x) for x in r) for r in df[columns].itertuples(index=False)), key=repr)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert entry.entry(spark).columns == ["pos", "id", "score", "kept"]
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""From pages, source files and vectors to chunks, edges and similarity rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.config import DEFAULT
from weftline.functions import text as tx
from weftline.operators import chunking

#: What an import looks like in each kind of file.
IMPORTS = {
    "py": r"(?m)^\s*(?:import|from)\s+([A-Za-z0-9_.]+)",
    "js": r"from\s+['\"]([^'\"]+)['\"]",
    "go": r"import\s+[\"']([^\"']+)[\"']",
    "rs": r"use\s+([A-Za-z0-9_]+)",
}
#: Other names of these kinds.
KINDS = {"python": "py", "ts": "js", "javascript": "js", "typescript": "js", "rust": "rs"}


def page_links(pages: DataFrame) -> DataFrame:
    """src and dst: each page and what its href attributes name."""
    targets = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return pages.select(F.concat(F.lit("p:"), F.col("page_id").cast("string")).alias("src"), F.explode(targets).alias("dst"))


def page_chunks(pages: DataFrame, size: int = DEFAULT.chunk_words, overlap: int = DEFAULT.chunk_overlap) -> DataFrame:
    """chunk_id, doc_id, pos and chunk of the text of each page."""
    texts = pages.select(F.concat(F.lit("p:"), F.col("page_id").cast("string")).alias("doc_id"), tx.html_text(F.col("html")).alias("text"))
    chunks = chunking.chunk_fixed(texts, size, overlap)
    return chunks.select(F.concat_ws(":", "doc_id", F.lit("chunk"), F.col("pos").cast("string")).alias("chunk_id"), "doc_id", "pos", "chunk")


def import_edges(files: DataFrame) -> DataFrame:
    """src and dst: each file and the modules it imports. files: doc_id, content and file_type."""
    kind = F.lower("file_type")
    for name, of in KINDS.items():
        kind = F.when(kind == name, F.lit(of)).otherwise(kind)
    found = F.array().cast("array<string>")
    for of, pattern in IMPORTS.items():
        names = F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
        if of == "py":
            names = F.transform(names, lambda x: F.split_part(x, F.lit("."), F.lit(1)))
        elif of == "go":
            names = F.transform(names, lambda x: F.split_part(x, F.lit("/"), F.lit(-1)))
        found = F.when(kind == of, names).otherwise(found)
    return files.select(F.col("doc_id").alias("src"), F.explode(found).alias("dst"))


def similarity_rows(vectors: DataFrame, stated: Column, block: int = 4096, best: int | None = None, among: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """a, b and similarity: cosine of each stated row with every row, or with those of `among`; the `best` of each block only, if set.

    Both sides are dealt into blocks and a pair of blocks is one matrix product, so nothing is joined
    row by row and no side is broadcast. Vectors that are null, zero or of another length than the first give no row.
    """
    whole = F.lit(True) if among is None else among
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), stated.alias("asked"), whole.alias("among")).filter(F.col("v").isNotNull())
    n, n_asked = base.agg(F.count("*"), F.count_if("asked")).first()
    rows, columns = max(1, -(-n_asked // block)), max(1, -(-n // block))
    deal = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = base.filter("asked").select("id", "v", F.lit(True).alias("left"), deal(rows).alias("r"), every(columns).alias("c"))
    right = base.filter("among").select("id", "v", F.lit(False).alias("left"), deal(columns).alias("c"), every(rows).alias("r")).select(*left.columns)

    def unit(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = [np.asarray(x, dtype=np.float64) for x in t.column("v").to_pylist()]
        keep = [i for i, x in enumerate(v) if len(x) == len(v[0]) and np.isfinite(x).all() and x.any()]
        m = np.array([v[i] for i in keep]).reshape(len(keep), -1)
        return t.column("id").to_numpy()[keep], m / np.sqrt((m * m).sum(axis=1))[:, None]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        side = table.column("left").to_numpy(zero_copy_only=False).astype(bool)
        (a, x), (b, y) = unit(table.filter(pa.array(side))), unit(table.filter(pa.array(~side)))
        for i in range(len(a)):
            if x.shape[1] == y.shape[1]:
                near = (y * x[i]).sum(axis=1)
                kept = np.lexsort((b, -near.round(9)))[:best]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), a[i])), pa.array(b[kept]), pa.array(near[kept])], names=["a", "b", "similarity"])

    def grouped(t: pa.Table) -> pa.Table:
        out = list(multiply(iter(t.to_batches()))) if t.column("left").to_numpy(zero_copy_only=False).any() else []
        return pa.Table.from_batches(out, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())]))

    return left.unionByName(right).groupBy("r", "c").applyInArrow(grouped, "a long, b long, similarity double")

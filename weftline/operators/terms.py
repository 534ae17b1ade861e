"""Terms of documents: counts, entropy, vocabulary, and vectors of hashed terms. Counts stay within a row, so only the vocabulary shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import retrieval
from weftline.sources.scratch import spread


def counted(words: Column) -> Column:
    """Array of (term, n), by term: neighbours in the sorted words are counted where they end."""

    def ends(s: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(F.get(s, i) != F.get(s, i + 1), F.lit(True)))

    def runs(s: Column) -> Column:
        return tx.let(ends(s), lambda e: F.transform(e, lambda at, k: F.struct(F.get(s, at).alias("term"), (at - F.coalesce(F.get(e, k - 1), F.lit(-1))).cast("long").alias("n"))))

    none = F.array().cast("array<struct<term:string,n:bigint>>")
    return F.coalesce(tx.let(F.sort_array(words), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(none)), none)


def entropy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Entropy in bits of the words of each document that has any: log2(all) - sum of n log2(n) / all."""

    def bits(t: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("all"), F.lit(0.0).alias("s"))
        step = lambda a, x: F.struct((a["all"] + x["n"]).alias("all"), (a["s"] + x["n"] * F.log2(x["n"])).alias("s"))
        return F.when(F.size(t) > 0, F.aggregate(t, start, step, lambda a: F.round(F.log2(a["all"]) - a["s"] / a["all"], 6)))

    docs = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    out = docs.select("doc_id", tx.let(counted(tx.words(F.col("text"))), bits).alias("entropy"))
    return out.filter(F.col("entropy").isNotNull())


def tf_l2(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, term, n and weight: term counts with unit length, over one vocabulary for all documents."""
    size = lambda t: F.sqrt(F.aggregate(t, F.lit(0).cast("long"), lambda a, x: a + x["n"] * x["n"]).cast("double"))
    told = lambda t, s: F.transform(t, lambda x: F.struct(x["term"].alias("term"), x["n"].alias("n"), F.round(x["n"] / s, 6).alias("weight")))
    docs = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    rows = tx.let(counted(tx.words(F.lower("text"))), lambda t: tx.let(size(t), lambda s: told(t, s)))
    # outer: Spark would evaluate the array once more, to filter empty ones
    return docs.select("doc_id", F.explode_outer(rows).alias("x")).filter(F.col("x").isNotNull()).select("doc_id", "x.*")


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, n_docs, first_doc and index, the terms numbered from 0 as they are first seen. Duplicates within a document go before the shuffle."""
    docs = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    seen = docs.select("doc_id", F.posexplode_outer(F.array_distinct(tx.words(F.lower("text")))).alias("pos", "term")).filter(F.col("term").isNotNull())
    found = seen.groupBy("term").agg(F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "pos")).alias("first"))
    numbered = retrieval.ranked_all(found.select("term", "n_docs", F.col("first.doc_id").alias("first_doc"), "first.pos"), F.col("first_doc"), F.col("pos"), F.col("term"))
    return numbered.select("term", "n_docs", "first_doc", (F.col("rank") - 1).cast("long").alias("index"))


def hashed_vector(dims: int = 256):
    """The default encoder: counts of terms, hashed to dims places that all texts share, with unit length; zero without a term."""

    def encode(text: Column) -> Column:
        place = lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % dims
        count = lambda c: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: (F.size(c) - F.size(F.array_remove(c, d))).cast("double"))
        size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        unit = lambda v: tx.let(size(v), lambda s: F.when(s > 0, F.transform(v, lambda x: x / s)).otherwise(v))
        return tx.let(F.transform(tx.words(F.lower(F.coalesce(text, F.lit("")))), place), lambda c: tx.let(count(c), unit))

    return encode


def encode(texts: DataFrame, encoder=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and vector of each text. encoder: any function of a text column to an array<double> column, a pandas UDF of a model too."""
    return texts.select(F.col(id_col).alias("id"), (encoder or hashed_vector())(F.col(text_col)).alias("vector"))

"""Quality classifier by positive-unlabelled learning.

Trusted positives are the labelled documents of quality 1 in the training folds; the unlabelled
set is every document. The risk is the non-negative unbiased one,
    prior * E_pos[loss(+g)] + max(0, E_all[loss(-g)] - prior * E_pos[loss(-g)]),
with logistic loss, and with the usual step back along the second part while it is negative.
Nothing is sampled: each document is described by a few rates in fixed bins, one aggregation
counts documents and positives in each combination of bins, and those counts are all that the
risk needs. There are at most prod(len(cuts) + 1) combinations (1,166,400; some thousands in
practice), whatever the input, so the counts may go to the driver. One of the rates is the mean
rarity of the document's words, in bits: words are hashed to BUCKETS buckets, and a first
aggregation counts in how many documents each bucket occurs.

The class prior is estimated on positives that the ranking has not seen: a first
positive-against-all model is fitted without the positives of fold 4, and the prior is the smallest
ratio of the share of all documents to the share of those positives over the sets that it ranks
highest.

Scores are a DataFrame expression. Labels, language, source and id are not inputs of a score.

Defined results: a null text counts as empty and is scored like an empty one; a null id is
never held out and has no label; repeated labels of an id count once, and each row of that id is a
positive and is scored; a null quality is no label; without positives every score is 0.5; a very
long text is described whole, its words held once in memory; an empty table gives an empty result;
other columns are kept by keep_good() and ignored by classify().
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.runtime import let, materialize, words

#: Cut points of each rate; a value's bin is the number of cuts that it reaches.
CUTS = {
    "length": (10, 50, 200, 1000),  # words
    "symbols": (1, 50, 200),  # of #*$%&|<> in 1000 words
    "upper": (30, 60, 150, 300, 1000),  # upper-case letters in 1000 words
    "shouts": (1, 50),  # exclamation marks in 1000 words
    "distinct": (100, 300, 450, 600, 800),  # distinct words in 1000 words
    "stops": (1, 30, 60, 150),  # full stops in 1000 words
    "echoes": (1, 50),  # words equal to the word before in 1000 words
    "word_length": (350, 450, 550, 600, 700),  # characters in 100 words
    "rarity": (20, 30, 45, 65, 90),  # mean bits of the words, in tenths
}
#: Buckets of hashed words.
BUCKETS = 1 << 14
#: Weight of the squares of weights in the risk.
RIDGE = 1e-4
SIZES = [len(c) + 1 for c in CUTS.values()]
#: Training folds, crc32 of the id mod 5: all but 0; the prior is estimated on this one.
PRIOR_FOLD = 4


@dataclass(frozen=True)
class Model:
    """bias and a weight for each bin of each rate; prior: the estimated share of good documents."""

    bias: float
    weights: tuple[tuple[float, ...], ...]
    prior: float


def _reached(cuts: tuple[int, ...]):
    """How many of the cuts a value reaches."""
    return lambda v: sum((F.when(v >= c, 1).otherwise(0) for c in cuts), F.lit(0))


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def word_bits(texts: DataFrame) -> list[int]:
    """Thousandths of bits of each bucket: -log2 of the share of the documents (text) that have a word in it."""
    n = texts.count()
    seen = texts.select(F.explode(F.array_distinct(F.transform(words(F.col("text")), bucket))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    counts = {r["bucket"]: r["n"] for r in seen.collect()}  # at most BUCKETS rows
    return [round(1000 * math.log2((n + 1) / (counts.get(b, 0) + 1))) for b in range(BUCKETS)]


def cell(text: Column, bits: list[int]) -> Column:
    """The combination of bins of a text, as one number."""
    text = F.coalesce(text, F.lit(""))
    table = F.from_json(F.lit(json.dumps(bits)), "array<int>")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    counts = lambda w: F.struct(
        F.size(w).cast("long").alias("n"),
        F.size(F.array_distinct(w)).cast("long").alias("d"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("c"),
        F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False)))).cast("long").alias("e"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.get(table, bucket(x))).alias("r"),
    )

    def code(w: Column) -> Column:
        n = F.greatest(w["n"], F.lit(1))
        per = lambda a, unit: F.floor(unit * a / n)
        rates = {
            "length": w["n"], "symbols": per(count(r"[#*$%&|<>]"), 1000), "upper": per(count(r"\p{Lu}"), 1000), "shouts": per(count("!"), 1000),
            "distinct": per(w["d"], 1000), "stops": per(count(r"\."), 1000), "echoes": per(w["e"], 1000),
            "word_length": per(w["c"], 100), "rarity": F.floor(w["r"] / (100 * n)),
        }
        out = F.lit(0).cast("long")
        for (name, cuts), n_bins in zip(CUTS.items(), SIZES, strict=True):
            out = out * n_bins + let(rates[name], _reached(cuts))
        return out

    return let(let(words(text), counts), code)


def bins(cells: np.ndarray) -> np.ndarray:
    """Bins of each rate, a column each."""
    out = []
    for n in reversed(SIZES):
        out.append(cells % n)
        cells = cells // n
    return np.stack(out[::-1], axis=1)


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 5


def held_out(id_col: Column) -> Column:
    return F.coalesce(fold(id_col) == 0, F.lit(False))


def cell_counts(coded: DataFrame, labels: DataFrame) -> DataFrame:
    """cell, n, n_pos and n_prior (the positives of the prior's fold), from doc_id and cell of all documents and doc_id and quality of labels."""
    good = labels.filter((F.col("quality") == 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("g_id")).distinct()
    joined = coded.join(good, F.col("doc_id") == F.col("g_id"), "left")
    return joined.groupBy("cell").agg(F.count("*").alias("n"), F.count("g_id").alias("n_pos"), F.count_if(fold(F.col("g_id")) == PRIOR_FOLD).alias("n_prior"))


def _descend(columns: np.ndarray, n_weights: int, gradient, steps: int) -> np.ndarray:
    """Adam from zero; columns: the weights that each cell adds up; gradient gives d risk / d score of each cell."""
    w, m, v = np.zeros(n_weights), np.zeros(n_weights), np.zeros(n_weights)
    for t in range(1, steps + 1):
        slope = gradient(w[columns].sum(axis=1))
        g = RIDGE * w
        for c in columns.T:
            g += np.bincount(c, slope, n_weights)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimate_prior(scores: np.ndarray, share: np.ndarray, pos: np.ndarray, least: float = 0.2) -> float:
    """Smallest share / pos over top-ranked sets that hold at least `least` of the positives."""
    order = np.argsort(-scores, kind="stable")
    u, p = np.cumsum(share[order]), np.cumsum(pos[order])
    last = np.append(np.diff(scores[order]) != 0, True) & (p >= least)
    return float(np.clip((u[last] / p[last]).min(), 0.01, 0.99))


def risk(z: np.ndarray, share: np.ndarray, pos: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk of scores z: of positives, and of negatives, which counts as 0 while it is negative."""
    z = np.clip(z, -40, 40)
    up, down = np.logaddexp(0, z), np.logaddexp(0, -z)
    return float(prior * (pos @ down)), float(share @ up - prior * (pos @ up))


def risk_gradient(z: np.ndarray, share: np.ndarray, pos: np.ndarray, prior: float) -> np.ndarray:
    """Slope of the risk, or while its second part is negative the step back along that part."""
    d_neg = (share - prior * pos) * _sigmoid(z)
    return -prior * pos * _sigmoid(-z) + d_neg if risk(z, share, pos, prior)[1] >= 0 else -d_neg


def fit_cells(cells: np.ndarray, n: np.ndarray, n_pos: np.ndarray, n_prior: np.ndarray, steps: int = 1500) -> Model:
    """Minimise the non-negative risk over the counts of all cells."""
    if n_pos.sum() == 0:
        return Model(0.0, tuple((0.0,) * k for k in SIZES), 0.5)
    order = np.argsort(cells)
    cells, n, n_pos, n_prior = cells[order], n[order], n_pos[order], n_prior[order]
    starts = np.cumsum([1, *SIZES])
    columns = np.hstack([np.zeros((len(cells), 1), dtype=np.int64), bins(cells) + starts[:-1]])
    share, pos = n / n.sum(), n_pos / n_pos.sum()
    # with positives in one of the two groups only, both are all of them
    ranked, counted = n_pos - n_prior, n_prior
    if not ranked.sum() or not counted.sum():
        ranked = counted = n_pos
    seen = ranked / ranked.sum()
    first = _descend(columns, starts[-1], lambda z: share * _sigmoid(z) - seen * _sigmoid(-z), steps)
    prior = estimate_prior(first[columns].sum(axis=1), share, counted / counted.sum())
    w = _descend(columns, starts[-1], lambda z: risk_gradient(z, share, pos, prior), steps)
    parts = tuple(tuple(float(v) for v in w[a : a + k]) for a, k in zip(starts, SIZES, strict=False))
    return Model(float(w[0]), parts, prior)


def fit(coded: DataFrame, labels: DataFrame) -> Model:
    rows = cell_counts(coded, labels).collect()  # at most prod(SIZES) rows
    return fit_cells(*(np.array([r[i] for r in rows], dtype=np.int64) for i in range(4)))


def score(model: Model, code: Column) -> Column:
    """Score of a document from its cell."""
    z, rest = F.lit(model.bias), code
    for weights in reversed(model.weights):
        z = z + F.get(F.array(*[F.lit(w) for w in weights]), (rest % len(weights)).cast("int"))
        rest = F.floor(rest / len(weights))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    bits = word_bits(docs.select("text"))
    coded = materialize(docs.select("doc_id", cell(F.col("text"), bits).alias("cell")), "pu-cells")
    s = score(fit(coded, labels), F.col("cell"))
    out = coded.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), s.alias("score"))
    return out.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    bits = word_bits(docs.select("text"))
    coded = materialize(docs.select(F.struct("*").alias("doc"), cell(F.col("text"), bits).alias("cell")), "pu-cells")
    model = fit(coded.select("doc.doc_id", "cell"), labels)
    return coded.filter(score(model, F.col("cell")) >= threshold).select("doc.*")

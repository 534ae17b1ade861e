"""Quality rules with thresholds that adapt to each language and source.

Every document gets fixed base counts and a few rates in whole numbers. The rates of the
documents that pass the base rules, and their numbers of words and lines, go into mergeable quantile
sketches: a sketch is the set of counts of log-linear buckets (16 buckets per power of two, so a
quantile is off by 1/16 at most), and two sketches merge by adding counts. One aggregation makes the
sketches per language and source; adding those gives the sketches per language and of everything.

The thresholds are outer fences, so a share of the documents is not thrown away by rule:
    upper = q75 + spread * max(q75 - q25, step),  lower = q25 - spread * max(q75 - q25, step).
step is what one more event does to the rate of a short document of the group, unit / q10 of its words
or lines, read from the sketch as well: the spread of a rate that is nearly always 0. q10 and q25
are the lowest values of their buckets and q75 the highest, so a fence never cuts into a bucket. Quantiles of
a group lean on those of its language, and these on those of everything, by
(size * own + weight * parent) / (size + weight): there is no size at which a group changes its rule.
The fences are joined to the documents, and a document over any of them goes.

Only DataFrame functions run: the repeated windows are found by sorting (hash, position) pairs
within the row, so no text and no window is shuffled. The counts of a hot language or source
are summed before the shuffle. A very long text is one row's work: its windows are sorted in
memory, 16 bytes a word.

Defined results: a null text counts as empty (no words, so it fails the base rules); a null
language or source is a group of its own; repeated rows are judged alike; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.runtime import let, materialize, words

#: name: (spread, unit, what the rate is per, whether there is a lower fence)
RULES = {
    "symbol_rate": (4, 1000, "n_words", False),  # symbols in 1000 words
    "upper_rate": (8, 1000, "n_words", False),  # upper-case letters in 1000 words
    "dup_line_rate": (1, 1000, "n_lines", False),  # repeated lines in 1000 lines that have a word
    "repeat_rate": (40, 1000, "n_words", False),  # words in repeated windows in 1000 words
    "word_length": (3, 100, "n_words", True),  # characters in 100 words
}
SKETCHED = (*RULES, "n_words", "n_lines")


def repeated_words(w: Column) -> Column:
    """Number of words within 3-word windows that occur at least twice in w."""
    n = F.size(w)
    hashes = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
    )

    def places(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        hit = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = lambda p: F.aggregate(
        p,
        start,
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return F.when(n < 4, F.lit(0)).otherwise(covered(let(F.sort_array(hashes), places)))


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, source and the whole-number counts of each document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    of_lines = lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
    )
    return docs.select(
        F.col(id_col).alias("doc_id"),
        "lang",
        "source",
        let(words(F.col(text_col)), counts).alias("w"),
        let(lines, of_lines).alias("l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    ).select("doc_id", "lang", "source", "w.*", "l.*", "n_symbols", "n_upper")


def with_rates(counts: DataFrame, min_words: int, max_repeat_percent: int) -> DataFrame:
    rate = lambda a, b, unit: F.when(F.col(b) > 0, F.expr(f"{unit} * {a} div {b}")).otherwise(F.lit(0).cast("long"))
    return counts.select(
        "*",
        ((F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))).alias("base_failed"),
        rate("n_symbols", "n_words", 1000).alias("symbol_rate"),
        rate("n_upper", "n_words", 1000).alias("upper_rate"),
        rate("n_dup_lines", "n_lines", 1000).alias("dup_line_rate"),
        rate("n_repeat_words", "n_words", 1000).alias("repeat_rate"),
        rate("word_chars", "n_words", 100).alias("word_length"),
    )


def sketch(rated: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, n: the sketch of each rule in each language and source."""
    long = rated.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("v")) for r in SKETCHED])).alias("x"))
    v = F.col("x.v")
    bucket = F.when(v < 16, v).otherwise(F.expr("(length(bin(x.v)) - 4) * 16 + shiftright(x.v, length(bin(x.v)) - 5) - 16"))
    return long.groupBy("lang", "source", F.col("x.rule").alias("rule"), bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rule, size, q10, q25, q75: quantiles of merged sketches, the lowest value of its bucket for q10 and q25, the highest for q75."""
    merged = sketches.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rule")
    ranked = merged.select(
        "*", F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.sum("n").over(group).alias("size")
    )
    b = F.col("bucket")
    low = F.when(b < 16, b.cast("long")).otherwise(F.expr("shiftleft(cast(16 + bucket % 16 as bigint), bucket div 16 - 1)"))
    top = F.when(b < 16, b.cast("long")).otherwise(F.expr("shiftleft(cast(17 + bucket % 16 as bigint), bucket div 16 - 1) - 1"))
    at = lambda q, value: F.min(F.when(F.col("cum") * 100 >= q * F.col("size"), value)).alias(f"q{q}")
    return ranked.groupBy(*keys, "rule").agg(F.first("size").alias("size"), at(10, low), at(25, low), at(75, top))


def thresholds(sketches: DataFrame, weight: int) -> DataFrame:
    """lang, source, and upper and lower fence of each rule for each group."""
    own = quantiles(sketches, ["lang", "source"])
    lang = quantiles(sketches, ["lang"]).select(F.col("lang").alias("l_lang"), F.col("rule").alias("l_rule"), F.struct("size", "q10", "q25", "q75").alias("of_lang"))
    whole = quantiles(sketches, []).select(F.col("rule").alias("a_rule"), F.struct("q10", "q25", "q75").alias("of_all"))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rule") == F.col("l_rule"))).join(whole, F.col("rule") == F.col("a_rule"))
    leaning = lambda size, q, parent: f"(({size}) * ({q}) + {weight} * ({parent})) div (({size}) + {weight})"
    qs = [F.expr(leaning("size", q, leaning("of_lang.size", f"of_lang.{q}", f"of_all.{q}"))).alias(q) for q in ("q10", "q25", "q75")]
    one = lambda r, q: F.max(F.when(F.col("rule") == r, F.col(q))).alias(f"{r}_{q}")
    wide = joined.select("lang", "source", "rule", *qs).groupBy("lang", "source").agg(*[one(r, q) for r in SKETCHED for q in ("q10", "q25", "q75")])
    fences = []
    for r, (spread, unit, per, both) in RULES.items():
        reach = f"{spread} * greatest({r}_q75 - {r}_q25, {unit} div greatest({per}_q10, 1))"
        fences += [F.expr(f"{r}_q75 + {reach}").alias(f"{r}_upper"), F.expr(f"{r}_q25 - {reach}" if both else "cast(null as bigint)").alias(f"{r}_lower")]
    return wide.select("lang", "source", *fences)


def quality_rules(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, weight: int = 50) -> DataFrame:
    """One row per document: its counts, base_failed, kept, and the names of the adaptive rules it breaks."""
    rated = materialize(with_rates(base_counts(docs), min_words, max_repeat_percent), "quality-rates")
    limits = thresholds(sketch(rated.filter(~F.col("base_failed"))), weight)
    limits = limits.withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    joined = rated.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    broken = F.filter(
        F.array(*[
            F.when((F.col(r) > F.col(f"{r}_upper")) | F.coalesce(F.col(r) < F.col(f"{r}_lower"), F.lit(False)), F.lit(r)) for r in RULES
        ]),
        lambda x: x.isNotNull(),
    )
    out = joined.select("*", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(broken).alias("broken"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), F.array_join("broken", ",").alias("broken"),
    )


_RATES = {
    "symbol_rate": "1000 * n_symbols // n_words", "upper_rate": "1000 * n_upper // n_words",
    "dup_line_rate": "CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END",
    "repeat_rate": "1000 * n_repeat_words // n_words", "word_length": "100 * word_chars // n_words", "n_words": "n_words", "n_lines": "n_lines",
}


def _sql() -> str:
    rates = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{r}' AS rule, CAST({x} AS BIGINT) AS v FROM c WHERE NOT base_failed" for r, x in _RATES.items())
    of_rule = lambda i: "CASE u.rule " + " ".join(f"WHEN '{r}' THEN {x[i]!r}" for r, x in RULES.items()) + " END"
    bucket = "CASE WHEN v < 16 THEN v ELSE (length(bin(v)) - 4) * 16 + (v >> (length(bin(v)) - 5)) - 16 END"
    top = "CASE WHEN bucket < 16 THEN bucket ELSE (CAST(17 + bucket % 16 AS BIGINT) << CAST(bucket // 16 - 1 AS BIGINT)) - 1 END"
    low = "CASE WHEN bucket < 16 THEN bucket ELSE CAST(16 + bucket % 16 AS BIGINT) << CAST(bucket // 16 - 1 AS BIGINT) END"
    qs = {"q10": low, "q25": low, "q75": top}

    def q(keys: str, comma: str) -> str:
        part = f"PARTITION BY {keys}{comma}rule"
        least = ", ".join(f"min(CASE WHEN cum * 100 >= {x[1:]} * size THEN {v} END) AS {x}" for x, v in qs.items())
        return f"""SELECT {keys}{comma}rule, any_value(size) AS size, {least}
          FROM (SELECT *, sum(n) OVER ({part} ORDER BY bucket) AS cum, sum(n) OVER ({part}) AS size
                FROM (SELECT {keys}{comma}rule, {bucket} AS bucket, count(*) AS n FROM r GROUP BY ALL)) GROUP BY ALL"""

    lean = ", ".join(f"(o.size * o.{x} + 50 * ((l.size * l.{x} + 50 * a.{x}) // (l.size + 50))) // (o.size + 50) AS {x}" for x in qs)
    reach = f"{of_rule(0)} * greatest(u.q75 - u.q25, {of_rule(1)} // greatest(p.q10, 1))"
    return rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM t),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS k FROM p),
s AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM g, range(0, 3) x(o) WHERE k > 1 GROUP BY doc_id),
b AS (SELECT t.doc_id, lang, source, len(w) AS n_words,
        CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
        coalesce(n_repeat_words, 0) AS n_repeat_words FROM t LEFT JOIN s ON t.doc_id = s.doc_id),
c AS (SELECT *, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
r AS ({rates}),
own AS ({q("lang, source", ", ")}), of_lang AS ({q("lang", ", ")}), of_all AS ({q("", "")}),
u AS (SELECT o.lang, o.source, o.rule, {lean}
      FROM own o JOIN of_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rule = l.rule JOIN of_all a ON a.rule = o.rule),
f AS (SELECT u.lang, u.source, u.rule, u.q75 + {reach} AS upper, u.q25 - {reach} AS lower, {of_rule(3)} AS both_ends
      FROM u JOIN u p ON u.lang IS NOT DISTINCT FROM p.lang AND u.source IS NOT DISTINCT FROM p.source AND p.rule = {of_rule(2)}),
bad AS (SELECT r.doc_id, string_agg(r.rule, ',' ORDER BY list_position({list(RULES)}, r.rule)) AS broken
        FROM r JOIN f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source AND r.rule = f.rule
        WHERE v > upper OR (both_ends AND v < lower) GROUP BY r.doc_id)
SELECT c.doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept, coalesce(broken, '') AS broken
FROM c LEFT JOIN bad ON c.doc_id = bad.doc_id
"""


SQL = _sql()

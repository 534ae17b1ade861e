"""Line dedup: later copies of repeated runs of lines are deleted.

The corpus is one sequence of line ids, documents in the order of their ids and lines without a
word left out, with a free position between documents, so that no run crosses them. The suffix array is built by prefix doubling: the
rank of a suffix by its first 2^(k+1) lines is the rank of the pair of its rank by 2^k lines
and that of the suffix 2^k lines later. A round groups the pairs, drops those that occur once
(their suffixes have no equal and need no rank), sorts the rest and joins the new ranks back.
Groups are counted before anything is shuffled by rank, so that a line that a third of all
documents share is one row, and the join back may be split by Spark.

An interval of suffixes with a common prefix of n lines is then known by (n, rank of the first
2^k lines, rank of the last 2^k lines), 2^k <= n < 2^(k+1). A run is deleted if it has at least
min_words words and an earlier copy. It is enough to look, from each start, at the shortest run
with min_words words and at the longer runs that would fall short of min_words without their
first line: together these cover exactly the maximal repeated runs. Every line has a word, so
no such run is longer than 2 * min_words lines and there are at most log2(2 * min_words) rounds,
however long the documents and their copies are.

A deleted line always has an earlier copy that stays. Blank lines stay where they are.

Defined results: a null text stays null and has no lines; a null id comes after all others, and
rows of equal id in the order in which they are read; lines are cut at \\n alone; an empty table
gives an empty result; other columns are kept, and columns named like the outputs (n_lines,
removed_lines) give way to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.runtime import WORD, drop_table, let, materialize


def _lines(base: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id and the lines that have a word: (line, a, b, words), a and b 96 bits of its hash."""
    kept = F.filter(
        F.transform(F.split(F.coalesce(F.col(f"doc.{text_col}"), F.lit("")), "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("x"), F.regexp_count(x, F.lit(WORD)).alias("words"))),
        lambda s: s["words"] > 0,
    )
    hashed = F.transform(kept, lambda s: F.struct(s["line"].alias("line"), F.xxhash64(s["x"]).alias("a"), F.hash(s["x"]).alias("b"), s["words"].alias("words")))
    return base.select("row", F.col(f"doc.{id_col}").alias("id"), hashed.alias("lines"))


def _starts(docs: DataFrame) -> DataFrame:
    """row and the position of its first line, documents in the order of id and row, one position free after each."""
    n = max(8, docs.sparkSession.sparkContext.defaultParallelism)
    by = [F.col("id").asc_nulls_last(), F.col("row").asc()]
    dealt = docs.select("row", "id", (F.size("lines") + 1).cast("long").alias("n")).repartitionByRange(n, *by).sortWithinPartitions(*by)
    dealt = materialize(dealt.select("row", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("k")), "lines-order")
    parts = dealt.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each partition
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(F.col("part").alias("o_part"), before(Window.orderBy("part")).alias("ahead"))
    own = before(Window.partitionBy("part").orderBy("k"))
    return dealt.withColumn("own", own).join(F.broadcast(offsets), F.col("part") == F.col("o_part")).select(F.col("row").alias("s_row"), (F.col("ahead") + F.col("own")).alias("start"))


def _large(side: DataFrame) -> DataFrame:
    """A side that grows with the corpus and is not to be broadcast at any size."""
    return side.hint("merge")


def _ranked(pairs: DataFrame) -> DataFrame:
    """pos and rank of the suffixes whose pair (a, b) occurs at least twice; ranks are in the order of pairs."""
    groups = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("a").alias("g_a"), F.col("b").alias("g_b")).orderBy("g_a", "g_b")
    groups = materialize(groups.withColumn("rank", F.monotonically_increasing_id()), "lines-ranks")
    return pairs.join(_large(groups), (F.col("a") == F.col("g_a")) & (F.col("b") == F.col("g_b"))).drop("a", "b", "g_a", "g_b")


def place(lines: DataFrame) -> DataFrame:
    """row, start (the position of the document's first line) and lines."""
    return lines.join(_large(_starts(lines)), F.col("row") == F.col("s_row")).select("row", "start", "lines")


def repeated_runs(placed: DataFrame, min_words: int) -> tuple[DataFrame, list[DataFrame]]:
    """The runs that have an earlier copy, as stated above, and the tables that they are read from.

    start, i (number of the first line among those with a word), n (lines), copies, first (position of the first copy).
    """
    flat = placed.select("start", F.posexplode("lines").alias("i", "l")).select("start", "i", "l.a", "l.b", "l.words")
    first = materialize(_ranked(flat), "lines-suffixes")  # start, i, words, rank
    made = [first]

    # stretches of neighbouring repeated lines of a document, then the runs that start in them
    near = Window.partitionBy("start").orderBy("i")
    stretch = first.select("*", (F.col("i") - F.row_number().over(near)).alias("stretch"))
    summed = Window.partitionBy("start", "stretch").orderBy("i")
    stretch = stretch.select("start", "stretch", "i", "words", F.sum("words").over(summed.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
    ahead = summed.rowsBetween(0, 2 * min_words)
    seen = stretch.select("start", "i", "words", "cum", F.collect_list("cum").over(ahead).alias("cums"))
    total = lambda i: F.get("cums", i - 1) - F.col("cum") + F.col("words")  # words of the first i lines
    wanted = F.filter(
        F.sequence(F.lit(1), F.size("cums")),
        lambda i: (total(i) >= min_words) & ((i == 1) | (total(i - 1) < min_words) | (total(i) - F.col("words") < min_words)),
    )
    runs = seen.select("start", "i", F.explode(wanted).alias("n"))
    runs = materialize(runs.select("*", (F.length(F.bin(F.col("n").cast("long"))) - 1).cast("int").alias("k")), "lines-runs")

    levels = runs.agg(F.max("k")).first()[0] or 0  # at most log2(2 * min_words)
    suffixes = first.select((F.col("start") + F.col("i")).alias("pos"), "rank")
    ranks = suffixes.withColumn("k", F.lit(0))
    for k in range(levels):
        later = suffixes.select((F.col("pos") - (1 << k)).alias("l_pos"), F.col("rank").alias("b"))
        pairs = suffixes.join(_large(later), F.col("pos") == F.col("l_pos")).select("pos", F.col("rank").alias("a"), "b")
        suffixes = materialize(_ranked(pairs), "lines-suffixes")
        made.append(suffixes)
        ranks = ranks.unionByName(suffixes.withColumn("k", F.lit(k + 1)))
    head = ranks.select(F.col("k").alias("h_k"), F.col("pos").alias("h_pos"), F.col("rank").alias("head"))
    tail = ranks.select(F.col("k").alias("t_k"), F.col("pos").alias("t_pos"), F.col("rank").alias("tail"))
    pos = F.col("start") + F.col("i")
    last = pos + F.col("n") - F.expr("shiftleft(1L, k)")
    keyed = runs.join(_large(head), (F.col("k") == F.col("h_k")) & (pos == F.col("h_pos"))).join(_large(tail), (F.col("k") == F.col("t_k")) & (last == F.col("t_pos")))
    keyed = materialize(keyed.select("start", "i", "n", "head", "tail"), "lines-keys")
    groups = keyed.groupBy("n", "head", "tail").agg(F.min(pos).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    # as a table of its own, so that the join below has shuffles that Spark can split at a hot run
    groups = materialize(groups.withColumnsRenamed({"n": "g_n", "head": "g_head", "tail": "g_tail"}), "lines-intervals")
    same = (F.col("n") == F.col("g_n")) & (F.col("head") == F.col("g_head")) & (F.col("tail") == F.col("g_tail"))
    drop_table(runs)
    for table in made:
        drop_table(table)
    return keyed.join(_large(groups), same).filter(pos > F.col("first")).select("start", "i", "n", "copies", "first"), [keyed, groups]


def line_dedup(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with deleted runs left out of the text, n_lines, and removed_lines (numbers from 0)."""
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "removed_lines")]
    base = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), F.monotonically_increasing_id().alias("row")), "lines-docs")
    lines = materialize(_lines(base, id_col, text_col), "lines")
    placed = materialize(place(lines), "lines-placed")
    drop_table(lines)
    found, tables = repeated_runs(placed, min_words)
    runs = found.groupBy("start", "i").agg(F.max("n").alias("n"))
    places = runs.select("start", F.explode(F.sequence("i", F.col("i") + F.col("n") - 1)).alias("i")).groupBy("start").agg(F.collect_set("i").alias("places"))
    numbers = places.join(placed, "start").select(
        F.col("row").alias("r_row"), F.sort_array(let(F.col("lines"), lambda x: F.transform("places", lambda i: F.get(x, i)["line"]))).alias("removed")
    )
    removed = materialize(numbers, "lines-removed")
    for table in (*tables, placed):
        drop_table(table)
    text = F.col(f"doc.{text_col}")
    rest = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "removed"), lambda i: F.get(x, i)), "\n")
    shorter = F.when(F.col("removed").isNull(), text).otherwise(let(F.split(text, "\n", -1), rest))
    columns = [shorter.alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in kept]
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1)))
    return base.join(removed, F.col("row") == F.col("r_row"), "left").select(
        *columns, n_lines.cast("long").alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed_lines")
    )


SQL = r"""
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents),
e AS (SELECT doc_id, unnest(x) AS line, unnest(range(0, len(x))) AS no FROM s),
l AS (SELECT doc_id, line, no, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS i,
      row_number() OVER (ORDER BY doc_id, no) AS pos FROM e WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS cum FROM l),
r AS (SELECT a.doc_id, a.i, b.i AS j, a.pos, list_aggregate(list_slice(h.hs, a.i, b.i), 'string_agg', ',') AS key
      FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.i <= b.i JOIN (SELECT doc_id, list(md5(line) ORDER BY i) AS hs FROM l GROUP BY doc_id) h ON h.doc_id = a.doc_id
      WHERE b.cum - a.cum + a.words >= 50 AND (a.i = b.i OR b.cum - b.words - a.cum + a.words < 50 OR b.cum - a.cum < 50)),
f AS (SELECT *, min(pos) OVER (PARTITION BY key) AS first FROM r),
g AS (SELECT DISTINCT l.doc_id, l.no FROM l JOIN (SELECT * FROM f WHERE pos > first) f ON l.doc_id = f.doc_id AND l.i BETWEEN f.i AND f.j),
k AS (SELECT e.doc_id, string_agg(line, chr(10) ORDER BY no) AS text FROM e WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = e.doc_id AND g.no = e.no) GROUP BY e.doc_id),
m AS (SELECT doc_id, list(no ORDER BY no) AS removed_lines FROM g GROUP BY doc_id)
SELECT s.doc_id, CASE WHEN m.doc_id IS NULL THEN s.text ELSE coalesce(k.text, '') END AS text, CAST(coalesce(len(s.x), 0) AS BIGINT) AS n_lines,
  coalesce(array_to_string(m.removed_lines, ','), '') AS removed_lines
FROM s LEFT JOIN m ON s.doc_id = m.doc_id LEFT JOIN k ON s.doc_id = k.doc_id
"""

"""Queries on text: counts, splits, hashes, chunks and terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import chunking, terms, toolout
from weftline.plans.registry import query, table

#: The same words in DuckDB.
WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
TOKENS = "greatest(1, length(text) // 4)"


@query("token_estimate", f"SELECT doc_id, CAST({TOKENS} AS INTEGER) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query("word_count", f"SELECT doc_id, CAST(len({WORDS}) AS INTEGER) AS n_words FROM documents")
def word_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(tx.words(F.col("text"))).alias("n_words"))


@query("stream_tokens", r"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_filter(t, lambda x: x = chr(10))) AS INTEGER) AS n_newlines FROM (SELECT doc_id, regexp_extract_all(text, '(\S+|\n)', 1) AS t FROM documents)")
def stream_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select("doc_id", tx.stream_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.filter("t", lambda x: x == "\n")).alias("n_newlines"))


MARKED = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


@query("sentence_split", f"SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {MARKED} AS s FROM documents)")
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "documents").select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


_FIT = """SELECT doc_id, coalesce(string_agg(s, ' ' ORDER BY i) FILTER (WHERE used <= {budget}), '') AS kept FROM (
  SELECT doc_id, i, s, sum(greatest(1, length(s) // 4)) OVER (PARTITION BY doc_id ORDER BY i) AS used
  FROM (SELECT doc_id, unnest({split}) AS s, generate_subscripts({split}, 1) AS i FROM documents)) GROUP BY doc_id"""


@query("truncate_sentences", _FIT.format(budget=64, split=MARKED))
def truncate_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.leading_sentences(F.col("text"), F.lit(64)).alias("kept"))


_MARKED_LINES = r"string_split(regexp_replace(text, '([.!?\n])\s+', '\1' || chr(1), 'g'), chr(1))"


@query(
    "compress_text",
    f"""SELECT d.doc_id, CASE WHEN {TOKENS} <= 64 THEN text ELSE (CASE WHEN k.kept = '' THEN substr(text, 1, 256) ELSE k.kept END) || chr(10) || '... [truncated]' END AS compressed
    FROM documents d JOIN ({_FIT.format(budget=64, split=_MARKED_LINES)}) k ON d.doc_id = k.doc_id""",
)
def compress_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.compress_text(F.col("text"), F.lit(64)).alias("compressed"))


_SAVED = f"SELECT d.doc_id, source, {TOKENS} AS tokens, CASE WHEN {TOKENS} <= 512 THEN text ELSE (CASE WHEN k.kept = '' THEN substr(text, 1, 2048) ELSE k.kept END) || chr(10) || '... [truncated]' END AS short FROM documents d JOIN ({_FIT.format(budget=512, split=_MARKED_LINES)}) k ON d.doc_id = k.doc_id"


@query("tokens_saved", f"SELECT source, CAST(sum(tokens - least(tokens, greatest(1, length(short) // 4))) AS BIGINT) AS saved, count(*) AS n FROM ({_SAVED}) GROUP BY source")
def tokens_saved(spark: SparkSession, sf: str) -> DataFrame:
    """What the compressor of tool output saves in the documents of each source."""
    rows = toolout.compress(table(spark, sf, "documents").select("source", F.col("text").alias("content")))
    return rows.groupBy("source").agg(F.sum("saved").alias("saved"), F.count("*").alias("n"))


@query(
    "chunk_fixed",
    f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
    p AS (SELECT doc_id, ws, unnest(range(0, greatest(0, CAST(ceil((len(ws) - 256) / 224.0) AS BIGINT)) + 1)) AS pos FROM w WHERE len(ws) > 0)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, array_to_string(ws[pos * 224 + 1 : pos * 224 + 256], ' ') AS chunk FROM p""",
)
def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_fixed(table(spark, sf, "documents"))


@query("html_strip", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_strip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.html_text(F.col("html")).alias("text"))


@query(
    "token_entropy",
    f"""SELECT doc_id, round(-sum(p * log2(p)), 6) AS entropy FROM (
      SELECT doc_id, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS p FROM (SELECT doc_id, unnest({WORDS}) AS t FROM documents) GROUP BY doc_id, t) GROUP BY doc_id""",
)
def token_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return terms.entropy(table(spark, sf, "documents"))


@query(
    "tf_l2",
    f"""SELECT doc_id, term, n, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM (
      SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({WORDS.replace('text', 'lower(text)')}) AS term FROM documents) GROUP BY doc_id, term)""",
)
def tf_l2(spark: SparkSession, sf: str) -> DataFrame:
    return terms.tf_l2(table(spark, sf, "documents"))


@query(
    "vocab",
    f"""SELECT term, n_docs, first_doc, row_number() OVER (ORDER BY first_doc, pos) - 1 AS index FROM (
      SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs, min(doc_id) AS first_doc, arg_min(pos, doc_id * 1000000 + pos) AS pos FROM (
      SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {WORDS.replace('text', 'lower(text)')} AS w FROM documents)) GROUP BY term)""",
)
def vocab(spark: SparkSession, sf: str) -> DataFrame:
    return terms.vocabulary(table(spark, sf, "documents"))


@query(
    "block_align",
    """SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS original, CAST(greatest(16, ceil(length(text) / 16.0) * 16) AS INTEGER) AS aligned,
      CAST(greatest(16, ceil(length(text) / 16.0) * 16) - length(text) AS INTEGER) AS padding FROM conversations""",
)
def block_align(spark: SparkSession, sf: str) -> DataFrame:
    padded = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("original"), F.length(tx.block_padded(F.col("text"), 16)).alias("aligned"))
    return padded.withColumn("padding", F.col("aligned") - F.col("original"))


@query("prefix_hash", "SELECT conv_id, turn, sha256(rpad(text, CAST(greatest(16, ceil(length(text) / 16.0) * 16) AS INTEGER), ' ')) AS prefix_hash FROM conversations")
def prefix_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.prefix_hash(tx.block_padded(F.col("text"), 16)).alias("prefix_hash"))


@query("node_ids", "SELECT conv_id, turn, concat(turn, ':nl_sentence:', substr(md5(text), 1, 8)) AS node_id FROM conversations")
def node_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.node_id(F.col("turn"), F.lit("nl_sentence"), F.lit(None).cast("string"), F.col("text")).alias("node_id"))


@query("session_key", "SELECT event_id, 's-' || substr(md5(concat(user_id, event_type)), 1, 12) AS session FROM events")
def session_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", tx.session_key(F.col("user_id").cast("string"), F.col("event_type")).alias("session"))


@query("compact_repr", "SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 59) || '…' ELSE text END AS short, CASE WHEN length(text) > 120 THEN left(text, 117) || '...' ELSE text END AS fact FROM documents")
def compact_repr(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.compact(F.col("text"), 60, "…").alias("short"), tx.compact(F.col("text"), 120, "...").alias("fact"))


_MODEL = "CASE event_id % 5 WHEN 0 THEN 'Qwen2.5-coder:7b' WHEN 1 THEN 'codellama:13b' WHEN 2 THEN 'mistral-nemo' WHEN 3 THEN 'phi3' ELSE 'gpt-4' END"


@query(
    "tokenizer_family",
    f"SELECT event_id, CASE {' '.join(f'''WHEN contains(lower({_MODEL}), '{k}') THEN '{v}' ''' for k, v in tx.TOKENIZER_FAMILIES.items())} ELSE 'char-estimate' END AS family FROM events",
)
def tokenizer_family(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", tx.tokenizer_family(F.expr(_MODEL)).alias("family"))


@query("role_actor", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' WHEN 'tool' THEN 'tool' WHEN 'system' THEN 'system' ELSE 'agent' END AS actor FROM conversations")
def role_actor(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.role_actor(F.col("role")).alias("actor"))


@query("oversize_filter", f"SELECT doc_id, CAST({TOKENS} AS INTEGER) AS tokens FROM documents WHERE {TOKENS} > 512")
def oversize_filter(spark: SparkSession, sf: str) -> DataFrame:
    sized = table(spark, sf, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))
    return sized.filter(F.col("tokens") > 512)


@query(
    "chunk_sequence_edges",
    f"""WITH w AS (SELECT doc_id, len({WORDS}) AS n FROM documents),
    p AS (SELECT doc_id, unnest(range(1, greatest(0, CAST(ceil((n - 256) / 224.0) AS BIGINT)) + 1)) AS pos FROM w WHERE n > 0)
    SELECT concat(doc_id, ':chunk:', pos - 1) AS source_id, concat(doc_id, ':chunk:', pos) AS target_id, 'chunk_sequence' AS edge_type, 0.8::DOUBLE AS weight FROM p""",
)
def chunk_sequence_edges(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.sequence_edges(chunking.chunk_fixed(table(spark, sf, "documents")).drop("chunk"))


_FRAMES = r"""WITH t AS (SELECT doc_id, unnest(x) AS tok, unnest(range(0, len(x))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '(\S+|\n)', 1) AS x FROM documents)),
f AS (SELECT doc_id, pos, list(tok) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 32 PRECEDING AND 17 PRECEDING) AS a,
        list(tok) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING) AS b FROM t),
g AS (SELECT doc_id, pos, b, list_transform(a, lambda x: lower(x)) AS la, list_transform(b, lambda x: lower(x)) AS lb FROM f WHERE pos >= 32),
h AS (SELECT doc_id, pos,
  list_sum(list_transform(list_distinct(la), lambda t: len(list_filter(la, lambda x: x = t)) * len(list_filter(lb, lambda x: x = t))))::DOUBLE AS inner_,
  list_sum(list_transform(list_distinct(la), lambda t: len(list_filter(la, lambda x: x = t)) ** 2))::DOUBLE AS sa,
  list_sum(list_transform(list_distinct(lb), lambda t: len(list_filter(lb, lambda x: x = t)) ** 2))::DOUBLE AS sb,
  list_sum(list_transform(list_distinct(b), lambda t: -(len(list_filter(b, lambda x: x = t)) / 16.0::DOUBLE) * log2(len(list_filter(b, lambda x: x = t)) / 16.0::DOUBLE))) AS e FROM g)
SELECT doc_id, pos::INTEGER AS pos, round(1 - inner_ / sqrt(sa * sb), 6) AS shift, round(e, 6) AS entropy, round((1 - inner_ / sqrt(sa * sb)) * e, 6) AS score,
  round((1 - inner_ / sqrt(sa * sb)) * e, 6) > 0.35 AS is_boundary FROM h"""


@query("boundary_scores", _FRAMES)
def boundary_scores(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.boundary_scores(table(spark, sf, "documents"))


@query("chunk_adaptive")
def chunk_adaptive(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_adaptive(table(spark, sf, "documents"))


@query(
    "adaptive_threshold",
    """SELECT user_id, event_id, round(CASE WHEN count(value) OVER w >= 5 THEN greatest(0.1, avg(value) OVER w + 1.2 * stddev_pop(value) OVER w) ELSE 0.35 END, 6) AS threshold
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
)
def adaptive_threshold(spark: SparkSession, sf: str) -> DataFrame:
    out = chunking.adaptive_threshold(table(spark, sf, "events"), "user_id", "event_id", "value")
    return out.withColumn("threshold", F.round("threshold", 6))

"""Queries on conversations, memory, facts and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import code, memory, telemetry, turn, zones
from weftline.plans.registry import query, table

TOK = "greatest(1, length(text) // 4)"
_TURNS = f"SELECT conv_id AS session, role, text AS content, CAST({TOK} AS INTEGER) AS token_count, CAST(turn AS INTEGER) AS turn_index FROM conversations"
_ZONED = f"""t AS ({_TURNS}), z AS (SELECT *, CASE WHEN role = 'system' THEN 'P'
  WHEN sum(CASE WHEN role = 'system' THEN 0 ELSE token_count END) OVER (PARTITION BY session ORDER BY turn_index DESC ROWS UNBOUNDED PRECEDING) <= 256 THEN 'R' ELSE 'T' END AS zone FROM t)"""
_SUMMARY = """s AS (SELECT session, CAST(ceil(p / 16.0) * 16 AS BIGINT) AS p_tokens, t AS t_tokens, r AS r_tokens, CAST(640 - ceil(p / 16.0) * 16 - 256 AS BIGINT) AS t_budget FROM (
  SELECT session, CAST(coalesce(sum(token_count) FILTER (WHERE zone = 'P'), 0) AS BIGINT) AS p, CAST(coalesce(sum(token_count) FILTER (WHERE zone = 'T'), 0) AS BIGINT) AS t,
    CAST(coalesce(sum(token_count) FILTER (WHERE zone = 'R'), 0) AS BIGINT) AS r FROM z GROUP BY session))"""


def turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return zones.parse_messages(c.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role", F.col("text").alias("content")))


def zoned(spark: SparkSession, sf: str) -> DataFrame:
    return zones.assign_zones(turns(spark, sf), 256)


@query("parse_messages", _TURNS)
def parse_messages(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf)


@query("zone_assign", f"WITH {_ZONED} SELECT session, turn_index, zone FROM z")
def zone_assign(spark: SparkSession, sf: str) -> DataFrame:
    return zoned(spark, sf).select("session", "turn_index", "zone")


@query("zone_offsets", f"WITH {_ZONED} SELECT session, turn_index, zone, CAST(e - token_count AS BIGINT) AS start_token, CAST(e AS BIGINT) AS end_token FROM (SELECT *, sum(token_count) OVER (PARTITION BY session ORDER BY CASE zone WHEN 'P' THEN 0 WHEN 'T' THEN 1 ELSE 2 END, turn_index ROWS UNBOUNDED PRECEDING) AS e FROM z)")
def zone_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return zones.zone_offsets(zoned(spark, sf)).select("session", "turn_index", "zone", "start_token", "end_token")


@query("zone_summary", f"WITH {_ZONED}, {_SUMMARY} SELECT *, t_tokens > t_budget AS compaction_required FROM s")
def zone_summary(spark: SparkSession, sf: str) -> DataFrame:
    return zones.zone_summary(zoned(spark, sf), 640, 256)


@query("zone_violations", f"WITH {_ZONED}, {_SUMMARY} SELECT session, CASE WHEN r_tokens > 256 THEN 'tail' WHEN p_tokens + 256 > 640 THEN 'prefix' ELSE 'total' END AS rule FROM s WHERE r_tokens > 256 OR p_tokens + 256 > 640 OR p_tokens + t_tokens + r_tokens > 640")
def zone_violations(spark: SparkSession, sf: str) -> DataFrame:
    return zones.zone_violations(zones.zone_summary(zoned(spark, sf), 640, 256), 640, 256)


@query("graduate", f"WITH {_ZONED} SELECT session, turn_index, CASE WHEN zone = 'R' AND max(turn_index) OVER (PARTITION BY session) - turn_index >= 3 THEN 'T' ELSE zone END AS zone FROM z")
def graduate(spark: SparkSession, sf: str) -> DataFrame:
    return zones.graduate(zoned(spark, sf)).select("session", "turn_index", "zone")


@query("session_stats", f"WITH t AS ({_TURNS}) SELECT session, max(turn_index) AS last_turn, count(*) AS n_turns, CAST(sum(token_count) AS BIGINT) AS tokens FROM t GROUP BY session")
def session_stats(spark: SparkSession, sf: str) -> DataFrame:
    return zones.session_stats(turns(spark, sf))


@query("prefix_replace", f"WITH t AS ({_TURNS}) SELECT session, turn_index, CASE WHEN role = 'system' THEN 'Answer briefly.' ELSE content END AS content, CASE WHEN role = 'system' THEN 3 ELSE token_count END AS token_count FROM t")
def prefix_replace(spark: SparkSession, sf: str) -> DataFrame:
    return zones.replace_prefix(turns(spark, sf), "Answer briefly.").select("session", "turn_index", "content", "token_count")


@query(
    "assemble_context",
    f"""WITH {_ZONED} SELECT session, CAST(count(*) AS INTEGER) AS n_messages, string_agg(role || ': ' || content, chr(10) ORDER BY CASE zone WHEN 'P' THEN 0 WHEN 'T' THEN 2 ELSE 3 END, turn_index) AS payload,
    CAST(sum(length(content) // 4) AS BIGINT) AS tokens_in FROM z GROUP BY session""",
)
def assemble_context(spark: SparkSession, sf: str) -> DataFrame:
    return zones.assemble(zoned(spark, sf))


@query("nl_nodes", "SELECT concat(turn, ':nl_sentence:', substr(md5(text), 1, 8)) AS node_id, conv_id AS session, CAST(turn AS INTEGER) AS turn_index, left(text, 500) AS content FROM conversations")
def nl_nodes(spark: SparkSession, sf: str) -> DataFrame:
    node = tx.node_id(F.col("turn_index"), F.lit("nl_sentence"), F.lit(None).cast("string"), F.col("content"))
    return turns(spark, sf).select(node.alias("node_id"), "session", "turn_index", F.left("content", F.lit(500)).alias("content"))


@query(
    "sentence_nodes",
    """SELECT session, concat(turn_index, ':nl_sentence:s', i - 1) AS node_id, turn_index, trim(s) AS content, CAST(greatest(1, len(list_filter(regexp_split_to_array(trim(s), '\\s+'), lambda x: x <> ''))) AS INTEGER) AS token_count FROM (
    SELECT conv_id AS session, CAST(turn AS INTEGER) AS turn_index, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT *, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS x FROM conversations)) WHERE trim(s) <> ''""",
)
def sentence_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return code.sentence_nodes(turns(spark, sf))


@query("www_fallback", "SELECT conv_id AS session, CAST(turn AS INTEGER) AS turn_index, CASE role WHEN 'user' THEN 'user' WHEN 'tool' THEN 'tool' WHEN 'system' THEN 'system' ELSE 'agent' END AS who, 'nl_statement' AS mutation_type, left(text, 80) AS value FROM conversations")
def www_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).select("session", "turn_index", tx.role_actor(F.col("role")).alias("who"), F.lit("nl_statement").alias("mutation_type"), F.left("content", F.lit(80)).alias("value"))


# --- memory: user = session, type = name, event = turn
_MEM = """m AS (SELECT user_id AS session, event_type AS name, 'module' AS scope, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS "when", event_id AS seq,
  CAST(10 + event_id % 17 AS INTEGER) AS tokens, (event_id % 5) / 4.0::DOUBLE AS depth, event_id % 97 = 0 AS is_pinned, CAST(value AS VARCHAR) AS v FROM events)"""
_DEDUP = 'd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, name, scope ORDER BY "when" DESC, seq DESC) AS i FROM m) WHERE i = 1 OR is_pinned)'
_WEIGHT = """round(CASE WHEN is_pinned THEN 'Infinity'::DOUBLE ELSE exp(-0.05 * greatest(0, max("when") OVER (PARTITION BY session) - "when")) * (1 + 0.5 * depth) END, 9)"""


def tuples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "user_id AS session", "event_type AS name", "'module' AS scope", "row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS when", "event_id AS seq",
        "CAST(10 + event_id % 17 AS INT) AS tokens", "(event_id % 5) / 4D AS depth", "event_id % 97 = 0 AS is_pinned", "'agent' AS who", "CAST(event_id AS STRING) AS value",
    )


@query("memory_dedup", f'WITH {_MEM}, {_DEDUP} SELECT session, name, "when", seq, is_pinned FROM d')
def memory_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return memory.dedup(tuples(spark, sf)).select("session", "name", "when", "seq", "is_pinned")


@query("decay_weight", f"WITH {_MEM} SELECT session, seq, is_pinned, CASE WHEN NOT is_pinned THEN round(weight, 6) END AS weight FROM (SELECT *, {_WEIGHT} AS weight FROM m)")
def decay_weight(spark: SparkSession, sf: str) -> DataFrame:
    """The weight of every tuple; that of pinned ones is infinite, and null here."""
    w = memory.weigh(tuples(spark, sf))
    return w.select("session", "seq", "is_pinned", F.when(~F.col("is_pinned"), F.round("weight", 6)).alias("weight"))


@query("memory_pin", f"WITH {_MEM} SELECT session, seq, is_pinned OR name = 'error' AND session % 2 = 0 AS is_pinned FROM m")
def memory_pin(spark: SparkSession, sf: str) -> DataFrame:
    t = tuples(spark, sf)
    return memory.pin(t, t.filter("name = 'error' AND session % 2 = 0").select("session", "name")).select("session", "seq", "is_pinned")


_SELECT = f"""w AS (SELECT *, {_WEIGHT} AS weight FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY CASE WHEN is_pinned THEN 0 ELSE 1 END, -weight, seq) AS i FROM w),
f AS (SELECT session, i, seq, tokens <= 200 AS kept, CASE WHEN tokens <= 200 THEN tokens ELSE 0 END AS used FROM o WHERE i = 1
  UNION ALL SELECT o.session, o.i, o.seq, f.used + o.tokens <= 200, CASE WHEN f.used + o.tokens <= 200 THEN f.used + o.tokens ELSE f.used END FROM f JOIN o ON o.session = f.session AND o.i = f.i + 1)"""


@query("memory_select", f"WITH RECURSIVE {_MEM}, {_SELECT} SELECT session, seq FROM f WHERE kept")
def memory_select(spark: SparkSession, sf: str) -> DataFrame:
    return memory.select(memory.weigh(tuples(spark, sf)), 200).select("session", "seq")


@query(
    "memory_block",
    f"""WITH RECURSIVE {_MEM}, {_SELECT} SELECT m.session, '<!-- CTX_MEMORY' || chr(10) || '[' || string_agg('{{"w":"agent","d":"' || name || '=' || m.seq || '","t":' || "when" || ',"@":"module"}}', ',' ORDER BY "when") || ']' || chr(10) || '-->' AS content
    FROM f JOIN m ON f.session = m.session AND f.seq = m.seq WHERE kept GROUP BY m.session""",
)
def memory_block(spark: SparkSession, sf: str) -> DataFrame:
    return memory.block(memory.select(memory.weigh(tuples(spark, sf)), 200))


# --- facts: document = fact, source = session; weight from quality and length
_FACTS = """fa AS (SELECT concat('f', d.doc_id) AS fact_id, source AS session, lang AS node_type, text AS content, round(0.5 + (d.doc_id % 100) / 200.0::DOUBLE, 3) AS weight, d.doc_id AS seq FROM documents d)"""


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr("concat('f', doc_id) AS fact_id", "source AS session", "lang AS node_type", "text AS content", "round(0.5 + (doc_id % 100) / 200D, 3) AS weight", "doc_id AS seq")


@query(
    "facts_extract",
    f"""WITH {_FACTS.replace("source AS session", "lang AS session")}, e AS (SELECT session, concat('f', unnest([seq - 1, seq - 2, (seq // 3) * 3])) AS dst FROM fa),
    g AS (SELECT fa.session, fact_id, weight, count(*) AS in_degree FROM fa JOIN e ON e.session = fa.session AND e.dst = fa.fact_id WHERE weight >= 0.8 AND trim(content) <> '' GROUP BY ALL HAVING count(*) >= 2)
    SELECT session, fact_id AS node, weight, in_degree FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY weight DESC, fact_id) AS i FROM g) WHERE i <= 50""",
)
def facts_extract(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf).withColumn("session", F.col("node_type"))
    edges = f.select("session", F.explode(F.expr("array(seq - 1, seq - 2, (seq div 3) * 3)")).alias("t")).select("session", F.concat(F.lit("f"), F.col("t").cast("string")).alias("dst"))
    return memory.extract_facts(f.select("session", F.col("fact_id").alias("node"), "content", "weight"), edges).select("session", "node", "weight", "in_degree")


_BAG = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> ''))"


@query(
    "facts_relevant",
    f"""WITH {_FACTS}, a AS (SELECT item_id, unnest({_BAG.format('text')}) AS word FROM benchmark),
    b AS (SELECT fact_id, weight, len(bag) AS n, unnest(bag) AS word FROM (SELECT fact_id, weight, {_BAG.format('content')} AS bag FROM fa)),
    c AS (SELECT item_id, fact_id, count(*) AS overlap, round(count(*) / sqrt(n + 1.0::DOUBLE) * weight, 6) AS score FROM a JOIN b ON a.word = b.word GROUP BY item_id, fact_id, n, weight)
    SELECT item_id AS query_id, CAST(i AS INTEGER) AS rank, fact_id, overlap, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, fact_id) AS i FROM c) WHERE i <= 5""",
)
def facts_relevant(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return memory.relevant_facts(facts(spark, sf), q)


@query("facts_top", f"WITH {_FACTS} SELECT fact_id, session, weight FROM fa ORDER BY weight DESC, fact_id LIMIT 1000")
def facts_top(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).select("fact_id", "session", "weight").orderBy(F.desc("weight"), "fact_id").limit(1000)


@query("facts_recent", f"WITH {_FACTS} SELECT fact_id, session, weight FROM fa ORDER BY seq DESC LIMIT 20")
def facts_recent(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).orderBy(F.desc("seq")).select("fact_id", "session", "weight").limit(20)


@query("facts_count", f"WITH {_FACTS} SELECT count(*) AS n FROM fa")
def facts_count(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).agg(F.count("*").alias("n"))


@query("facts_upsert", "SELECT fact_id, last_accessed_at, seq FROM (SELECT concat('f', doc_id % 300) AS fact_id, n_chars AS last_accessed_at, doc_id AS seq, row_number() OVER (PARTITION BY doc_id % 300 ORDER BY n_chars DESC, doc_id DESC) AS i FROM documents) WHERE i = 1")
def facts_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return memory.upsert_facts(table(spark, sf, "documents").selectExpr("concat('f', doc_id % 300) AS fact_id", "n_chars AS last_accessed_at", "doc_id AS seq"))


_NOTE = """'<!-- CTX_FACTS [' || string_agg('{"node_type":' || to_json(node_type) || ',"content":' || to_json(left(content, 200)) || ',"weight":' || CAST(weight AS VARCHAR) || '}', ',' ORDER BY weight DESC, fact_id) || '] -->'"""
_BEST = "sh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY weight DESC, fact_id) AS i FROM fa) WHERE i <= 50)"


@query("facts_annotation", f"WITH {_FACTS}, {_BEST} SELECT session, {_NOTE} AS content FROM sh GROUP BY session")
def facts_annotation(spark: SparkSession, sf: str) -> DataFrame:
    return memory.annotation(facts(spark, sf))


@query(
    "facts_inject",
    f"""WITH t AS ({_TURNS}), {_FACTS}, h AS (SELECT session AS item_id, arg_min(content, turn_index) AS text FROM t WHERE role = 'user' GROUP BY session),
    a AS (SELECT item_id, unnest({_BAG.format('text')}) AS word FROM h), b AS (SELECT fact_id, weight, len(bag) AS n, unnest(bag) AS word FROM (SELECT fact_id, weight, {_BAG.format('content')} AS bag FROM fa)),
    c AS (SELECT item_id, fact_id, round(count(*) / sqrt(n + 1.0::DOUBLE) * weight, 6) AS score FROM a JOIN b ON a.word = b.word GROUP BY item_id, fact_id, n, weight),
    r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, fact_id) AS i FROM c) WHERE i <= 5),
    n AS (SELECT item_id, {_NOTE} AS note FROM (SELECT item_id, fa.* FROM r JOIN fa ON r.fact_id = fa.fact_id) GROUP BY item_id)
    SELECT session, turn_index, CASE WHEN role = 'system' AND note IS NOT NULL THEN content || chr(10) || note ELSE content END AS content FROM t LEFT JOIN n ON session = item_id""",
)
def facts_inject(spark: SparkSession, sf: str) -> DataFrame:
    """The five facts that fit a session's first user message best go to its system turn."""
    t = turns(spark, sf)
    return memory.inject(t, turn.notes(t, facts(spark, sf).drop("session"))).select("session", "turn_index", "content")


@query("assemble_turn")
def assemble_turn(spark: SparkSession, sf: str) -> DataFrame:
    """What is sent for each conversation: prefix with facts, memory, compacted or raw T, and R. Tested against plain Python."""
    return turn.full_turn(turns(spark, sf), facts(spark, sf).drop("session"), 640, 256)


# --- telemetry
@query("event_type_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def event_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("recent_history", "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 100")
def recent_history(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.last_events(table(spark, sf, "events").filter("event_type = 'error'"), 100).select("event_id", "user_id", "value")


@query("ring_buffer", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM events) WHERE i <= 30")
def ring_buffer(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.last_events(table(spark, sf, "events"), 30, ["user_id"]).select("event_id", "user_id")


@query("hit_rate", "SELECT user_id, round(avg(CASE WHEN value > 50 THEN 1 ELSE 0 END) * 100, 4) AS hit_rate, count(*) AS n FROM events GROUP BY user_id")
def hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.hit_rate(table(spark, sf, "events"), F.col("value") > 50, "user_id")


@query("trace_summary", "SELECT count(*) AS n_spans, round(avg(value), 2) AS avg_total_ms, round(avg(value / 2), 2) AS avg_vector_ms, round(avg(value / 4), 2) AS avg_graph_ms, count(*) FILTER (WHERE event_id % 3 = 0) AS n_native FROM events")
def trace_summary(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.trace_summary(table(spark, sf, "events").selectExpr("value AS total_ms", "value / 2 AS vector_ms", "value / 4 AS graph_ms", "event_id % 3 = 0 AS native"))


@query("dashboard_state", "SELECT user_id, count(*) AS n, max(event_id) AS last_event, arg_max(value, event_id) AS last_value, round(sum(value), 4) AS total, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS n_{k}" for k in ("signup", "purchase", "view", "click", "error")) + " FROM events GROUP BY user_id")
def dashboard_state(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.dashboard(table(spark, sf, "events"))


@query("sparkline", "WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM events) WHERE i <= 60) SELECT user_id, event_id, round((value - min(value) OVER w) / (CASE WHEN max(value) OVER w > min(value) OVER w THEN max(value) OVER w - min(value) OVER w ELSE 1 END), 6) AS y FROM t WINDOW w AS (PARTITION BY user_id)")
def sparkline(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.sparkline(table(spark, sf, "events"))


@query("sse_format", """SELECT event_id, 'data: {"event":"' || event_type || '","session_id":' || user_id || ',"k":' || json_extract_string(props, '$.k') || '}' || chr(10) || chr(10) AS data FROM events""")
def sse_format(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return telemetry.sse(e, "event", F.struct(F.col("event_type").alias("event"), F.col("user_id").alias("session_id"), F.get_json_object("props", "$.k").cast("long").alias("k")))


_SNAP = "SELECT user_id AS session, max(event_id) AS turn_counter, min(event_id) AS created_at, max(event_id) AS updated_at FROM events WHERE {} GROUP BY user_id"


@query("session_upsert", f"WITH o AS ({_SNAP.format('event_id % 2 = 0')}), n AS ({_SNAP.format('event_id % 3 = 0')}) SELECT coalesce(n.session, o.session) AS session, coalesce(n.turn_counter, o.turn_counter) AS turn_counter, coalesce(o.created_at, n.created_at) AS created_at, coalesce(n.updated_at, o.updated_at) AS updated_at FROM o FULL JOIN n ON o.session = n.session")
def session_upsert(spark: SparkSession, sf: str) -> DataFrame:
    snap = lambda cond: table(spark, sf, "events").filter(cond).groupBy(F.col("user_id").alias("session")).agg(F.max("event_id").alias("turn_counter"), F.min("event_id").alias("created_at"), F.max("event_id").alias("updated_at"))
    return zones.upsert_sessions(snap("event_id % 2 = 0"), snap("event_id % 3 = 0"))


@query("session_list", "SELECT user_id AS session, max(event_id) AS updated_at FROM events GROUP BY user_id ORDER BY updated_at DESC LIMIT 6")
def session_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("session")).agg(F.max("event_id").alias("updated_at")).orderBy(F.desc("updated_at")).limit(6)


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("event_clock", "SELECT event_id, epoch_us(ts) AS micros, strftime(ts, '%H:%M:%S') AS clock FROM events")
def event_clock(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.date_format("ts", "HH:mm:ss").alias("clock"))

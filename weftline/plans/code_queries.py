"""Queries on code, tool output and compaction, over turns made from the relational tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import code, compact, toolout
from weftline.plans import session_queries
from weftline.plans.registry import query, table

_N = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate)"


def python_turns(spark: SparkSession, sf: str) -> DataFrame:
    """One assignment for each line of an order, each but the first from the one before."""
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey AS session", f"{_N} AS n", "l_partkey")
    value = F.expr("CASE WHEN n = 1 THEN CAST(l_partkey AS STRING) ELSE concat('v', n - 1, ' + 1') END")
    return rows.select("session", F.col("n").cast("int").alias("turn_index"), F.lit("agent").alias("role"), F.concat(F.lit("```python\nv"), F.col("n").cast("string"), F.lit(" = "), value, F.lit("\n```")).alias("content"))


_SQL_TEXT = """CASE o_orderkey % 5 WHEN 0 THEN concat('CREATE TABLE t', o_custkey % 7, ' (id INT, name TEXT)') WHEN 1 THEN concat('ALTER TABLE t', o_custkey % 7, ' ADD x INT')
  WHEN 2 THEN concat('DROP TABLE t', o_custkey % 7) WHEN 3 THEN concat('INSERT INTO t', o_custkey % 7, ' SELECT 1 FROM t', o_custkey % 5) ELSE concat('UPDATE t', o_custkey % 7, ' SET x = 1') END"""


def sql_turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr("o_custkey % 100 AS session", "CAST(o_orderkey AS INT) AS turn_index", "'user' AS role", f"{_SQL_TEXT} AS content")


_SQLT = f"q AS (SELECT o_custkey % 100 AS session, CAST(o_orderkey AS INTEGER) AS turn_index, {_SQL_TEXT} AS content, concat('t', o_custkey % 7) AS tab, concat('t', o_custkey % 5) AS src, o_orderkey % 5 AS k FROM orders)"


_SHELL_TEXT = "CASE p_partkey % 5 WHEN 0 THEN '#!/bin/sh' || chr(10) || 'ls' WHEN 1 THEN '```js' || chr(10) || 'let x = 1' || chr(10) || '```' WHEN 2 THEN 'export A=' || p_partkey WHEN 3 THEN 'plain words on ' || p_name ELSE '```python' || chr(10) || 'def broken' || p_partkey || '(: pass' || chr(10) || '```' END"


def shell_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Shell, JavaScript, plain words and Python that does not parse."""
    return table(spark, sf, "part").selectExpr("p_partkey % 50 AS session", "CAST(p_partkey AS INT) AS turn_index", "'user' AS role", f"{_SHELL_TEXT.replace('chr(10)', 'char(10)')} AS content")


_KINDS = f"""SELECT session, turn_index, CASE WHEN tag IN ('python', 'py') THEN 'python' WHEN tag = 'sql' THEN 'sql' WHEN tag IN ('bash', 'sh', 'shell') THEN 'bash' WHEN tag IN ('js', 'javascript', 'ts', 'typescript') THEN 'javascript'
  WHEN regexp_matches(content, '{tx.PYTHON_WORDS}') THEN 'python' WHEN regexp_matches(content, '{tx.SQL_WORDS}') THEN 'sql' WHEN regexp_matches(content, '{tx.BASH_WORDS}') THEN 'bash' END AS language
  FROM (SELECT *, lower(regexp_extract(content, '```(\\w+)', 1)) AS tag FROM u)"""


@query("detect_language", f"""WITH {_SQLT}, u AS (SELECT session, turn_index, content FROM q UNION ALL SELECT p_partkey % 50, CAST(p_partkey AS INTEGER), {_SHELL_TEXT} FROM part
  UNION ALL SELECT l_orderkey, CAST(n AS INTEGER), concat('```python', chr(10), 'v', n, chr(10), '```') FROM (SELECT l_orderkey, {_N} AS n FROM lineitem) UNION ALL SELECT conv_id, CAST(turn AS INTEGER), text FROM conversations) {_KINDS}""")
def detect_language(spark: SparkSession, sf: str) -> DataFrame:
    talk = session_queries.turns(spark, sf)
    columns = ["session", "turn_index", "content"]
    both = sql_turns(spark, sf).select(columns).unionByName(shell_turns(spark, sf).select(columns)).unionByName(python_turns(spark, sf).select(columns)).unionByName(talk.select(columns))
    return both.select("session", "turn_index", tx.detect_language(F.col("content")).alias("language"))


@query("sql_mutations", f"""WITH {_SQLT} SELECT session, turn_index, 0 AS position, tab AS target, CASE k WHEN 0 THEN 'CREATE(id INT, name TEXT)' WHEN 1 THEN 'ALTER' WHEN 2 THEN 'DROP' WHEN 3 THEN 'INSERT' ELSE 'UPDATE' END AS change,
  CASE WHEN k <= 2 THEN 1.0 ELSE 0.8 END::DOUBLE AS depth, k = 2 AS destructive FROM q""")
def sql_mutations(spark: SparkSession, sf: str) -> DataFrame:
    return code.sql_mutations(sql_turns(spark, sf))


@query("schema_nodes", f'WITH {_SQLT} SELECT session, turn_index, tab AS "table" FROM q WHERE k = 0')
def schema_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return code.schema_nodes(sql_turns(spark, sf))


@query("schema_edges", f"""WITH {_SQLT}, j AS (SELECT r.session, r.src, r.turn_index AS later, max(c.turn_index) AS turn_index FROM q r JOIN q c ON r.k = 3 AND c.k = 0 AND r.session = c.session AND r.src = c.tab AND c.turn_index < r.turn_index GROUP BY ALL)
  SELECT session, concat(turn_index, ':schema_field:', src) AS source_id, concat(later, ':code_block:', src) AS target_id, 'schema_field_dep' AS edge_type, 0.9::DOUBLE AS weight FROM j""")
def schema_edges(spark: SparkSession, sf: str) -> DataFrame:
    return code.schema_edges(sql_turns(spark, sf))


@query("def_use_edges", f"SELECT l_orderkey AS session, concat(n - 1, ':ast_assign:v', n - 1) AS source_id, concat(n, ':ast_call:v', n - 1) AS target_id, 'var_def_to_ref' AS edge_type, 1.0::DOUBLE AS weight FROM (SELECT l_orderkey, {_N} AS n FROM lineitem) WHERE n > 1")
def def_use_edges(spark: SparkSession, sf: str) -> DataFrame:
    return code.def_use_edges(code.code_events(python_turns(spark, sf)))


@query("code_graph", f"SELECT l_orderkey AS session, concat(n, ':ast_assign:v', n) AS node_id, CAST(n AS INTEGER) AS turn_index, 'ast_assign' AS node_type, concat('v', n, ' = ', CASE WHEN n = 1 THEN CAST(l_partkey AS VARCHAR) ELSE concat('v', n - 1, ' + 1') END) AS content FROM (SELECT l_orderkey, l_partkey, {_N} AS n FROM lineitem)")
def code_graph(spark: SparkSession, sf: str) -> DataFrame:
    return code.code_nodes(code.code_events(python_turns(spark, sf))).select("session", "node_id", "turn_index", "node_type", "content")


@query("www_mutations", f"""WITH {_SQLT} SELECT session, turn_index, 'user' AS who, 'schema_change' AS mutation_type, tab AS target, CASE k WHEN 0 THEN 'CREATE(id INT, name TEXT)' WHEN 1 THEN 'ALTER' WHEN 2 THEN 'DROP' WHEN 3 THEN 'INSERT' ELSE 'UPDATE' END AS value,
  CASE WHEN k <= 2 THEN 1.0 ELSE 0.8 END::DOUBLE AS depth FROM q
  UNION ALL SELECT conv_id, CAST(turn AS INTEGER), CASE role WHEN 'user' THEN 'user' WHEN 'tool' THEN 'tool' WHEN 'system' THEN 'system' ELSE 'agent' END, 'nl_statement', 'summary', left(text, 80), 0.0 FROM conversations
  UNION ALL SELECT p_partkey % 50, CAST(p_partkey AS INTEGER), 'user', 'nl_statement', 'summary', left({_SHELL_TEXT}, 80), 0.0 FROM part
  UNION ALL SELECT l_orderkey, CAST(n AS INTEGER), 'agent', 'var_assign', concat('v', n), concat('v', n, ' = ', CASE WHEN n = 1 THEN CAST(l_partkey AS VARCHAR) ELSE concat('v', n - 1, ' + 1') END), 1.0 FROM (SELECT l_orderkey, l_partkey, {_N} AS n FROM lineitem)""")
def www_mutations(spark: SparkSession, sf: str) -> DataFrame:
    """SQL, Python, talk, and code that does not parse."""
    columns = ["session", "turn_index", "who", "mutation_type", "target", "value", "depth"]
    talk = session_queries.turns(spark, sf).select("session", "turn_index", "role", "content")
    found = [code.mutations(t).select(columns) for t in (sql_turns(spark, sf), talk, shell_turns(spark, sf), python_turns(spark, sf))]
    return functools.reduce(DataFrame.unionByName, found)


_PLAIN = "concat(turn_index, ':nl_sentence:', substr(md5(content), 1, 8))"


@query("turn_graph", f"""WITH {_SQLT}, n AS (SELECT session, turn_index, content FROM q WHERE k <> 0 UNION ALL SELECT 1000 + conv_id, CAST(turn AS INTEGER), text FROM conversations
  UNION ALL SELECT 5000 + p_partkey % 50, CAST(p_partkey AS INTEGER), {_SHELL_TEXT} FROM part),
  e AS (SELECT 10000 + user_id AS session, CAST(event_id AS INTEGER) AS turn_index, CASE WHEN event_type = 'error' THEN 'failed: ' || props ELSE props END AS content, event_type = 'error' AS bad, json_extract_string(props, '$.k') AS v FROM events)
  SELECT session, {_PLAIN} AS node_id, turn_index, 'nl_sentence' AS node_type, left(content, 500) AS content FROM n
  UNION ALL SELECT session, concat(turn_index, ':schema_field:', tab), turn_index, 'schema_field', tab FROM q WHERE k = 0
  UNION ALL SELECT session, CASE WHEN bad THEN concat(turn_index, ':api_response:', substr(md5(content), 1, 8)) ELSE concat(turn_index, ':tool_json_field:k') END, turn_index, CASE WHEN bad THEN 'api_response' ELSE 'tool_json_field' END, CASE WHEN bad THEN content ELSE concat('k=', v) END FROM e""")
def turn_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of turns of all kinds: SQL, talk, tool output that is JSON or not, other languages, code that does not parse."""
    columns = ["session", "turn_index", "role", "content", "token_count"]
    tool = table(spark, sf, "events").selectExpr("10000 + user_id AS session", "CAST(event_id AS INT) AS turn_index", "'tool' AS role", "CASE WHEN event_type = 'error' THEN 'failed: ' || props ELSE props END AS content")
    talk = session_queries.turns(spark, sf).withColumn("session", 1000 + F.col("session"))
    made = sql_turns(spark, sf).unionByName(shell_turns(spark, sf).withColumn("session", 5000 + F.col("session"))).unionByName(tool)
    both = made.withColumn("token_count", tx.token_estimate(F.col("content"))).select(columns).unionByName(talk.select(columns))
    return code.turn_graph(both)[0].select("session", "node_id", "turn_index", "node_type", "content")


@query("tool_json_nodes", "SELECT user_id AS session, CAST(event_id AS INTEGER) AS turn_index, 'k' AS key, concat('k=', json_extract_string(props, '$.k')) AS content FROM events")
def tool_json_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return code.json_fields(table(spark, sf, "events").selectExpr("user_id AS session", "CAST(event_id AS INT) AS turn_index", "props AS content"))


@query("tool_field_edges", """WITH l AS (SELECT user_id AS session, max(event_id) AS latest FROM events WHERE event_type = 'view' GROUP BY user_id)
  SELECT user_id AS session, concat(event_id, ':tool_json_field:k') AS source_id, concat(latest, ':ast_assign:K') AS target_id, 'tool_field_to_code_ref' AS edge_type, 0.9::DOUBLE AS weight FROM events JOIN l ON user_id = session""")
def tool_field_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    assigns = e.filter("event_type = 'view'").selectExpr("user_id AS session", "CAST(event_id AS INT) AS turn_index", "'K' AS name")
    return code.tool_field_edges(tool_json_nodes(spark, sf), assigns)


@query("tool_compress", """WITH t AS (SELECT user_id, '[' || string_agg(props, ',' ORDER BY event_id) || ']' AS content, list(json_extract_string(props, '$.k') ORDER BY event_id) AS ks FROM events GROUP BY user_id),
  c AS (SELECT user_id, content, length(content) // 4 AS tokens, '[{"k":' || ks[1] || '},{"k":' || ks[2] || '},{"k":' || ks[3] || '},"... ' || (len(ks) - 3) || ' more items"]' AS short FROM t)
  SELECT user_id AS session, CAST(tokens AS INTEGER) AS original_tokens, CASE WHEN tokens <= 64 THEN content ELSE short END AS compressed, CAST(CASE WHEN tokens <= 64 THEN 0 ELSE tokens - length(short) // 4 END AS INTEGER) AS saved FROM c""")
def tool_compress(spark: SparkSession, sf: str) -> DataFrame:
    held = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "props"))), lambda x: x["props"])
    calls = table(spark, sf, "events").groupBy(F.col("user_id").alias("session")).agg(F.concat(F.lit("["), F.array_join(held, ","), F.lit("]")).alias("content"))
    return toolout.compress(calls, 64).select("session", "original_tokens", "compressed", "saved")


@query("compact_session")
def compact_session(spark: SparkSession, sf: str) -> DataFrame:
    t = session_queries.turns(spark, sf)
    node = F.concat_ws(":", F.col("turn_index").cast("string"), F.lit("turn"))
    nodes = t.select("session", node.alias("node_id"), F.col("turn_index").alias("seq"), F.col("token_count").alias("tokens"), "content")
    edges = t.filter("turn_index % 2 = 1").select("session", F.concat_ws(":", (F.col("turn_index") - 1).cast("string"), F.lit("turn")).alias("src"), node.alias("dst"))
    return compact.compact_sessions(nodes, edges, 256)


# --- event-time windows, beyond parity
@query("events_tumbling", "SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("day"), "event_type", "n", "total")


@query("events_sliding", "SELECT time_bucket(INTERVAL '12 hours', ts) - h * INTERVAL '12 hours' AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS h) GROUP BY ALL")
def events_sliding(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.window("ts", "24 hours", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").alias("start"), "n")


@query("events_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS id FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, id""")
def events_session(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), "n")


@query("event_cube", "SELECT event_type, user_id % 10 AS shard, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 10)")
def event_cube(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", (F.col("user_id") % 10).alias("shard"))
    return e.cube("event_type", "shard").agg(F.count("*").alias("n"))

"""Files, stores, and streams that must agree with their batch forms."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.config import InputError
from weftline.operators import chunking, ingest, memory
from weftline.sources import files, stores
from weftline.streaming import memory_state

TUPLES = "session long, name string, scope string, when long, seq long, value string, is_pinned boolean"


def test_files(spark, tmp_path):
    (tmp_path / "a.py").write_text("import psycopg2\nimport os\nfrom math import sqrt\n")
    (tmp_path / "b.html").write_text("<p>Hi <b>there</b></p>")
    (tmp_path / "c.txt").write_bytes(b"ok \xff end")
    got = {r.doc_id: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["b.html"].text == "Hi there" and got["c.txt"].text == "ok � end" and got["a.py"].file_type == "py"
    py = files.read_files(spark, str(tmp_path / "a.py")).withColumnRenamed("text", "content")
    assert sorted(r.dst for r in ingest.import_edges(py).collect()) == ["math", "os", "psycopg2"]
    assert files.read_text(spark, str(tmp_path / "b.html")).first().doc_id == "b.html"
    assert files.ingest(spark, ["a", "b"]).first().text == "a\n\nb"
    assert files.ingest(spark, "some text").first().file_type == "inline"
    assert files.ingest(spark, str(tmp_path / "b.html")).first().text == "Hi there"
    with pytest.raises(InputError):
        files.read_files(spark, str(tmp_path / "missing.txt"))


def test_session_store(spark, tmp_path):
    store = stores.SessionStore(spark, f"file://{tmp_path}/s")
    row = lambda s, n, at: spark.createDataFrame([(s, n, "h", "p", at, at)], store.SESSIONS)
    tuples = lambda s, *ids: spark.createDataFrame([(s, i, "{}") for i in ids], store.TUPLES)
    store.save(row("a", 1, 1.0), tuples("a", "m1", "m2"))
    store.save(row("b", 1, 2.0), tuples("b", "m3"))
    store.save(row("a", 5, 3.0), tuples("a", "m4"))
    session, held = store.load("a")
    assert session.first().turn_counter == 5 and session.first().created_at == 1.0 and [r.memory_id for r in held.collect()] == ["m4"]
    assert [r.session for r in store.listed().collect()] == ["a", "b"]
    store.delete("a")
    assert store.load("a")[0].count() == 0 and store.load("a")[1].count() == 0 and store.load("b")[1].count() == 1


def test_fact_store(spark, tmp_path):
    store = stores.FactStore(spark, f"file://{tmp_path}/f")
    fact = lambda i, w, at: (i, "s", "t", "c", w, 2, at, at, int(at))
    store.save(spark.createDataFrame([fact("x", 0.9, 1.0), fact("y", 0.8, 2.0)], store.FACTS))
    store.save(spark.createDataFrame([fact("x", 0.5, 3.0)], store.FACTS))
    assert [(r.fact_id, r.weight) for r in store.top().collect()] == [("y", 0.8), ("x", 0.5)]
    assert [r.fact_id for r in store.recent(1).collect()] == ["x"]


def test_memory_lines(spark, tmp_path):
    rows = [("a", "s", "n", "m", 1, 1, "v", False, 0.0, 5), ("b", "s", "n", "m", 2, 2, "w", False, 0.0, 5)]
    path = f"{tmp_path}/memory"
    stores.write_memory(spark.createDataFrame(rows, stores.MEMORY), path)
    (tmp_path / "memory" / "extra.json").write_text("{broken\n" + json.dumps({"memory_id": "c", "session": "s", "name": "o", "scope": "m", "when": 1, "seq": 3, "value": "z", "is_pinned": False, "depth": 0.0, "tokens": 1}) + "\n")
    assert sorted(r.memory_id for r in stores.read_memory(spark, path).collect()) == ["b", "c"]


def stream_of(spark, frames, schema, folder):
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_equals_batch(spark, tmp_path):
    frames = [
        [(1, "x", "m", 10, 0, "a", False), (2, "x", "m", 1, 1, "b", True)],
        [(1, "x", "m", 5, 2, "late", False), (2, "x", "m", 2, 3, "c", False)],
        [(1, "x", "m", 11, 4, "d", False), (1, "y", "m", 3, 5, "e", False)],
    ]
    live = stream_of(spark, frames, TUPLES, f"{tmp_path}/in")
    query = memory_state.remember(live).writeStream.outputMode("update").format("memory").queryName("changes").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    got = memory_state.current(spark.table("changes"))
    want = memory.dedup(spark.createDataFrame([r for f in frames for r in f], TUPLES))
    key = lambda df: sorted((r.session, r.name, r.when, r.value) for r in df.collect())
    assert key(got) == key(want)


def test_snapshots_and_windows(spark, tmp_path):
    live = stream_of(spark, [[(1, f"n{i}", "m", i, i, "v", False) for i in range(6)]], TUPLES, f"{tmp_path}/in")
    memory_state.snapshots(memory_state.remember(live), f"{tmp_path}/out", f"{tmp_path}/cp", 5).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
    events = spark.createDataFrame([(1, "view", 1.0), (2, "view", 2.0)], "h int, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.col("h") * 3600))
    assert memory_state.counts(events).first().n == 2


def run(df, spark, name, folder, mode="update"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_restored_state_goes_on(spark, tmp_path):
    """A query that starts from snapshots ends with the memory of one that saw everything."""
    before = [(1, "x", "m", 10, 0, "a", True), (1, "x", "m", 11, 1, "b", False), (2, "y", "m", 1, 2, "c", False), (1, "z", "m", 3, 3, "d", False)]
    after = [(1, "x", "m", 5, 4, "late", False), (1, "z", "m", 12, 5, "e", False), (3, "n", "m", 1, 6, "f", False)]
    first = stream_of(spark, [before], TUPLES, f"{tmp_path}/a")
    memory_state.snapshots(memory_state.remember(first), f"{tmp_path}/out", f"{tmp_path}/cp", 1).awaitTermination()
    held = memory_state.restore(spark, f"{tmp_path}/out")
    assert held.count() == 4
    changes = run(memory_state.remember(stream_of(spark, [after], TUPLES, f"{tmp_path}/b"), restored=held), spark, "resumed", tmp_path)
    assert {(r.session, r.value, r.turn_counter) for r in changes.collect()} == {(1, "e", 5), (3, "f", 1)}
    got = memory_state.current(held.unionByName(changes))
    want = memory.dedup(spark.createDataFrame(before + after, TUPLES))
    key = lambda df: sorted((r.session, r.name, r.when, r.value) for r in df.collect())
    assert key(got) == key(want)


def test_snapshots_hold_the_latest_tuples(spark, tmp_path):
    live = stream_of(spark, [[(1, f"n{i}", "m", i, i, "v", False) for i in range(9)]], TUPLES, f"{tmp_path}/in")
    memory_state.snapshots(memory_state.remember(live), f"{tmp_path}/out", f"{tmp_path}/cp", 5, 4).awaitTermination()
    assert sorted(r.when for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [5, 6, 7, 8]


def test_facts_at_the_end_of_a_session(spark, tmp_path):
    schema = "session long, turn_index int, role string, content string, weight double, minute int"
    turn = lambda s, i, c, w=0.9, role="user", m=None: (s, i, role, c, w, i if m is None else m)
    frames = [
        [turn(1, 0, "host = db.internal"), turn(1, 1, "use host"), turn(1, 2, "host again"), turn(1, 3, "low = 1", 0.1), turn(2, 0, "key = v")],
        [turn(1, 4, "low low"), turn(1, 5, "low"), turn(1, 6, "", role="end"), turn(2, 1, "key", m=4), turn(2, 2, "key, key", m=5)],
        [turn(3, 0, "x = 1", m=300)],
        [turn(3, 1, "x", m=301)],
    ]
    timed = stream_of(spark, frames, schema, f"{tmp_path}/in").withColumn("ts", F.timestamp_seconds((F.col("minute") + 10) * 60)).drop("minute")
    got = run(memory_state.session_facts(timed), spark, "facts_at_end", tmp_path)
    assert sorted((r.session, r.name, r.content, r.in_degree) for r in got.collect()) == [(1, "host", "host = db.internal", 2), (2, "key", "key = v", 2)]


def test_streamed_chunks_are_those_of_the_whole(spark, tmp_path):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()}
    texts[-1], texts[-2] = "", "say ``` { \n a ' b " * 60
    frames = [[], [], []]
    for k, t in texts.items():
        words = t.split(" ")
        cuts = [0, len(words) // 3, len(words) // 2, len(words)]
        for i in range(3):
            frames[i].append((k, i, " ".join(words[cuts[i] : cuts[i + 1]]), i == 2))
    parts = stream_of(spark, frames, "doc_id long, part int, text string, is_last boolean", f"{tmp_path}/in")
    got = run(memory_state.chunk_stream(parts), spark, "chunks_live", tmp_path, "append").collect()
    whole = chunking.chunk_adaptive(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    key = lambda rows: sorted((r.doc_id, r.pos, r.start, r.end, r.score, r.has_code, r.open_scope, r.chunk.split()) for r in rows)
    assert key(got) == key(whole)


def test_subscribers_and_replay(spark, tmp_path):
    schema = "event_id long, kind string"
    live = stream_of(spark, [[(10, "a")], [(11, "b")]], schema, f"{tmp_path}/in")
    history = spark.createDataFrame([(i, "old") for i in range(10)], schema)
    seen = {"one": [], "two": [], "replayed": []}
    take = lambda name: lambda batch, _: seen[name].extend(sorted(r.event_id for r in batch.collect()))
    for query in memory_state.fan_out(live, {n: take(n) for n in ("one", "two")}, f"{tmp_path}/cp"):
        query.awaitTermination()
    memory_state.replay_and_live(history, live, take("replayed"), f"{tmp_path}/replay", 3).awaitTermination()
    assert seen == {"one": [10, 11], "two": [10, 11], "replayed": [7, 8, 9, 10, 11]}

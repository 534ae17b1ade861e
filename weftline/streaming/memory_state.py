"""Keyed state over streams of memory tuples, turns and texts, and the sinks of the telemetry stream."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline.config import DEFAULT
from weftline.operators import chunking

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUT = "session long, name string, scope string, when long, seq long, value string, is_pinned boolean, turn_counter long"


class MemoryProcessor(StatefulProcessor):
    """The latest tuple of each (name, scope) of a session; an older one that comes late is dropped.

    A pinned tuple that is replaced stays beside the new one. Weights are not stored: they are
    computed where tuples are read, so that state needs no rewriting as turns go by.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getMapState("latest", "name string, scope string", "when long, seq long, value string, is_pinned boolean")
        self.pinned = handle.getMapState("pinned", "name string, scope string, seq long", "when long, value string")
        self.turns = handle.getValueState("turns", "n long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timer_values) -> None:
        """Memory of a snapshot: its latest tuples, those that stay beside them as pinned, and the turn counter."""
        rows = sorted(initialState.itertuples(index=False), key=lambda r: (r.when, r.seq))
        for r in rows:
            at, new = (r.name, r.scope), (int(r.when), int(r.seq), r.value, bool(r.is_pinned))
            held = self.latest.getValue(at) if self.latest.containsKey(at) else None
            if held is not None and held[3]:
                self.pinned.updateValue((*at, held[1]), (held[0], held[2]))
            self.latest.updateValue(at, new)
        if rows:
            self.turns.update((max(int(r.turn_counter) for r in rows),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        n = self.turns.get()[0] if self.turns.exists() else 0
        out = []
        for frame in rows:
            for r in frame.sort_values(["when", "seq"]).itertuples(index=False):
                n += 1
                at = (r.name, r.scope)
                held = self.latest.getValue(at) if self.latest.containsKey(at) else None
                new = (int(r.when), int(r.seq), r.value, bool(r.is_pinned))
                if held is not None and (held[0], held[1]) > (new[0], new[1]):
                    if new[3]:
                        self.pinned.updateValue((*at, new[1]), (new[0], new[2]))
                        out.append((key[0], *at, *new, n))
                    continue
                if held is not None and held[3]:
                    self.pinned.updateValue((*at, held[1]), (held[0], held[2]))
                self.latest.updateValue(at, new)
                out.append((key[0], *at, *new, n))
        self.turns.update((n,))
        yield pd.DataFrame(out, columns=["session", "name", "scope", "when", "seq", "value", "is_pinned", "turn_counter"])

    def close(self) -> None:
        pass


def remember(tuples: DataFrame, mode: str = "Update", restored: DataFrame | None = None) -> DataFrame:
    """Each accepted change of memory. tuples: session, name, scope, when, seq, value, is_pinned.

    restored: what restore() reads from snapshots; the state of a new query begins with it.
    """
    initial = restored.groupBy("session") if restored is not None else None
    return tuples.groupBy("session").transformWithStateInPandas(statefulProcessor=MemoryProcessor(), outputStructType=OUT, outputMode=mode, timeMode="None", initialState=initial)


class SessionProcessor(StatefulProcessor):
    """Turns of a session until it ends: then the facts that are worth keeping are given, and the state is cleared.

    A session ends with a turn of role 'end', or when nothing has come for `idle` of event time. A name that was assigned
    is a fact if its weight is enough and enough later turns of the session mention it.
    """

    def __init__(self, idle_ms: int, least_weight: float, least_degree: int, most: int) -> None:
        self.idle_ms, self.least_weight, self.least_degree, self.most = idle_ms, least_weight, least_degree, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getMapState("facts", "name string", "content string, weight double, uses long")
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        ended, newest = False, self.last.get()[0] if self.last.exists() else 0
        for frame in rows:
            for r in frame.sort_values("turn_index").itertuples(index=False):
                newest = max(newest, int(r.ts.timestamp() * 1000))
                if r.role == "end":
                    ended = True
                    continue
                for name in [k[0] for k in self.facts.keys()]:
                    if re.search(rf"\b{re.escape(name)}\b", r.content or ""):
                        content, weight, uses = self.facts.getValue((name,))
                        self.facts.updateValue((name,), (content, weight, uses + 1))
                found = re.match(r"\s*([A-Za-z_]\w*)\s*=\s*\S", r.content or "")
                if found:
                    uses = self.facts.getValue((found[1],))[2] if self.facts.containsKey((found[1],)) else 0
                    self.facts.updateValue((found[1],), (r.content, float(r.weight), uses))
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        self.last.update((newest,))
        if ended:
            yield self._end(key)
        else:
            self.handle.registerTimer(newest + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._end(key)

    def _end(self, key) -> pd.DataFrame:
        held = [(key[0], k[0], *v) for k, v in self.facts.iterator()]
        best = sorted((x for x in held if x[3] >= self.least_weight and x[4] >= self.least_degree), key=lambda x: (-x[3], x[1]))[: self.most]
        self.facts.clear()
        self.last.clear()
        return pd.DataFrame(best, columns=["session", "name", "content", "weight", "in_degree"])

    def close(self) -> None:
        pass


def session_facts(
    turns: DataFrame, idle: str = "30 minutes", late: str = "1 minute", least_weight: float = DEFAULT.fact_weight, least_degree: int = DEFAULT.fact_in_degree, most: int = DEFAULT.facts_per_session
) -> DataFrame:
    """session, name, content, weight and in_degree of the facts of each session, given when it ends. turns: session, turn_index, role, content, weight, ts."""
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    keyed = turns.withWatermark("ts", late).groupBy("session")
    schema = "session long, name string, content string, weight double, in_degree long"
    return keyed.transformWithStateInPandas(statefulProcessor=SessionProcessor(ms, least_weight, least_degree, most), outputStructType=schema, outputMode="Update", timeMode="EventTime")


class ChunkProcessor(StatefulProcessor):
    """Chunks of a document whose text comes in parts, in order; a part that is the last one closes it."""

    def __init__(self, settings: dict) -> None:
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("chunker", "json string, pos long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        stream, pos = chunking.ChunkStream(**self.settings), 0
        if self.state.exists():
            held, pos = self.state.get()
            stream.load(held)
        out, done = [], False
        for frame in rows:
            for r in frame.sort_values("part").itertuples(index=False):
                made = stream.feed(chunking.TOKEN.findall(r.text or ""))
                if r.is_last:
                    made, done = made + stream.close(), True
                for row in made:
                    out.append((key[0], pos, *row))
                    pos += 1
        if done:
            self.state.clear()
        else:
            self.state.update((stream.dump(), pos))
        yield pd.DataFrame(out, columns=["doc_id", "pos", "start", "end", "chunk", "score", "has_code", "open_scope"])

    def close(self) -> None:
        pass


def chunk_stream(parts: DataFrame, **settings) -> DataFrame:
    """Chunks as they are complete. parts: doc_id, part, text (cut between words) and is_last."""
    schema = "doc_id long, pos int, start int, end int, chunk string, score double, has_code boolean, open_scope boolean"
    return parts.groupBy("doc_id").transformWithStateInPandas(statefulProcessor=ChunkProcessor(settings), outputStructType=schema, outputMode="Append", timeMode="None")


def current(changes: DataFrame) -> DataFrame:
    """Memory after a table of changes: the last of each name and scope, and the pinned ones."""
    from weftline.operators import memory

    return memory.dedup(changes.drop("turn_counter"))


def counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events of each type in each window of event time; later than `late` they are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def snapshots(changes: DataFrame, path: str, checkpoint: str, every: int = DEFAULT.persist_every, most: int = DEFAULT.tuples_persisted):
    """Start a query that appends the changes of sessions whose turn counter passes a multiple of `every` in a batch, the latest `most` of each."""

    def write(batch: DataFrame, batch_id: int) -> None:
        span = batch.groupBy("session").agg(F.min("turn_counter").alias("lo"), F.max("turn_counter").alias("hi"))
        due = span.filter(F.floor(F.col("hi") / every) > F.floor((F.col("lo") - 1) / every))
        newest = Window.partitionBy("session").orderBy(F.desc("turn_counter"))
        kept = batch.join(due.select("session"), "session", "left_semi").withColumn("i", F.row_number().over(newest)).filter(F.col("i") <= most).drop("i")
        kept.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(path)

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def restore(spark: SparkSession, path: str) -> DataFrame:
    """Memory as the snapshots below path have it: what remember() starts from."""
    from weftline.operators import memory

    return memory.dedup(spark.read.parquet(path).drop("batch_id"))


def fan_out(source: DataFrame, subscribers: dict, checkpoint: str) -> list:
    """Start one query for each subscriber, a function of (batch, batch_id); each reads the source at its own pace, so none holds up another."""
    start = lambda name, take: source.writeStream.queryName(name).foreachBatch(take).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
    return [start(name, take) for name, take in subscribers.items()]


def replay_and_live(history: DataFrame, live: DataFrame, take, checkpoint: str, n: int = DEFAULT.replay):
    """Start a query that gives a subscriber the last n events first, and then each batch of the stream."""
    from weftline.operators import telemetry

    def send(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0:
            take(telemetry.last_events(history, n), -1)
        take(batch, batch_id)

    return live.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Stores of sessions, memory and facts as Parquet and JSON files: upsert, load, list and delete.

A store is a folder of versions; a write makes a new version and then names it in a one-row
pointer, so a reader sees the old state or the new one, and a job that dies halfway leaves the old.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import memory, zones


class TableStore:
    """The current version of a table in a folder."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def read(self) -> DataFrame:
        fs, p = self._file("current")
        if not fs.exists(p):
            return self.spark.createDataFrame([], self.schema)
        version = self.spark.read.text(f"{self.path}/current").first()[0]
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{version}")

    def write(self, df: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{version}")
        self.spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/current")


class SessionStore:
    """Snapshots of sessions, and the tuples that belong to them."""

    SESSIONS = "session string, turn_counter long, zone_p_hash string, aligned_zone_p string, created_at double, updated_at double"
    TUPLES = "session string, memory_id string, json string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.sessions, self.tuples = TableStore(spark, f"{path}/sessions", self.SESSIONS), TableStore(spark, f"{path}/tuples", self.TUPLES)

    def save(self, sessions: DataFrame, tuples: DataFrame) -> None:
        """Sessions are inserted or updated, created_at stays; the tuples of these sessions are replaced."""
        rest = self.tuples.read().join(sessions.select("session"), "session", "left_anti")
        self.tuples.write(rest.unionByName(tuples.select("session", "memory_id", "json")))
        self.sessions.write(zones.upsert_sessions(self.sessions.read(), sessions))

    def load(self, session: str) -> tuple[DataFrame, DataFrame]:
        return self.sessions.read().filter(F.col("session") == session), self.tuples.read().filter(F.col("session") == session)

    def listed(self) -> DataFrame:
        return self.sessions.read().orderBy(F.desc("updated_at"), "session").select("session", "updated_at")

    def delete(self, session: str) -> None:
        """The session and its tuples go."""
        self.tuples.write(self.tuples.read().filter(F.col("session") != session))
        self.sessions.write(self.sessions.read().filter(F.col("session") != session))


class FactStore:
    """Facts by id; a later one replaces an earlier one."""

    FACTS = "fact_id string, session string, node_type string, content string, weight double, in_degree long, created_at double, last_accessed_at double, seq long"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = TableStore(spark, path, self.FACTS)

    def save(self, facts: DataFrame) -> None:
        self.table.write(memory.upsert_facts(self.table.read().unionByName(facts)))

    def top(self, n: int = 1000) -> DataFrame:
        return self.table.read().orderBy(F.desc("weight"), "fact_id").limit(n)

    def recent(self, n: int = 20) -> DataFrame:
        return self.table.read().orderBy(F.desc("created_at"), "fact_id").limit(n)


MEMORY = "memory_id string, session string, name string, scope string, when long, seq long, value string, is_pinned boolean, depth double, tokens int"


def write_memory(tuples: DataFrame, path: str) -> None:
    """JSON lines. Pinned tuples carry is_pinned; infinite weights are not written."""
    tuples.drop("weight").write.mode("overwrite").json(path)


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; lines that don't parse are left out, and of equal keys the later tuple wins."""
    rows = spark.read.schema(MEMORY + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return memory.dedup(rows.filter("_corrupt_record IS NULL").drop("_corrupt_record"))

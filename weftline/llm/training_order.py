"""Training-order materialisation of token sequences.

Documents are tokenised, ended by the end-of-text id and cut into sequences of at most
seq_tokens; sequence number i of all n, in the order of tasks and of rows within them, goes to
the global slot p(i) of a keyed permutation of 0..n-1: a Feistel network over the next even
number of bits, walked along its cycle until it falls below n. So the order needs no sort key,
no state and no shuffle of its own, and any slot can be computed, or inverted, alone.

Sequences are then partitioned by ranges of slots, each task getting `task_shards` whole shards in a
row: the partition of a slot is known, so nothing is sampled. A shard holds shard_sequences slots at a
fixed stride, 24 bytes of header (document id, number of the sequence in it, tokens, crc of the ids, and
whether the id is null) and seq_tokens two-byte ids, padded with zeros: slot s is at s % shard_sequences * stride of shard
s // shard_sequences, so a reader resumes anywhere with one seek. A shard is written under a
name of its own by each attempt, and the manifest names the one that counts.

Numbers follow from counts per task, not from collected rows, so the order is that of the key and of
the splits in which the input is read. The slots are dealt in `waves` ranges, one shuffle after the
other, so that the scratch disk holds the shuffle of one range only; with one wave a sequence is read
once, shuffled once and written once.

Defined results: a null or empty text is one sequence of the end-of-text id; repeated rows are
sequences of their own; a null id is carried as null; a very long text is encoded in pieces and held
as its ids, 4 bytes each; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.runtime import deal, drop_table, materialize, new_path
from weftline.llm.tokens import END_OF_TEXT, default_path, encoder, ids_of

ROUNDS = 6
#: Header of a sequence in a shard.
HEAD = np.dtype([("doc_id", "<i8"), ("seq", "<u4"), ("length", "<u4"), ("crc", "<u4"), ("no_id", "<u4")])


class SlotOrder:
    """Keyed permutation of 0..n-1."""

    def __init__(self, n: int, key: str) -> None:
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{i}".encode()).digest()[:8], "little")) for i in range(ROUNDS)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _pass(self, x: np.ndarray, keys: list, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in keys:
            if back:
                left, right = right ^ self._mix(left, key), left
            else:
                left, right = right, left ^ self._mix(right, key)
        return (left << np.uint64(self.half)) | right

    def _walk(self, x: np.ndarray, keys: list, back: bool) -> np.ndarray:
        out = self._pass(np.asarray(x, dtype=np.uint64), keys, back)
        while (over := out >= np.uint64(self.n)).any():
            out[over] = self._pass(out[over], keys, back)
        return out.astype(np.int64)

    def slot(self, i: np.ndarray) -> np.ndarray:
        return self._walk(i, self.keys, False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1], True)


def _sequences(batches: Iterator[pa.RecordBatch], path: str, seq_tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    enc, task, k = encoder(path), TaskContext.get().partitionId(), 0
    names = ["doc_id", "seq", "ids", "task", "k"]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            docs, seqs, ids = [], [], []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                found = np.append(np.frombuffer(ids_of(enc, text.as_py()), dtype=np.uint32), END_OF_TEXT).astype("<u2")
                raw = memoryview(found).cast("B")
                for s in range(0, len(found), seq_tokens):
                    docs.append(doc_id)
                    seqs.append(s // seq_tokens)
                    ids.append(raw[2 * s : 2 * (s + seq_tokens)].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(seqs, pa.int64()), pa.array(ids, pa.binary()), pa.array([task] * len(ids), pa.int64()), pa.array(range(k, k + len(ids)), pa.int64())],
                names=names,
            )
            k += len(ids)


def _slots(batches: Iterator[pa.RecordBatch], order: SlotOrder, part_sequences: int, first: int, until: int) -> Iterator[pa.RecordBatch]:
    """The sequences whose slots are in a range, with slot and part: the number of the task in the range."""
    for batch in batches:
        slot = order.slot(batch.column(3).to_numpy())
        kept = np.flatnonzero((slot >= first) & (slot < until))
        doc_id, seq, ids = (batch.column(i).take(pa.array(kept)) for i in range(3))
        yield pa.RecordBatch.from_arrays([doc_id, seq, ids, pa.array(slot[kept]), pa.array((slot[kept] - first) // part_sequences, pa.int32())], names=["doc_id", "seq", "ids", "slot", "part"])


def _shards(batches: Iterator[pa.RecordBatch], folder: str, seq_tokens: int, shard_sequences: int) -> Iterator[pa.RecordBatch]:
    """Write the shards of a partition, whose rows come in the order of slots; a row per shard."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    out, shard, path, n = None, -1, "", 0

    def closed() -> pa.RecordBatch:
        out.close()
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([path]), pa.array([n], pa.int64())], names=["shard", "path", "sequences"])

    for batch in batches:
        for doc_id, seq, slot, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), batch.column(2), strict=True):
            if slot // shard_sequences != shard:
                if out is not None:
                    yield closed()
                shard, n = slot // shard_sequences, 0
                path = f"{root}/{shard:08d}-{uuid.uuid4().hex}.bin"
                out = store.open_output_stream(path, buffer_size=1 << 20)
            raw = ids.as_buffer().to_pybytes()
            head = np.array([(doc_id or 0, seq, len(raw) // 2, zlib.crc32(raw), doc_id is None)], dtype=HEAD)
            out.write(head.tobytes() + raw + bytes(2 * seq_tokens - len(raw)))
            n += 1
    if out is not None:
        yield closed()


def materialise_order(
    docs: DataFrame, key: str = "training-order", seq_tokens: int = 256, shard_sequences: int = 1 << 14, task_shards: int = 2, waves: int = 2, tokenizer_path: str | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> tuple[DataFrame, str]:
    """Write the shards. Returns the manifest (shard, path, sequences) and the folder."""
    path, spark = tokenizer_path or default_path(), docs.sparkSession
    made = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        lambda b: _sequences(b, path, seq_tokens), "doc_id long, seq long, ids binary, task long, k long"
    )
    made = materialize(made, "order-tokens", level=6)
    per_task = made.groupBy("task").agg(F.count("*").alias("n"))  # a row for each task
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(per_task.select(F.col("task").alias("o_task"), "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")), "order-counts")
    n = offsets.agg(F.sum("n")).first()[0] or 0
    folder = new_path(spark, "order-shards")
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(root)
    order = SlotOrder(max(n, 1), key)
    numbered = made.join(F.broadcast(offsets), F.col("task") == F.col("o_task")).select("doc_id", "seq", "ids", (F.col("ahead") + F.col("k")).alias("i"))
    each = task_shards * shard_sequences
    tasks = max(1, -(-n // (each * waves)))  # of a wave
    parts = []
    for first in range(0, max(n, 1), tasks * each):
        span = (first, first + tasks * each)
        slotted = numbered.mapInArrow(lambda b, span=span: _slots(b, order, each, *span), "doc_id long, seq long, ids binary, slot long, part int")
        dealt = slotted.repartitionById(tasks, F.col("part")).drop("part").sortWithinPartitions("slot")
        parts.append(materialize(dealt.mapInArrow(lambda b: _shards(b, folder, seq_tokens, shard_sequences), "shard long, path string, sequences long"), "order-manifest"))
        del slotted, dealt
        if waves > 1:
            spark.range(1).count()  # the last query that Spark remembers is then another one
            gc.collect()
            spark._jvm.System.gc()  # lets Spark delete the shuffle of this wave
    written = parts[0]
    for part in parts[1:]:
        written = written.unionByName(part)
    drop_table(made)
    return written, folder


def _read(batches: Iterator[pa.RecordBatch], folder: str, seq_tokens: int, shard_sequences: int) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, _ = fs.FileSystem.from_uri(folder)
    stride = HEAD.itemsize + 2 * seq_tokens
    names = ["slot", "shard", "position", "doc_id", "seq", "length", "ids_crc32", "intact"]
    for batch in batches:
        for shard, path, first, last in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            with store.open_input_file(path) as f:
                f.seek(first * stride)
                for at in range(first, last, 4096):
                    n = min(4096, last - at)
                    raw = np.frombuffer(f.read(n * stride), dtype=np.uint8).reshape(n, stride)
                    head = raw[:, : HEAD.itemsize].copy().view(HEAD)[:, 0]
                    crc = np.array([zlib.crc32(raw[i, HEAD.itemsize : HEAD.itemsize + 2 * int(head["length"][i])]) for i in range(n)], dtype=np.int64)
                    place = np.arange(at, at + n)
                    columns = [shard * shard_sequences + place, np.full(n, shard), place * stride, None, head["seq"].astype(np.int64), head["length"].astype(np.int64), crc]
                    arrays = [pa.array(head["doc_id"], mask=head["no_id"] == 1) if c is None else pa.array(c) for c in columns]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(head["crc"] == crc)], names=names)


def read_order(written: DataFrame, folder: str, seq_tokens: int = 256, shard_sequences: int = 1 << 14, start_slot: int = 0, tasks: int = 20_000) -> DataFrame:
    """A row for each slot from start_slot on, read sequentially from the shards: slot, shard, position (byte),
    doc_id, seq, length, ids_crc32 (of the ids read) and intact (it is the crc that was written). A task reads a shard,
    or several if there are more than `tasks`."""
    first = F.greatest(F.lit(start_slot) - F.col("shard") * shard_sequences, F.lit(0)).cast("long")
    jobs = written.filter((F.col("shard") + 1) * shard_sequences > start_slot).select("shard", "path", first.alias("first"), F.col("sequences").alias("until"))
    schema = "slot long, shard long, position long, doc_id long, seq long, length long, ids_crc32 long, intact boolean"
    return deal(jobs, jobs.count(), tasks).mapInArrow(lambda b: _read(b, folder, seq_tokens, shard_sequences), schema)


def round_trip(docs: DataFrame) -> DataFrame:
    """Write the shards of all documents and return what read_order() finds in them."""
    return read_order(*materialise_order(docs))

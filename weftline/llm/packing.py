"""Pack documents into training sequences by harmonic classes.

A document's tokens are ended by an id of 0. A document of length n up to the capacity C is of class
k = floor(C / n): its length is in the interval (C / (k + 1), C / k], and a bin of class k takes
exactly k documents of that class, whole, in the order in which they come. Only what is longer than
C is cut: sequences of C ids, and a rest that has a class of its own.

A bin that has its k documents may be left with a gap, always below 1 / (k + 1) of C. The gaps of at
least min_gap ids that wait are filled with the ids of a long document before the rest of it is cut
into whole sequences, the widest gap first; and once the gaps that wait hold as many ids as a
document of any class has, that document is poured into them instead of being put in a bin. So the
padding that harmonic classes alone would leave is filled, and most documents stay whole.

Each task packs what it reads on its own, in one pass: it holds the open bin of each class (there are
fewer than 2 sqrt(C) classes) and the waiting gaps, which hold fewer than C + C / 2 ids together.
At its end the documents of the open bins are joined, poured into the waiting gaps and into whole
sequences; the last ones are powers of two, which need no padding. Sequences are numbered within
each task, and the counts of the tasks, a row for each, give the offsets. No token and no text is
shuffled, and a hot class is not gathered.

Defined results: a null or empty text is the single id 0; repeated rows are packed each; a null
id is carried; a very long text is encoded in pieces and held as its ids, 4 bytes each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.runtime import materialize
from weftline.llm.tokens import default_path, encoder, ids_of

CAPACITY = 1024
MIN_GAP = 32
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k long, offset long, task long"


class Packer:
    """Places runs of ids in numbered sequences; put(run, start, length, sequence, offset) takes each piece."""

    def __init__(self, put: Callable, capacity: int = CAPACITY, min_gap: int = MIN_GAP) -> None:
        self.put, self.capacity, self.min_gap = put, capacity, min_gap
        self.count = 0  # sequences so far
        self.open: dict[int, list] = {}  # class: runs (run, start, length) of its open bin
        self.gaps: list[tuple[int, int, int]] = []  # (room, sequence, offset), narrowest first
        self.room = 0  # ids that the waiting gaps hold

    def _next(self) -> int:
        self.count += 1
        return self.count - 1

    def _wait(self, sequence: int, offset: int) -> None:
        if self.capacity - offset >= self.min_gap:
            bisect.insort(self.gaps, (self.capacity - offset, sequence, offset))
            self.room += self.capacity - offset

    def _pour(self, run, start: int, length: int) -> int:
        """Fill gaps, widest first; returns how many ids went into them."""
        done = 0
        while self.gaps and done < length:
            room, sequence, offset = self.gaps.pop()
            self.room -= room
            n = min(room, length - done)
            self.put(run, start + done, n, sequence, offset)
            self._wait(sequence, offset + n)
            done += n
        return done

    def add(self, run, length: int) -> None:
        """Pack a document: run is its handle, length its ids."""
        at = 0
        if length > self.capacity:
            at = self._pour(run, 0, length)
            while length - at > self.capacity:
                self.put(run, at, self.capacity, self._next(), 0)
                at += self.capacity
        elif self.room >= length:
            at = self._pour(run, 0, length)
        if at < length:
            self._class(run, at, length - at)

    def _class(self, run, start: int, length: int) -> None:
        k = self.capacity // length
        held = self.open.setdefault(k, [])
        held.append((run, start, length))
        if len(held) == k:
            sequence, offset = self._next(), 0
            for r, s, n in self.open.pop(k):
                self.put(r, s, n, sequence, offset)
                offset += n
            self._wait(sequence, offset)

    def close(self) -> None:
        """Place the documents of the open bins."""
        left = [x for k in sorted(self.open) for x in self.open[k]]
        self.open = {}
        rest = []
        for run, start, length in left:
            done = self._pour(run, start, length)
            if done < length:
                rest.append((run, start + done, length - done))
        total = sum(x[2] for x in rest)
        sequence, offset, size = -1, 0, 0
        for run, start, length in rest:
            while length:
                if offset == size:
                    size = self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1)
                    sequence, offset = self._next(), 0
                n = min(length, size - offset)
                self.put(run, start, n, sequence, offset)
                start, length, offset, total = start + n, length - n, offset + n, total - n


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, min_gap: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    enc, task = encoder(path), TaskContext.get().partitionId()
    names = [x.split()[0] for x in PIECES.split(", ")]
    out: list[tuple] = []

    def put(run, start: int, length: int, sequence: int, offset: int) -> None:
        doc_id, ids = run
        out.append((doc_id, start, length, zlib.crc32(memoryview(ids).cast("B")[4 * start : 4 * (start + length)]), len(ids), sequence, offset, task))

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(names))], names=names)
        out.clear()
        return rows

    packer = Packer(put, capacity, min_gap)
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = ids_of(enc, text.as_py())
            ids.append(0)
            packer.add((doc_id, ids), len(ids))
        yield flush()
    packer.close()
    yield flush()


def pack(
    docs: DataFrame, capacity: int = CAPACITY, min_gap: int = MIN_GAP, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    path = tokenizer_path or default_path()
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda b: _pieces(b, path, capacity, min_gap), PIECES)
    pieces = materialize(pieces, "pack-pieces")
    # a row for each task
    per_task = materialize(pieces.groupBy("task").agg((F.max("k") + 1).alias("n")), "pack-counts")
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select(F.col("task").alias("o_task"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    placed = pieces.join(F.broadcast(offsets), F.col("task") == F.col("o_task"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("ahead") + F.col("k")).alias("sequence_id"), "offset")

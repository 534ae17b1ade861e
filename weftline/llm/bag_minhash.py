"""Near-duplicate documents by BagMinHash.

A document is the multiset of its five-word shingles. Its signature is unbiased for weighted
Jaccard: the weights are discretised into whole levels, and the levels into the dyadic intervals
(0,1], (1,2], (2,4], (4,8] and so on. Each shingle has, in each interval that its weight
reaches, a Poisson process of points, as many to the unit of time as the interval has levels; a
point has a time, a slot of the signature and a level, all from hashes of shingle, interval and
number, and counts if its level is within the weight. A slot's value is its earliest point. The
processes of all shingles advance together and stop once their next point is later than every
slot of the document, so most shingles of a long document yield one point.

Texts with equal sequences of words are one node, so copies cost nothing. The signature is cut
into bands; equal bands make a bucket. In each bucket every node is compared with one head, and
the multisets are compared exactly: two nodes are linked at a weighted Jaccard similarity of 0.8
or more. Classes are the connected components. Buckets that still hold several classes get
another head, drawn by a hash, which meets the nodes of other classes only; a crowd of near
copies falls into one class in a few such rounds. Where a bucket then still holds several classes,
the nodes of different classes meet, in tiles of bounded size and with finer signatures of 1024 slots
of 4 bits: first each node is compared with the BEST nodes of other classes by their signatures, then, among the classes that are left,
all pairs whose signatures may reach 0.8 are compared exactly. A class of many nodes in a bucket has
blocks of its own, which don't meet each other, and the others share blocks, so the tiles are of the
pairs that are needed. No pairs are emitted within a class.

What is lost: with 32 bands of 5 slots a pair at 0.8 shares no bucket with probability 3e-6; a pair
that no head has linked in any of its buckets, and whose classes nothing else joins, is missed if its
finer signatures are 4.5 standard deviations below those of a similarity of 0.8, also with probability 3e-6.

Hot buckets: the first node and the size come from an aggregation, links are joined to buckets
by a join that Spark may split, and the comparisons with one node are dealt to as many tasks as
they need.

Defined results: a null text counts as empty; a text without words is a class of its own; a text
of one to four words is one shingle; repeated rows are in one class; class_id is the smallest
id of the class, null only if all its ids are; keep marks one row of each class, that of the
smallest id; a very long text is hashed in pieces of 1 MB and compared whole, 16 bytes a word in
memory; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.runtime import drop_table, materialize
from weftline.llm.shingles import mix, multisets, parts, sequence_keys

BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
#: Rounds of heads before the nodes of different classes meet.
ROUNDS = 3
#: Nodes of other classes that a node is compared with before all that may be near are.
BEST = 8
#: Slots of the finer signature, of 4 bits, so one in 16 is equal by chance; and the least number of equal ones of a
#: pair that is compared exactly: 4.5 standard deviations below that of a similarity of 0.8.
FINE = 1024
LEAST_FINE = int(FINE * (0.8125 - 4.5 * (0.8125 * 0.1875 / FINE) ** 0.5))
#: Nodes in a block, two of which make a tile, and comparisons with one node in one task.
TILE, SHARE = 256, 64

_POINT, _SLOT, _LEVEL = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03


def _times(k: int, by: int) -> np.uint64:
    return np.uint64(k * by % (1 << 64))


def signatures(n_texts: int, owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Time of the earliest point in each slot of each text; infinite in a text without shingles."""
    best = np.full((n_texts, slots), np.inf)
    flat = best.ravel()
    texts, seeds, low, high, held = [owner], [shingle], [np.zeros(len(owner))], [np.ones(len(owner))], [weight]
    level = 0
    while len(more := np.flatnonzero(weight > (1 << level))):
        texts.append(owner[more])
        seeds.append(mix(shingle[more] + _times(level + 1, _LEVEL)))
        low.append(np.full(len(more), float(1 << level)))
        high.append(np.full(len(more), float(2 << level)))
        held.append(weight[more])
        level += 1
    text, seed, low, high, held = (np.concatenate(x) for x in (texts, seeds, low, high, held))
    time, k = np.zeros(len(text)), 0
    while len(text):
        k += 1
        unit = ((mix(seed + _times(k, _POINT)) >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
        time = time - np.log(unit) / (high - low)
        where = text * slots + (mix(seed ^ _times(k, _SLOT)) % np.uint64(slots)).astype(np.int64)
        at = low + 1 + np.floor((mix(seed + _times(k, _LEVEL)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 * (high - low))
        within = at <= held
        np.minimum.at(flat, where[within], time[within])
        there, back = np.unique(text, return_inverse=True)
        on = time < best[there].max(axis=1)[back]
        text, seed, low, high, held, time = text[on], seed[on], low[on], high[on], held[on], time[on]
    return best


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, id, n (shingles), key1, key2 and bands of each text."""
    for batch in batches:
        texts = batch.column(2).fill_null("")
        for i, j, hashes, counts in parts(texts):
            key1, key2 = sequence_keys(hashes, counts)
            owner, shingle, weight = multisets(hashes, counts)
            best = signatures(len(counts), owner, shingle, weight).view(np.uint64)
            total = np.bincount(owner, weight, len(counts)).astype(np.int64)
            groups = best.reshape(len(counts), BANDS, ROWS)
            band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_SLOT), (len(counts), BANDS))
            for r in range(ROWS):
                band = mix(band ^ groups[:, :, r]) + np.uint64(_POINT)
            lists = pa.ListArray.from_arrays(np.arange(0, (len(counts) + 1) * BANDS, BANDS, dtype=np.int32), pa.array(band.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], batch.column(1)[i:j], pa.array(total), pa.array(key1), pa.array(key2), lists],
                names=["row", "id", "n", "key1", "key2", "bands"],
            )


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row and fine: the finer signature of each text, two slots in a byte."""
    for batch in batches:
        for i, j, hashes, counts in parts(batch.column(1).fill_null("")):
            best = signatures(len(counts), *multisets(hashes, counts), FINE).view(np.uint64)
            slots = (mix(best) & np.uint64(15)).astype(np.uint8)
            packed = slots[:, 0::2] | (slots[:, 1::2] << 4)
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([x.tobytes() for x in packed], pa.binary())], names=["row", "fine"])


def _same(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether two multisets have a weighted Jaccard similarity of 0.8 or more."""
    sum_a, sum_b = int(a[1].sum()), int(b[1].sum())
    if 10 * min(sum_a, sum_b) < 8 * max(sum_a, sum_b) or not sum_a:
        return False
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    hit = a[0][at] == b[0]
    both = int(np.minimum(a[1][at[hit]], b[1][hit]).sum())
    return 10 * both >= 8 * (sum_a + sum_b - both)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) among rows (a, salt, b, text), each a's own text first, with b null."""
    current, leader = None, None
    for batch in batches:
        a, salt, b = (batch.column(k).to_pylist() for k in range(3))
        out: list[tuple[int, int]] = []
        for i, _, hashes, counts in parts(batch.column(3).fill_null("")):
            owner, shingle, weight = multisets(hashes, counts)
            ends = np.searchsorted(owner, np.arange(len(counts) + 1))
            for t in range(len(counts)):
                own = (shingle[ends[t] : ends[t + 1]], weight[ends[t] : ends[t + 1]])
                if b[i + t] is None:
                    current, leader = (a[i + t], salt[i + t]), (own[0].copy(), own[1].copy())
                elif current == (a[i + t], salt[i + t]) and _same(leader, own):
                    out.append((a[i + t], b[i + t]))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _large(side: DataFrame) -> DataFrame:
    """A side that grows with the corpus and is not to be broadcast at any size."""
    return side.hint("merge")


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows whose texts are near-duplicates, exactly. texts: row and text."""
    pairs = materialize(pairs, "near-asked")
    sized = pairs.groupBy("a").agg(F.count("*").alias("n")).select(F.col("a").alias("n_a"), F.ceil(F.col("n") / SHARE).cast("int").alias("tasks"))
    # both sides are tables, so that Spark may split the join at a node with many pairs
    salted = pairs.join(_large(materialize(sized, "near-tasks")), F.col("a") == F.col("n_a")).select("a", F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int").alias("salt"), "b")
    salted = materialize(salted, "near-pairs")
    drop_table(pairs)
    members = salted.join(_large(texts), F.col("b") == F.col("row")).select("a", "salt", "b", "text")
    heads = salted.select("a", "salt").distinct().join(_large(texts), F.col("a") == F.col("row")).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    dealt = members.unionByName(heads).repartition(F.col("a"), F.col("salt")).sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    links = materialize(dealt.mapInArrow(_compare, "a long, b long"), "near-links")
    drop_table(salted)
    return links


def components(links: DataFrame) -> DataFrame:
    """node and label: the smallest node of its connected component, for all nodes of links (a, b)."""
    both = materialize(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        # smallest label among neighbours, then the label of the label
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(seen, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("next"))
        lower = materialize(lower, "labels")
        jump = lower.select(F.col("node").alias("j_node"), F.col("next").alias("j_next"))
        after = lower.join(jump, F.col("next") == F.col("j_node")).select("node", F.least("next", "j_next").alias("label"), F.col("label").alias("before"))
        after = materialize(after, "labels")
        changed = after.filter("label <> before").limit(1).count()
        drop_table(lower)
        drop_table(labels)
        labels = after.select("node", "label")
        labels._weftline_path = after._weftline_path
        if not changed:
            return labels


def _meet(batches: Iterator[pa.RecordBatch], best: int) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes of different classes whose signatures may reach the threshold; best: at most so many for each node, if not 0.

    Rows (bucket, i, j, side, row, class, n, fine, buckets) come sorted by tile (bucket, i, j). A pair that shares several
    buckets is given in the first of them.
    """
    held: list[tuple] = []
    key = None

    def pairs() -> list[tuple[int, int]]:
        row, group, n = (np.array([h[k] for h in held], dtype=np.int64) for k in (1, 2, 3))
        side = np.array([h[0] for h in held])
        packed = np.frombuffer(b"".join(h[4] for h in held), dtype=np.uint8).reshape(len(held), FINE // 2)
        slots = np.concatenate([packed & 15, packed >> 4], axis=1)
        shared = [set(h[5]) for h in held]
        out = []
        for x in np.flatnonzero(side <= 1):
            # within a tile on the diagonal every row is on both sides
            others = np.flatnonzero((side != 1) & (group != group[x]) & (10 * np.minimum(n, n[x]) >= 8 * np.maximum(n, n[x])) & ((side == 2) | (row > row[x])))
            if len(others):
                equal = np.count_nonzero(slots[others] == slots[x], axis=1)
                near = others[equal >= LEAST_FINE]
                near = np.array([y for y in near if min(shared[x] & shared[y]) == key[0]], dtype=np.int64)
                if best and len(near) > best:
                    near = near[np.lexsort((row[near], -equal[np.searchsorted(others, near)]))[:best]]
                out += [(min(int(row[x]), int(row[y])), max(int(row[x]), int(row[y]))) for y in near]
        return out

    def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for bucket, i, j, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (bucket, i, j) != key:
                if len(held) > 1:
                    yield batch_of(pairs())
                key, held = (bucket, i, j), []
            held.append(tuple(rest))
    if len(held) > 1:
        yield batch_of(pairs())


def _classed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """bucket, row, n and class of the members of buckets."""
    if labels is None:
        return members.withColumn("class", F.col("row"))
    named = labels.select(F.col("node").alias("l_node"), "label")
    return members.join(_large(named), F.col("row") == F.col("l_node"), "left").select("bucket", "row", "n", F.coalesce("label", "row").alias("class"))


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after more links: the classes that links join become one."""
    if labels is None:
        return components(links)
    end = lambda c: labels.select(F.col("node").alias(f"n_{c}"), F.col("label").alias(f"l_{c}"))
    joined = links.join(end("a"), F.col("a") == F.col("n_a"), "left").join(end("b"), F.col("b") == F.col("n_b"), "left")
    classes = components(joined.select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b")))
    of = classes.select(F.col("node").alias("c_node"), F.col("label").alias("c_label"))
    old = labels.join(of, F.col("label") == F.col("c_node"), "left").select("node", F.coalesce("c_label", "label").alias("label"))
    new = classes.join(labels.select("node"), "node", "left_anti")
    return materialize(old.unionByName(new), "labels")


def _head_pairs(members: DataFrame, labels: DataFrame | None, k: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of the k-th head of each bucket and the nodes of other classes there, and the members of these buckets."""
    classed = materialize(_classed(members, labels), "near-buckets")
    draw = F.xxhash64("row", F.lit(k))
    heads = classed.groupBy("bucket").agg(
        F.min_by("row", draw).alias("a"), F.min_by("class", draw).alias("a_class"), F.min_by("n", draw).alias("a_n"), F.min("class").alias("lo"), F.max("class").alias("hi")
    )
    heads = heads.filter("lo <> hi").withColumnRenamed("bucket", "h_bucket")
    met = materialize(classed.join(_large(heads), F.col("bucket") == F.col("h_bucket")).select("bucket", "row", "n", "class", "a", "a_class", "a_n"), "near-met")
    drop_table(classed)
    close = 10 * F.least("n", "a_n") >= 8 * F.greatest("n", "a_n")
    return met.filter((F.col("class") != F.col("a_class")) & close).select("a", F.col("row").alias("b")).distinct(), met


def _open_pairs(members: DataFrame, fine: DataFrame, labels: DataFrame, best: int) -> DataFrame:
    """Pairs worth comparing among nodes that share a bucket but no class."""
    classed = materialize(_classed(members, labels), "near-buckets")
    groups = materialize(classed.groupBy("bucket", "class").agg(F.count("*").alias("m")), "near-groups")
    open_ = groups.groupBy(F.col("bucket").alias("o_bucket")).agg(F.count("*").alias("classes"), F.sum("m").alias("size")).filter("classes > 1 and size > 2").select("o_bucket")
    groups = groups.join(_large(open_), F.col("bucket") == F.col("o_bucket"), "left_semi").withColumn("own", F.when(F.col("m") >= TILE // 2, F.col("class")))
    # blocks of a bucket, numbered: those that small classes share, own null, and then those of each large class
    in_bucket = Window.partitionBy("bucket")
    before = in_bucket.orderBy(F.col("own").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    kinds = groups.groupBy("bucket", "own").agg(F.ceil(F.sum("m") / TILE).cast("int").alias("t"))
    kinds = kinds.select(F.col("bucket").alias("k_bucket"), F.col("own").alias("k_own"), "t", F.coalesce(F.sum("t").over(before), F.lit(0)).cast("int").alias("first"), F.sum("t").over(in_bucket).cast("int").alias("total"))
    plan = groups.join(_large(kinds), (F.col("bucket") == F.col("k_bucket")) & F.col("own").eqNullSafe(F.col("k_own"))).select(
        F.col("bucket").alias("p_bucket"), F.col("class").alias("p_class"), F.col("own").isNotNull().alias("large"), "t", "first", "total"
    )
    plan = materialize(plan, "near-plan")
    dealt = classed.join(_large(plan), (F.col("bucket") == F.col("p_bucket")) & (F.col("class") == F.col("p_class")))
    dealt = dealt.withColumn("block", F.col("first") + F.pmod(F.xxhash64("row"), F.col("t")).cast("int"))
    dealt = materialize(dealt.select("bucket", "row", "n", "class", "block", "large", "first", "t", "total"), "near-dealt")
    # tile (i, j), i <= j: block i on side 1 and block j on side 2; both sides are one, 0, where i = j
    meets = lambda o: ~(F.col("large") & (o >= F.col("first")) & (o < F.col("first") + F.col("t")))
    tile = F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.col("total") - 1), meets), lambda o: F.struct(
        F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j"),
        F.when(o == F.col("block"), 0).when(F.col("block") < o, 1).otherwise(2).alias("side"),
    )))
    spread = dealt.select("bucket", "row", "n", "class", tile.alias("x")).select("bucket", "x.i", "x.j", "x.side", "row", "class", "n")
    held = dealt.groupBy("row").agg(F.collect_list("bucket").alias("buckets"))  # at most BANDS each
    told = fine.withColumnRenamed("row", "f_row").join(held.withColumnRenamed("row", "h_row"), F.col("f_row") == F.col("h_row")).select("f_row", "fine", "buckets")
    full = spread.join(told, F.col("row") == F.col("f_row")).select("bucket", "i", "j", "side", "row", "class", "n", "fine", "buckets")
    return full.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(lambda b: _meet(b, best), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, class_id and keep of every row; row numbers the rows of docs as read."""
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return _classes(materialize(base, "near-docs"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, that of the smallest id, with all its columns."""
    whole = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "near-docs")
    base = whole.select("row", F.col(f"doc.{id_col}").cast("long").alias("id"), F.col(f"doc.{text_col}").alias("text"))
    left = materialize(_classes(base).filter(~F.col("keep")).select(F.col("row").alias("l_row")), "near-left")
    return whole.join(left, F.col("row") == F.col("l_row"), "left_anti").select("doc.*")


def _classes(base: DataFrame) -> DataFrame:
    """row, doc_id, class_id and keep. base: row, id and text, as a table."""
    sketches = base.mapInArrow(_sketch, "row long, id long, n long, key1 long, key2 long, bands array<long>")
    sketches = materialize(sketches, "near-sketches")
    keys = materialize(sketches.drop("bands"), "near-keys")
    copies = materialize(keys.filter("n > 0").groupBy("key1", "key2").agg(F.min("row").alias("node")), "near-copies")
    banded = sketches.join(_large(copies.select("node")), F.col("row") == F.col("node"), "left_semi").select("row", "n", F.explode("bands").alias("bucket"))
    banded = materialize(banded, "near-bands")
    drop_table(sketches)
    crowded = banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").select(F.col("bucket").alias("b_bucket"))
    members = materialize(banded.join(_large(crowded), F.col("bucket") == F.col("b_bucket")).select("bucket", "row", "n"), "near-members")
    drop_table(banded)
    # the texts of nodes that share a bucket with another: what is compared, shuffled once
    nodes = members.select(F.col("row").alias("m_row")).distinct()
    texts = materialize(base.select("row", "text").join(_large(nodes), F.col("row") == F.col("m_row"), "left_semi"), "near-texts")
    labels = None
    for k in range(ROUNDS):
        pairs, met = _head_pairs(members, labels, k)
        links = compare(pairs, texts)
        drop_table(members)
        members = materialize(met.select("bucket", "row", "n"), "near-members")
        drop_table(met)
        labels = _merged(labels, links)
        if links.limit(1).count() == 0:
            break
    left = members.select(F.col("row").alias("m_row")).distinct()
    fine = materialize(texts.join(left, F.col("row") == F.col("m_row"), "left_semi").mapInArrow(_finer, "row long, fine binary"), "near-fine")
    tried = materialize(_open_pairs(members, fine, labels, BEST), "near-best")
    labels = _merged(labels, compare(tried, texts))
    rest = _open_pairs(members, fine, labels, 0).join(tried.select(F.col("a").alias("t_a"), F.col("b").alias("t_b")), (F.col("a") == F.col("t_a")) & (F.col("b") == F.col("t_b")), "left_anti")
    labels = _merged(labels, compare(rest, texts))
    drop_table(texts)

    node = copies.select(F.col("key1").alias("k1"), F.col("key2").alias("k2"), "node")
    of_node = node.join(labels.withColumnRenamed("node", "l_node"), F.col("node") == F.col("l_node"), "left").select("k1", "k2", F.coalesce("label", "node").alias("class"))
    rows = keys.join(_large(of_node), (F.col("key1") == F.col("k1")) & (F.col("key2") == F.col("k2")) & (F.col("n") > 0), "left")
    rows = materialize(rows.select("row", F.col("id").alias("doc_id"), F.coalesce("class", "row").alias("class")), "near-classes")
    best = rows.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    best = materialize(best.select(F.col("class").alias("c"), "class_id", F.col("best.row").alias("best_row")), "near-best-rows")
    return rows.join(best, F.col("class") == F.col("c")).select("row", "doc_id", "class_id", (F.col("row") == F.col("best_row")).alias("keep"))

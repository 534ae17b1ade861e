"""Nulls, empty and long texts, ties, repeated rows, empty tables, and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import bag_minhash, line_dedup, mixing, packing, permutation_index, pu_classifier, quality_rules, secret_scan, training_order, warc

BASE = "doc_id long, text string, lang string, source string"
CLASH = ("row", "id", "doc", "h", "n", "class", "node", "label", "start", "lines", "i", "pos", "rank", "cell", "size", "target", "whole", "limit", "p_source", "task", "k", "base", "tokens", "spans", "keep", "removed_lines", "n_lines")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60000))
ROWS = [
    (None, None, None, None), (1, "", "en", "a"), (2, " \n ", "en", "a"), (3, "one two", "en", "b"), (3, "one two", "en", "b"), (4, LONG, None, "b"), (5, LONG, None, "b"),
    (6, "token = abcdefghijklmnop and more", "en", None), (None, "no id here at all, but words", "de", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, BASE).select("*", *[F.lit(f"clash-{c}").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (3, 1), (3, 1), (4, 1), (None, 1), (7, None)], "doc_id long, quality int")


def test_line_dedup(docs, empty):
    got = line_dedup.line_dedup(docs).collect()
    assert len(got) == len(ROWS) and line_dedup.line_dedup(empty).count() == 0
    assert {r.row for r in got} == {"clash-row"}
    texts = {(r.doc_id, r.text) for r in got}
    assert (4, LONG) in texts and (5, "") in texts and (None, None) in texts and (3, "one two") in texts
    assert [r.removed_lines for r in got if r.doc_id == 5] == [[0]]


def test_warc(spark):
    rows = [(1, "u", "x"), (1, "u", "x"), (None, None, None), (None, "u", "y"), (3, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("row"), F.lit(2).alias("digest"))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=repr)
    assert got == sorted([(1, 1, "response", None), (1, 1, "revisit", 1), (None, 0, "revisit", 3), (None, 1, "response", None), (3, 0, "response", None)], key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0
    small = warc.round_trip(spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id long, url string, html string"), min_bytes=2).collect()
    assert {r.record_type for r in small} == {"response"}


def test_quality_rules(docs, empty):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(ROWS) and quality_rules.quality_rules(empty).count() == 0
    assert {r.kept for r in got if r.doc_id in (1, 2, 3)} == {False} and {r.kept for r in got if r.doc_id in (4, 5)} == {True}


def test_permutation_index(spark):
    v = [[1.0, 0.0], [0.0, 2.0], [1.0, 1.0], [1.0, 1.0], None, [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0]]
    rows = [(i, x) for i, x in enumerate(v)] + [(None, [0.5, 0.5]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit("x").alias("row"), F.lit(1).alias("places"))
    got = permutation_index.nearest(df, F.col("vec_id") % 20 == 0, k=3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted([(0, i + 1, x, 1.0) for i, x in enumerate((0, 2, 3))] * 2)
    assert permutation_index.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and mixing.mix(empty).count() == 0
    assert all(r.taken <= 3 * r.size for r in got)
    again = mixing.mix(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    repeated = mixing.mixed(docs)
    assert repeated.columns == docs.columns
    assert repeated.count() == sum(r.repeats for r in got) and mixing.mixed(empty).count() == 0


def test_training_order(docs, empty):
    got = training_order.round_trip(docs).collect()
    assert sorted(r.slot for r in got) == list(range(len(got))) and all(r.intact for r in got)
    assert sum(r.doc_id is None for r in got) == 2
    assert training_order.round_trip(empty).count() == 0


def test_classifier(docs, empty, labels):
    got = pu_classifier.classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert pu_classifier.classify(empty, labels).count() == 0
    assert {r.score for r in pu_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert pu_classifier.keep_good(docs, labels.limit(0)).count() == len(ROWS)


def test_packing(docs, empty):
    got = packing.pack(docs).collect()
    assert packing.pack(empty).count() == 0
    ones = [r for r in got if r.doc_tokens == 1]
    assert len(ones) == 2 and {r.length for r in ones} == {1}


def test_near_duplicates(docs, empty):
    got = bag_minhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS) and bag_minhash.near_duplicates(empty).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.class_id for r in by[4] + by[5]} == {4} and {r.class_id for r in by[3]} == {3} and sorted(r.keep for r in by[3]) == [False, True]
    assert by[1][0].class_id == 1 and by[2][0].class_id == 2
    assert bag_minhash.drop_near_duplicates(docs).count() == len(ROWS) - 2 and bag_minhash.drop_near_duplicates(docs).columns == docs.columns


def test_secret_scan(docs, empty):
    got = secret_scan.digest(secret_scan.secret_scan(docs)).collect()
    assert len(got) == len(ROWS) and [(r.n_assign, r.spans) for r in got if r.doc_id == 6] == [(1, "assign:0:24")]
    assert secret_scan.secret_scan(empty).count() == 0


def test_stages_take_odd_and_empty_tables(spark, tmp_path, docs):
    labels = spark.createDataFrame([(3, 1), (4, 1)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (ROWS, []):
        held = spark.createDataFrame(rows, BASE).withColumn("n_chars", F.length("text").cast("long"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, held, str(tmp_path))
            assert out.columns == held.columns
            held = spark.createDataFrame(out.collect(), out.schema)
        corpus_pipeline.pack(spark, held, str(tmp_path)).count()

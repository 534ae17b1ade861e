"""Standalone random tokens are found in a corpus whose base spans are mostly hex and digits."""

import random
import string

import pytest

from weftline.llm import secret_scan

LETTERS = {
    "base64": string.ascii_letters + string.digits + "+/",
    "alphanumeric": string.ascii_letters + string.digits,
    "lower": string.ascii_lowercase + string.digits,
}


def planted(spark, sf, letters, n):
    """Documents of sf with n standalone tokens of 16 to 40 characters: recall, and markov spans elsewhere."""
    rng = random.Random(11)
    token = lambda: "".join(rng.choice(LETTERS[letters]) for _ in range(rng.randint(16, 40)))
    rows = [(-1 - i, f"plain {token()} here") for i in range(n)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = secret_scan.secret_scan(docs.unionByName(spark.createDataFrame(rows, docs.schema))).select("doc_id", "spans").collect()
    texts = dict(rows)
    markov = lambda r: [(s.start, s.end) for s in r.spans if s.kind == "markov"]
    hits = sum(markov(r) == [(6, len(texts[r.doc_id]) - 5)] for r in got if r.doc_id < 0)
    return hits / n, sum(len(markov(r)) for r in got if r.doc_id >= 0)


@pytest.mark.parametrize("letters", LETTERS)
@pytest.mark.parametrize("n", [50, 500])
def test_recall_of_standalone_tokens(spark, letters, n):
    """98 identifiers are few to learn from: on sf0.1, with 1,111, the recall is 1.0."""
    recall, elsewhere = planted(spark, "/root/testdata/sf0.01", letters, n)
    assert recall >= 0.9 and elsewhere == 0

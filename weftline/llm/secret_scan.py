"""Secret scan: fixed patterns, and character Markov models of random strings and identifiers.

The fixed patterns give the base spans (assign, access, hex). Beyond them, each token of at
least min_token characters of the token alphabet is scored by the log-likelihood ratio of two
first-order Markov models of its characters, one of random strings and one of ordinary
identifiers; a token that no base span touches and whose ratio is at least min_ratio, and
min_rate for each character, is a span of kind markov.

The models are trained from labelled samples: every distinct token of the corpus that lies within
a base span is a sample of random strings, every one that no base span touches a sample of
ordinary identifiers. Base spans may be mostly digits or hex, so random strings have a model for
each character class (CLASSES), half the uniform distribution of the class and half what the
samples of that class show, and a token is scored by its own class. Unlabelled secrets are among
the samples of identifiers: those that the models find likelier random are taken out and the
identifiers counted again, until nothing changes or for `rounds` rounds. Character pairs are counted
over all documents; only the counts, at most 6 * 39 * 39 numbers, go to the driver. A pair's
probability among identifiers is smoothed by that of its second character, and this by one, so a
class without samples is uniform. A token that is scored is itself a sample of identifiers, so
each of its pairs is taken out of them once: a random string that stands alone does not vouch
for itself.

All of it is DataFrame functions. Spans are code points from the start of the text, end
exclusive. A text in which a cheap test finds any pattern is cut into pieces of about `piece`
characters, at characters that no match can hold: those outside the alphabets of the patterns, and
single spaces that are next to no other space, colon or equals sign. Matches are found, and tokens
told from base spans, piece by piece, so the work is in proportion to the text; only a run
without any such character makes a longer piece.

Defined results: a null text counts as empty (no spans); repeated rows are scanned each; a null
id is carried; a very long text is scanned whole, in pieces; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.runtime import let, materialize

#: The base patterns by kind, in order; assign keeps matches whose group 2 has 12 characters.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The longest runs of at least 18 and 16 characters: shorter runs can't hide or start one.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
#: The models don't tell upper from lower case: words of headings are ordinary.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Character classes of random strings, the first that holds a token is its own: pattern, and the share of each character without case.
CLASSES = (
    (r"[0-9]+", dict.fromkeys("0123456789", 1 / 10)),
    (r"[0-9a-f]+|[0-9A-F]+", dict.fromkeys("0123456789abcdef", 1 / 16)),
    (r"[0-9a-z]+|[0-9A-Z]+", dict.fromkeys(ALPHABET[:36], 1 / 36)),
    (r"[0-9A-Za-z]+", {c: (2 if c.isalpha() else 1) / 62 for c in ALPHABET[:36]}),
    (r"[0-9A-Za-z+/_-]+", {c: (2 if c.isalpha() else 1) / 66 for c in ALPHABET}),
)
SPAN = "array<struct<start:int,end:int,token:string>>"


def places(text: Column, pattern: str, keep: Column | None = None) -> Column:
    """start, end and token of the leftmost non-overlapping matches.

    A match's start is the length of all that lies before it: pieces between matches and matches.
    """

    def walk(x: Column) -> Column:
        step = lambda a, i: F.struct(
            (a["at"] + F.length(F.get(x["gaps"], i)) + F.length(F.get(x["found"], i))).alias("at"),
            F.array_append(
                a["spans"],
                F.struct(
                    (a["at"] + F.length(F.get(x["gaps"], i))).alias("start"),
                    (a["at"] + F.length(F.get(x["gaps"], i)) + F.length(F.get(x["found"], i))).alias("end"),
                    F.get(x["found"], i).alias("token"),
                ),
            ).alias("spans"),
        )
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
        spans = F.aggregate(F.sequence(F.lit(0), F.size(x["found"]) - 1), zero, step, lambda a: a["spans"])
        return F.when(F.size(x["found"]) > 0, spans).otherwise(none)

    none = F.array().cast(SPAN)
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    test = text.rlike(pattern) if keep is None else keep
    return F.when(test, let(both, walk)).otherwise(none)


def pieces(text: Column, size: int) -> Column:
    """start and text of the pieces of a text, cut where no match can be cut."""
    cut = r"(?:[^A-Za-z0-9+/_.=:\"'\x20-]|(?<=[^\x20:=])\x20(?=[^\x20:=]))"
    parts = F.regexp_extract_all(text, F.lit(rf"(?s).{{{size}}}.*?{cut}|.+"), F.lit(0))

    def placed(x: Column) -> Column:
        # one step for each piece, not for each match
        step = lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.array_append(a["starts"], a["at"]).alias("starts"))
        starts = F.aggregate(x, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), step, lambda a: a["starts"])
        return F.arrays_zip(starts.alias("start"), x.alias("text"))

    return let(parts, placed)


def _scan_piece(text: Column, start: Column, min_token: int) -> Column:
    """base and tokens of a piece."""
    named = lambda kind, spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), s["end"].alias("end")))
    assign = F.filter(places(text, ASSIGN, text.rlike(ASSIGN)), lambda s: F.length(F.regexp_extract(s["token"], r"(?s)\A" + ASSIGN + r"\z", 2)) >= 12)
    base = F.sort_array(F.concat(named("assign", assign), named("access", places(text, ACCESS, F.contains(text, F.lit("AKIA")))), named("hex", places(text, HEX))))
    judged = lambda base, tokens: F.transform(
        tokens,
        lambda t: F.struct(
            (start + t["start"]).alias("start"), (start + t["end"]).alias("end"), t["token"].alias("token"),
            F.exists(base, lambda b: (b["start"] <= t["start"]) & (t["end"] <= b["end"])).alias("inside"),
            F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])).alias("touched"),
        ),
    )
    moved = lambda base: F.transform(base, lambda b: F.struct((start + b["start"]).alias("start"), b["k"].alias("k"), (start + b["end"]).alias("end")))
    both = F.struct(base.alias("base"), places(text, rf"[A-Za-z0-9+/_-]{{{min_token},}}").alias("tokens"))
    return let(both, lambda x: F.struct(moved(x["base"]).alias("base"), judged(x["base"], x["tokens"]).alias("tokens")))


def scan(docs: DataFrame, min_token: int, id_col: str, text_col: str, piece: int) -> DataFrame:
    """doc_id, base spans (start, k, end) and the tokens (start, end, token) with inside and touched."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # every base match holds a token of min_token characters, "AKIA" and 14 more, or an assignment
    any_ = text.rlike(rf"[A-Za-z0-9+/_-]{{{min(min_token, 16)},}}") | text.rlike(ASSIGN)
    empty = F.array().cast("array<struct<base:array<struct<start:int,k:int,end:int>>,tokens:array<struct<start:int,end:int,token:string,inside:boolean,touched:boolean>>>>")
    parts = F.when(any_, F.transform(pieces(text, piece), lambda p: _scan_piece(p["text"], p["start"], min_token))).otherwise(empty)
    found = let(parts, lambda x: F.struct(F.flatten(x["base"]).alias("base"), F.flatten(x["tokens"]).alias("tokens")))
    return docs.select(F.col(id_col).alias("doc_id"), found.alias("x")).select("doc_id", "x.base", "x.tokens")


def characters(token: Column) -> Column:
    """Places in ALPHABET of a token's characters, case folded."""
    return F.transform(F.filter(F.split(F.lower(token), ""), lambda c: c != ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)


def pair_counts(samples: DataFrame) -> DataFrame:
    """label, first, second and n: pairs of neighbouring characters, by place in ALPHABET, in the tokens of each label."""
    coded = samples.filter(F.length("token") > 1).select("label", characters(F.col("token")).alias("c"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.struct(F.get("c", i).alias("first"), F.get("c", i + 1).alias("second")))
    return coded.select("label", F.explode(pairs).alias("p")).groupBy("label", "p.first", "p.second").agg(F.count("*").alias("n"))


def log_ratios(ids: list[float], random: list[list[float]], smoothing: float = 100.0) -> list[float]:
    """Log-likelihood ratio of each pair of characters, random of each class to identifier, with one identifier pair taken out."""
    size = len(ALPHABET)
    first = lambda counts: [sum(counts[a * size : (a + 1) * size]) for a in range(size)]
    left = lambda n: max(n - 1, 0)
    second, rows = [sum(ids[b::size]) for b in range(size)], first(ids)
    single = [(left(n) + 1) / (sum(second) + size) for n in second]
    ordinary = [math.log((left(ids[i]) + smoothing * single[i % size]) / (left(rows[i // size]) + smoothing)) for i in range(size * size)]
    out = []
    for (_, share), counts in zip(CLASSES, random, strict=True):
        rows, even = first(counts), [share.get(c, 0.0) for c in ALPHABET]
        for i in range(size * size):
            u = even[i % size]
            seen = (counts[i] + smoothing * u) / (rows[i // size] + smoothing)
            out.append(math.log((u + seen) / 2) - ordinary[i] if u else 0.0)
    return out


def train(samples: DataFrame, rounds: int = 8) -> list[float]:
    """log_ratios() of samples (token, label), label 1 for random strings and 0 for identifiers, without identifiers that are likelier random."""
    size = len(ALPHABET)

    def counted(labelled: DataFrame) -> list[list[float]]:
        out = [[0.0] * (size * size) for _ in range(1 + len(CLASSES))]
        for r in pair_counts(labelled).collect():  # at most 6 * 39 * 39 rows
            a, b = r["first"], r["second"]
            if a >= 0 and b >= 0:
                out[r["label"]][a * size + b] += r["n"]
        return out

    ids, *random = counted(samples.select("token", F.when(F.col("label") == 1, 1 + char_class(F.col("token"))).otherwise(0).alias("label")))
    ordinary = samples.filter("label = 0")
    for _ in range(rounds):
        model = log_ratios(ids, random)
        left = counted(ordinary.filter(ratio(model, F.col("token")) <= 0))[0]
        if left == ids:
            break
        ids = left
    return log_ratios(ids, random)


def char_class(token: Column) -> Column:
    """Place in CLASSES of a token's class."""
    of = F.lit(len(CLASSES) - 1)
    for k, (pattern, _) in reversed(list(enumerate(CLASSES[:-1]))):
        of = F.when(token.rlike(rf"\A(?:{pattern})\z"), k).otherwise(of)
    return of


def ratio(model: list[float], token: Column) -> Column:
    """Log-likelihood ratio of a token."""
    table = F.from_json(F.lit(json.dumps([round(x, 9) for x in model])), "array<double>")
    size = len(ALPHABET)

    def summed(x: Column) -> Column:
        add = lambda a, i: a + F.get(table, x["start"] + F.get(x["c"], i) * size + F.get(x["c"], i + 1))
        return F.aggregate(F.sequence(F.lit(0), F.size(x["c"]) - 2), F.lit(0.0), add)

    return let(F.struct((char_class(token) * (size * size)).alias("start"), characters(token).alias("c")), summed)


def secret_scan(
    docs: DataFrame, min_token: int = 16, min_ratio: float = 12.0, min_rate: float = 0.75, piece: int = 4096,
    samples: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end by start and kind) of every document.

    samples: labelled samples to train from, token and label (1 random, 0 identifier), instead of the corpus's own.
    """
    found = materialize(scan(docs, min_token, id_col, text_col, piece), "secret-tokens")
    if samples is None:
        tokens = found.select(F.explode("tokens").alias("t")).select("t.*")
        samples = tokens.filter(F.col("inside") | ~F.col("touched")).select("token", F.col("inside").cast("int").alias("label"))
    samples = samples.select("token", "label").filter(F.col("token").rlike(r"\A[A-Za-z0-9+/_-]+\z")).distinct()
    model = train(materialize(samples, "secret-samples"))

    def random(t: Column) -> Column:
        return let(ratio(model, t["token"]), lambda r: (r >= min_ratio) & (r >= min_rate * F.length(t["token"])))

    extra = F.transform(
        F.filter("tokens", lambda t: ~t["touched"] & random(t)),
        lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("markov")).alias("k"), t["end"].alias("end")),
    )
    name = F.array(*[F.lit(k) for k in KINDS])
    out = lambda a: F.transform(a, lambda s: F.struct(F.get(name, s["k"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", out(F.col("base")).alias("base"), out(F.sort_array(F.concat("base", extra))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of secret_scan()'s rows."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))

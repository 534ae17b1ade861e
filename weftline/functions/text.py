"""Column functions on text: counts, splits, folds, hashes and padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokenizers by part of a model's name, in order of preference.
TOKENIZER_FAMILIES = {
    "qwen": "Qwen/Qwen2.5-0.5B",
    "llama": "meta-llama/Llama-3.2-1B",
    "mistral": "mistralai/Mistral-7B-v0.1",
    "gemma": "google/gemma-2b",
    "phi": "microsoft/phi-2",
    "deepseek": "deepseek-ai/DeepSeek-R1-Distill-Qwen-1.5B",
    "codellama": "meta-llama/CodeLlama-7b-hf",
}
#: What tells the languages of code without a fence.
PYTHON_WORDS = r"\b(def |import |class |elif |lambda |yield |async def )"
SQL_WORDS = r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|CREATE TABLE|ALTER TABLE|DROP TABLE)\b"
BASH_WORDS = r"(?m)(#!/|^\$\s|^export |^echo |^if \[|^for \w+ in )"
SENTENCE_GAP = r"(?<=[.!?])\s+"
SENTENCE_OR_LINE_GAP = r"(?<=[.!?\n])\s+"


def let(value: Column, body) -> Column:
    """Evaluate value once and bind it in body; a plain column would be evaluated at each use within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def words(text: Column) -> Column:
    """Words between white space of any kind."""
    return F.filter(F.split(text, r"(?U)\s+", -1), lambda x: x != "")


def stream_tokens(text: Column) -> Column:
    """Words and newlines."""
    return F.regexp_extract_all(text, F.lit(r"(\S+|\n)"), F.lit(1))


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_GAP, -1)


def leading_sentences(text: Column, budget: Column, gap: str = SENTENCE_GAP) -> Column:
    """The sentences from the start whose token counts fit, up to the first that doesn't, joined by a space."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("done"))

    def step(a: Column, s: Column) -> Column:
        fits = ~a["done"] & (a["used"] + token_estimate(s) <= budget)
        return F.struct(
            F.when(fits, F.array_append(a["kept"], s)).otherwise(a["kept"]).alias("kept"),
            F.when(fits, a["used"] + token_estimate(s)).otherwise(a["used"]).alias("used"),
            (~fits).alias("done"),
        )

    return F.array_join(F.aggregate(F.split(text, gap, -1), start, step, lambda a: a["kept"]), " ")


def compress_text(text: Column, budget: Column, marker: str = "... [truncated]") -> Column:
    """Leading sentences or lines that fit, else the first characters, and a marker; short texts stay."""
    kept = leading_sentences(text, budget, SENTENCE_OR_LINE_GAP)
    cut = F.when(kept == "", F.substr(text, F.lit(1), budget * 4)).otherwise(kept)
    return F.when(token_estimate(text) <= budget, text).otherwise(F.concat(cut, F.lit("\n" + marker)))


def compact(text: Column, limit: int, tail: str) -> Column:
    """Texts over the limit are cut by the length of the tail, which is added."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - len(tail))), F.lit(tail))).otherwise(text)


def block_padded(text: Column, block: int) -> Column:
    """One character is one token: spaces up to a whole number of blocks, at least one."""
    n = F.greatest(F.lit(block), F.ceil(F.length(text) / block).cast("int") * block)
    return F.rpad(text, n, F.lit(" "))


def prefix_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def tokenizer_family(model: Column) -> Column:
    """The first family whose name is part of the model's, else char-estimate."""
    out = F.lit("char-estimate")
    for part, name in reversed(TOKENIZER_FAMILIES.items()):
        out = F.when(F.contains(F.lower(model), F.lit(part)), F.lit(name)).otherwise(out)
    return out


def html_text(html: Column) -> Column:
    """Text of a page: tags become spaces, white space is collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def session_key(*parts: Column) -> Column:
    return F.concat(F.lit("s-"), F.substring(F.md5(F.concat(*parts)), 1, 12))


def node_id(turn: Column, kind: Column, name: Column, content: Column) -> Column:
    """turn:kind:name, with a hash of the content where there is no name."""
    return F.concat_ws(":", turn.cast("string"), kind, F.coalesce(name, F.substring(F.md5(content), 1, 8)))


def role_actor(role: Column) -> Column:
    """Who speaks in a role; agents by default."""
    return F.when(role == "user", "user").when(role == "tool", "tool").when(role == "system", "system").otherwise("agent")


def detect_language(text: Column) -> Column:
    """python, sql, bash or javascript: by the tag of a code fence, else by key words, else null."""
    tag = F.lower(F.regexp_extract(text, r"```(\w+)", 1))
    return (
        F.when(tag.isin("python", "py"), "python")
        .when(tag == "sql", "sql")
        .when(tag.isin("bash", "sh", "shell"), "bash")
        .when(tag.isin("js", "javascript", "ts", "typescript"), "javascript")
        .when(text.rlike(PYTHON_WORDS), "python")
        .when(text.rlike(SQL_WORDS), "sql")
        .when(text.rlike(BASH_WORDS), "bash")
    )

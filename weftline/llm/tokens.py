"""Token ids of a byte-level BPE.

The vocabulary is byte_bpe_50k; its tiktoken form gives the same ids as its tokenizers form with
add_special_tokens=False (tests/llm compares them) at five times the speed. The one added token of
the vocabulary, <|endoftext|>, is the single id 50256 wherever its string stands in a text, as the
tokenizers form has it. Paths are parameters; nothing is copied or trained.

A long text is encoded in pieces, cut before a space between two other characters: there a word of
the split pattern always begins, so the ids are those of the whole text. Only ids are held, 4 bytes
each.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

#: The added token of byte_bpe_50k: its string and id.
SPECIAL = {"<|endoftext|>": 50256}
END_OF_TEXT = 50256
#: Characters of a text that are encoded together.
PIECE = 1 << 18
_CUT = re.compile(r"(?<=\S) (?=\S)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The encoder of a vocabulary file, made once in each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def ids_of(enc, text: str | None, piece: int = PIECE) -> array:
    """The ids of a text; a null text has none."""
    out, at, text = array("I"), 0, text or ""
    while at < len(text):
        cut = _CUT.search(text, at + piece) if len(text) - at > piece else None
        end = cut.start() if cut else len(text)
        out.extend(enc.encode(text[at:end], allowed_special="all"))
        at = end
    return out

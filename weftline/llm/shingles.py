"""Word hashes, word sequences and shingle multisets of many texts at once, with numpy.

Words are runs of characters other than white space; hashes are 64-bit, sums of products modulo
2^64 followed by a mix, the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Texts, and bytes of text, that are hashed together; one longer text is hashed in pieces of this size.
TEXTS = 1024
STEP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _series(n: int, base: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_A, _B, _C = 0x5851F42D4C957F2D, 0xD1342543DE82EF95, 0x2545F4914F6CDD1D


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of words of each text. ends: where each text ends in data."""
    if len(data) == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(ends), dtype=np.int64)
    ink = ~_SPACE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    starts = np.concatenate([[0], ends[:-1]])
    starts = starts[starts < len(data)]
    first[starts] |= ink[starts]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(ends), dtype=np.int64)
    number = np.cumsum(first) - 1
    inside = np.arange(len(data)) - at[np.maximum(number, 0)]
    value = np.where(ink, _BYTE[data], np.uint64(0))
    value[ink] *= _series(int(inside[ink].max()) + 1, _A)[inside[ink]]
    hashes = mix(np.add.reduceat(value, at))
    return hashes, np.diff(np.concatenate([[0], np.searchsorted(at, ends)]))


def _long_text(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text, in pieces cut at white space."""
    out, at = [], 0
    while at < len(data):
        end = min(at + STEP, len(data))
        while end < len(data) and not _SPACE[data[end - 1]]:
            more = np.flatnonzero(_SPACE[data[end : end + STEP]])
            end = end + int(more[0]) + 1 if len(more) else min(end + STEP, len(data))
        piece = data[at:end]
        out.append(word_hashes(piece, np.array([len(piece)]))[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def parts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last number of neighbouring texts, their word hashes, and words of each."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP, side="right")) - 1)
        j = min(j, i + TEXTS)
        piece = data[offsets[i] : offsets[j]]
        if len(piece) > STEP:
            hashes = _long_text(piece)
            yield i, j, hashes, np.array([len(hashes)])
        else:
            yield i, j, *word_hashes(piece, offsets[i + 1 : j + 1] - offsets[i])
        i = j


def sequence_keys(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's sequence of words."""
    ends = np.cumsum(counts)
    place = np.arange(len(hashes)) - np.repeat(ends - counts, counts)
    out = []
    for base in (_B, _C):
        sums = np.zeros(len(counts), dtype=np.uint64)
        if len(hashes):
            value = mix(hashes ^ np.uint64(base)) * _series(int(place.max()) + 1, base)[place]
            some = counts > 0
            sums[some] = np.add.reduceat(value, (ends - counts)[some])
        out.append(mix(sums + counts.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def multisets(hashes: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, shingle and weight of each distinct shingle, by text and shingle.

    A text of fewer words than `width`, but at least one, has one shingle of all its words.
    """
    text = np.repeat(np.arange(len(counts)), counts)
    powers = _series(width, _C)
    if len(hashes) >= width:
        n = len(hashes) - width + 1
        windows = hashes[:n] * powers[0]
        for k in range(1, width):
            windows = windows + hashes[k : k + n] * powers[k]
        whole = text[:n] == text[width - 1 :]
        owner, windows = text[:n][whole], mix(windows[whole])
    else:
        owner, windows = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.cumsum(counts) - counts
        each = [mix(np.array([(hashes[first[t] : first[t] + counts[t]] * powers[: counts[t]]).sum() + np.uint64(counts[t])], dtype=np.uint64))[0] for t in short]
        owner, windows = np.concatenate([owner, short]), np.concatenate([windows, np.array(each, dtype=np.uint64)])
    order = np.lexsort((windows, owner))
    owner, windows = owner[order], windows[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (windows[1:] != windows[:-1])
    at = np.flatnonzero(new)
    return owner[at], windows[at], np.diff(np.append(at, len(owner)))

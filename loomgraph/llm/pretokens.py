"""Splits whole batches of text into the pre-tokens of a byte-level BPE, as Arrow arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Bytes of text that are split at once; a longer text stands alone.
SLICE = 8 << 20
#: Distinct pre-tokens that a Python worker remembers, in two generations of half as many; results don't depend on it.
REMEMBERED = 300_000


@cache
def classes() -> np.ndarray:
    """The class of each code point, as the tokenizers' \\p{L}, \\p{N} and \\s have it: their Unicode tables aren't Python's.

    An encoding whose only pattern is the class, and whose only ids are the bytes, gives back what is of that class.
    """
    out = np.zeros(0x110000, np.uint8)
    points = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = bytes(tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(points))
        out[np.frombuffer(found.decode().encode("utf-32-le"), np.uint32)] = kind
    return out


def _starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin; first marks the first code points of the texts.

    Runs of a class are tokens; a single blank before a run joins it; of a longer run of white space
    the last character stands alone or joins; an apostrophe with s, t, m, d, re, ve or ll is a token
    if no blank and no other sign precede it.
    """
    kind = classes()[points]
    before = np.r_[np.uint8(9), kind[:-1]]
    before[first] = 9
    space, gap = kind == SPACE, before == SPACE
    blank = points == 32
    joined = np.r_[False, blank[:-1]] & ~first
    end = np.r_[~space[1:] & ~first[1:], False]  # the next character is of the same text and no space
    starts = first | (~space & (kind != before) & ~joined) | (space & (~gap | end))
    for i in np.flatnonzero((points == 39) & starts):
        tail = points[i + 1 : i + 3].tolist()
        room = 0 if i + 1 >= len(points) or first[i + 1] else 1 if i + 2 >= len(points) or first[i + 2] else 2
        size = 1 if room and chr(tail[0]) in "stmd" else 2 if room == 2 and "".join(map(chr, tail)) in ("re", "ve", "ll") else 0
        if size:
            starts[i + 1 : i + 1 + size] = False
            if i + 1 + size < len(points):
                starts[i + 1 + size] = True
    return starts


def _split(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    blob = b"".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not blob:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    points = np.frombuffer(blob.decode().encode("utf-32-le"), np.uint32)
    ends = np.cumsum(sizes)
    where = np.flatnonzero((np.frombuffer(blob, np.uint8) & 0xC0) != 0x80) if len(points) < len(blob) else None
    begin = (ends - sizes)[sizes > 0]
    first = np.zeros(len(points), bool)
    first[begin if where is None else np.searchsorted(where, begin)] = True
    at = np.flatnonzero(_starts(points, first))
    at = at if where is None else where[at]
    tokens = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.r_[at, len(blob)].astype(np.int32)), pa.py_buffer(blob))
    upto = np.searchsorted(at, np.r_[0, ends])
    return tokens, np.diff(upto)


def pretokens(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, int, pa.DictionaryArray, np.ndarray]]:
    """For slices [i, j) of texts (null: empty), of most bytes (else SLICE) unless a text is longer: their pre-tokens, dictionary-encoded, and each text's count."""
    part, size, i = [], 0, 0
    for j, t in enumerate(texts):
        raw = (t.as_py() or "").encode()
        if part and size + len(raw) > (most or SLICE):
            tokens, counts = _split(part)
            yield i, j, tokens.dictionary_encode(), counts
            part, size, i = [], 0, j
        part.append(raw)
        size += len(raw)
    if part:
        tokens, counts = _split(part)
        yield i, i + len(part), tokens.dictionary_encode(), counts


class Memory:
    """What is known of each pre-token. learn gets the new pre-tokens of a slice at once; each has the result it has alone.

    What is asked for goes to the young generation. When that is full it becomes the old one, and what the old one
    held and nobody asked for since is forgotten; so frequent pre-tokens are learned once.
    """

    def __init__(self, learn: Callable[[list[str]], list]):
        self.learn, self.known, self.old = learn, {}, {}

    def of(self, words: list[str]) -> list:
        if len(self.known) > REMEMBERED // 2:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        new = []
        for w in words:
            if w not in known:
                if w in old:
                    known[w] = old[w]
                else:
                    new.append(w)
        if new:
            known.update(zip(new, self.learn(new)))
        return [known[w] for w in words]


def gathered(ids: list[bytes], index: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after the other, and where each text begins and the last ends."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat, begin = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
    size = sizes[index]
    upto = np.r_[0, np.cumsum(size)]
    out = flat[np.repeat(begin[index] - upto[:-1], size) + np.arange(upto[-1])]
    return out, upto[np.r_[0, np.cumsum(counts)]]

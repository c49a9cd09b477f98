"""Vectorised words: spans, 64-bit hashes and shingles of a whole Arrow batch of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Odd multiplier of the polynomial hash; odd numbers have an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Words by white space only, and words of letters and digits (all bytes from 128 count as letters).
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes hashed at a time; longer runs of texts are cut between texts.
PIECE = 4 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for key, base in (("p", BASE), ("i", INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def lower(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capitals of ASCII and of the Latin-1 letters made small (no byte moves)."""
    out = LOWER[data]
    lead = np.flatnonzero(out[:-1] == 0xC3) + 1
    second = out[lead]
    out[lead[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]] += 0x20
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting, in 32 bits where they fit)."""
    if not len(x):
        return x
    s = np.sort(x.astype(np.uint32) if x.max() < 1 << 32 else x)
    return s[np.concatenate(([True], s[1:] != s[:-1]))].astype(x.dtype)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a null-free string array; text i is bytes[offsets[i]:offsets[i+1]]."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32, count=texts.offset + len(texts) + 1)
    offsets = offsets[texts.offset:].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(texts: pa.Array, size: int = PIECE):
    """(first text, bytes, offsets) of runs of whole texts of about ``size`` bytes."""
    data, offsets = bytes_of(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every word; words never cross from one text into the next."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = table[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    before[firsts] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    lasts = offsets[1:]
    after[lasts[lasts > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span: one prefix sum of byte * BASE**position serves all spans."""
    if len(data) > PIECE and len(start):  # a very long text: runs of its words at a time
        out, at = np.empty(len(start), np.uint64), 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(end, start[at] + PIECE, side="right")))
            lo, hi = start[at], end[to - 1]
            if hi - lo == len(data):
                break
            out[at:to] = span_hash(data[lo:hi], start[at:to] - lo, end[at:to] - lo)
            at = to
        else:
            return out
    power, inverse = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * inverse[start])


def shingle_hash(word_hash: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word number) of every n-word shingle that lies within one text."""
    if len(word_hash) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = word_hash[:len(word_hash) - n + 1].copy()
    for i in range(1, n):
        h = h * BASE + word_hash[i:len(word_hash) - n + 1 + i]
    ok = doc[:len(doc) - n + 1] == doc[n - 1:]
    return mix(h[ok]), np.flatnonzero(ok)

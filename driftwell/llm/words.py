"""Words and rolling word hashes of whole text columns, in numpy over Arrow's buffers."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_A, _B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BASE = 0xD1342543DE82EF95
#: Bytes whose prefix sums are held at once, and the length from which a word is hashed by itself.
BLOCK, LONG_WORD = 1 << 20, 4096

#: White space of the word rule: space and tab to carriage return.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= _A
    x ^= x >> U(27)
    x *= _B
    x ^= x >> U(31)
    return x


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, U)
    down = np.full(n, pow(_BASE, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * _ODD)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts without nulls, and the limits of each text in them."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    limits = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[limits[0] : limits[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, limits - limits[0]


def spans(data: np.ndarray, limits: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of ``word`` bytes."""
    inside = word[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cuts = limits[1:-1]
    firsts, lasts = cuts[cuts < len(data)], cuts[cuts > 0] - 1
    opens[firsts] = inside[firsts]
    closes[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(limits, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), U)
    lengths = ends - starts
    short = np.flatnonzero(lengths <= LONG_WORD)
    for i in np.flatnonzero(lengths > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    up, down = _powers(BLOCK + LONG_WORD + 1)
    values = _byte_values()
    s, e = starts[short], ends[short]
    i = 0
    while i < len(short):
        j = int(np.searchsorted(s, s[i] + BLOCK))
        low, high = s[i], e[j - 1]
        sums = np.zeros(high - low + 1, U)
        np.cumsum(values[data[low:high]] * up[: high - low], out=sums[1:])
        a, b = s[i:j] - low, e[i:j] - low
        out[short[i:j]] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U) * _ODD)
        i = j
    return out


def roll(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values, built from windows of doubled length."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, at, size, now = None, 0, 1, h
    while True:
        if k & size:
            part = now[at : at + n]
            out = part if out is None else mix(out * _ODD + part)
            at += size
        if 2 * size > k:
            return out
        now = mix(now[:-size] * _B + now[size:])
        size *= 2


def hashed(texts: pa.Array, lower: bool, word: np.ndarray = SPACE_WORD):
    """(data, limits, starts, ends, text number, word hash) of a string array without nulls."""
    data, limits = buffers(texts)
    if lower:
        data = LOWER[data]
    starts, ends, doc = spans(data, limits, word)
    return data, limits, starts, ends, doc, word_hashes(data, starts, ends)

"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

The merges are compiled into a transducer that reads a piece byte by byte. Its states are the sets of places where a
token may be open, one for each longest end of the input that begins a token; states and arcs are built when a text
first needs them, and there are never more than the vocabulary has beginnings. A state lists the tokens that may end
in it. Which of them does is fixed by the token that ends where it begins: two neighbours are right exactly when
merging their joined bytes gives these two again, and one token at each place is. No later token can begin before
the open bytes of the state, so what all open places have in common is settled and emitted; the lookahead is bounded
by the longest token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.shared import give_back, slices

#: Fixed value: the pattern whose pieces ``cut_places`` finds without the regex engine; others go through it.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces with their ids, and pairs of neighbours, that a task keeps.
MAX_PIECES, MAX_PAIRS = 500_000, 1_000_000
#: Longer pieces go through the transducer one by one.
LOCKSTEP_BYTES = 48
#: Bytes of a piece between two rounds of emitting what is settled.
EMIT_BYTES = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a line per token, base64 and number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Pairs:
    """Whether two tokens may be neighbours, by a number for the pair: an open hash table in arrays."""

    def __init__(self, bits: int = 21):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.fit, self.held = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, bool), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """1: may, 0: may not, -1: not known yet."""
        out = np.full(len(keys), -1, np.int8)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.fit[slot[hit]]
            on = ~hit & (there >= 0)
            left, slot = left[on], (slot[on] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, fit: list[bool]) -> None:
        if self.held + len(keys) > MAX_PAIRS:
            self.keys[:], self.held = -1, 0
        for key, slot, f in zip(keys.tolist(), self._slot(keys).tolist(), fit, strict=True):
            while self.keys[slot] >= 0 and self.keys[slot] != key:
                slot = (slot + 1) & self.mask
            self.held += int(self.keys[slot] < 0)
            self.keys[slot], self.fit[slot] = key, f


class Transducer:
    """Encodes pieces by the ranks; ``encode`` gives the ids of one piece."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack single bytes: {missing[:5]}")
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.lengths = {i: len(t) for t, i in ranks.items()}
        self.begins = {t[:n] for t in ranks for n in range(1, len(t) + 1)}
        self.fits: dict[tuple[int, int], bool] = {}
        # a state: the open bytes, and the tokens that may end here with their lengths, longest first
        self.states: list[tuple[bytes, tuple[tuple[int, int], ...]]] = [(b"", ())]
        self.numbers = {b"": 0}
        self.arcs: list[dict[int, int]] = [{}]
        # the same in arrays, for many pieces at once
        self.pairs = _Pairs()
        self.arc = np.full((1024, 256), -1, np.int32)
        self.ends = np.full((1024, 16), -1, np.int32)
        self.size = np.zeros(max(ranks.values()) + 1, np.int32)
        self.size[list(self.tokens)] = [len(t) for t in self.tokens.values()]

    def _merged(self, data: bytes) -> list[bytes]:
        """Merges of lowest rank first, for the few bytes of two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, before: int, token: int, keep: bool = True) -> bool:
        """Whether ``token`` may stand after ``before``; -1: at the start, where it must be its own merge."""
        known = self.fits.get((before, token))
        if known is None:
            own = self.tokens[token]
            if before < 0:
                known = self._merged(own) == [own]
            else:
                first = self.tokens[before]
                known = self._merged(first + own) == [first, own]
            if len(self.fits) >= MAX_PAIRS:
                self.fits.clear()
            if keep:
                self.fits[before, token] = known
        return known

    def _step(self, state: int, byte: int) -> int:
        """The arc of ``state`` for ``byte``, built when it is first needed."""
        full = self.states[state][0] + bytes([byte])
        data = full
        while data not in self.begins:
            data = data[1:]
        number = self.numbers.get(data)
        if number is None:
            ends = tuple((self.ranks[data[i:]], len(data) - i) for i in range(len(data)) if data[i:] in self.ranks)
            number = self.numbers[data] = len(self.states)
            self.states.append((data, ends))
            self.arcs.append({})
            if number >= len(self.arc):
                self.arc = np.concatenate((self.arc, np.full_like(self.arc, -1)))
                self.ends = np.concatenate((self.ends, np.full_like(self.ends, -1)))
            if len(ends) > self.ends.shape[1]:
                self.ends = np.concatenate((self.ends, np.full((len(self.ends), len(ends)), -1, np.int32)), axis=1)
            self.ends[number, : len(ends)] = [t for t, _ in ends]
        self.arcs[state][byte] = number
        self.arc[state, byte] = number
        return number

    def encode_many(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of short pieces; all go through the transducer byte by byte together."""
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        lengths = np.array([len(pieces[i]) for i in order], np.int64)
        width = int(lengths[0]) if len(order) else 0
        data = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in order), np.uint8).reshape(len(order), width)
        state = np.zeros(len(order), np.int32)
        last = np.full((len(order), width + 1), -1, np.int32)
        for n in range(1, width + 1):
            m = int(np.searchsorted(-lengths, -n, side="right"))
            byte = data[:m, n - 1]
            new = self.arc[state[:m], byte]
            lost = new < 0
            if lost.any():
                for s, b in np.unique(np.stack((state[:m][lost], byte[lost])), axis=1).T.tolist():
                    self._step(s, b)
                new = self.arc[state[:m], byte]
            state[:m] = new
            todo = np.arange(m)
            for j in range(self.ends.shape[1]):
                token = self.ends[new[todo], j]
                if (token < 0).any():
                    raise ValueError("no token ends here; the ranks are not those of merges")
                fit = self._fit(last[todo, n - self.size[token]], token)
                last[todo[fit], n] = token[fit]
                todo = todo[~fit]
                if not len(todo):
                    break
        out: list[list[int]] = [[] for _ in order]
        at, row = lengths.copy(), np.arange(len(order))
        steps = []
        while len(row):
            token = last[row, at[row]]
            steps.append((row, token))
            at[row] -= self.size[token]
            row = row[at[row] > 0]
        for rows, tokens in reversed(steps):
            for i, t in zip(rows.tolist(), tokens.tolist(), strict=True):
                out[i].append(t)
        back: list[list[int]] = [[]] * len(order)
        for i, ids in zip(order, out, strict=True):
            back[i] = ids
        return back

    def _fit(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        keys = (before.astype(np.int64) + 1) * len(self.size) + token
        found = self.pairs.find(keys)
        if (found < 0).any():
            new = np.unique(keys[found < 0])
            self.pairs.add(new, [self._follows(k // len(self.size) - 1, k % len(self.size), False) for k in new.tolist()])
            found = self.pairs.find(keys)
        return found == 1

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        arcs, states, fits, lengths = self.arcs, self.states, self.fits, self.lengths
        state, base, out = 0, 0, []
        last = [-1]  # the token that ends at each place, from place ``base`` on
        for n, byte in enumerate(piece, 1):
            state_now = arcs[state].get(byte)
            state = self._step(state, byte) if state_now is None else state_now
            for token, length in states[state][1]:
                if n - length < base:
                    continue
                before = last[n - length - base]
                fit = fits.get((before, token))
                if fit or (fit is None and self._follows(before, token)):
                    last.append(token)
                    break
            else:
                raise ValueError("no token ends here; the ranks are not those of merges")
            if n - base >= EMIT_BYTES:
                base = self._emit(last, base, n - len(states[state][0]), n, out)
        rest = []
        at = len(piece) - base
        while at > 0:
            rest.append(last[at])
            at -= lengths[last[at]]
        out.extend(reversed(rest))
        return out

    def _emit(self, last: list[int], base: int, first: int, n: int, out: list[int]) -> int:
        """Emit what all places from ``first`` to ``n`` have in common; the new base."""
        ends = None
        for place in range(first, n + 1):
            at, way = place - base, set()
            while at > 0:
                way.add(at)
                at -= self.lengths[last[at]]
            ends = way if ends is None else ends & way
        if not ends:
            return base
        top = max(ends)
        done, at = [], top
        while at > 0:
            done.append(last[at])
            at -= self.lengths[last[at]]
        out.extend(reversed(done))
        del last[:top]
        return base + top


#: Bytes that follow a first byte of UTF-8, by the first byte; other first bytes are no beginning.
def _following(first: int) -> int:
    return 1 if 0xC2 <= first <= 0xDF else 2 if 0xE0 <= first <= 0xEF else 3 if 0xF0 <= first <= 0xF4 else 0


class Utf8Stream:
    """Text of bytes that come in any cuts; the state is the open sequence of at most three bytes.

    Bytes that are no UTF-8 become the replacement character, as in a decode of everything at once.
    """

    def __init__(self) -> None:
        self.open = b""

    def feed(self, data: bytes) -> str:
        data = self.open + data
        tail = 0
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                need = _following(byte)
                # the rest may come if the bytes so far can begin a character
                if need >= back and not data[-back:].decode("utf-8", "ignore") and self._begins(data[-back:]):
                    tail = back
                break
        self.open = data[len(data) - tail :] if tail else b""
        return data[: len(data) - tail].decode("utf-8", "replace")

    @staticmethod
    def _begins(part: bytes) -> bool:
        if len(part) < 2:
            return True
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(part[0], (0x80, 0xBF))
        return low <= part[1] <= high

    def close(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


def _classes() -> np.ndarray:
    """Class of each code point as the pattern sees it: 1 letter, 2 number, 3 space, 0 other."""
    out = np.zeros(0x110000, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    for m in regex.finditer(r"(\p{L}+)|(\p{N}+)|(\s+)", "".join(map(chr, points))):
        out[points[m.start()] : points[m.end() - 1] + 1] = m.lastindex
    out[0xD800:0xE000] = 0
    return out


def cut_places(cps: np.ndarray, limits: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Begins of the pieces of PIECES in texts laid end to end (code points and the limits of the texts).

    Runs of one class are pieces. A single space goes to the run that follows it; the rest of a space run before
    it is a piece; an apostrophe by itself takes the ending after it.
    """
    if not len(cps):
        return np.zeros(0, np.int64)
    kind = classes[cps]
    edge = np.ones(len(cps), bool)
    edge[1:] = kind[1:] != kind[:-1]
    own = limits[:-1][limits[:-1] < len(cps)]
    edge[own] = True
    text_begins = np.zeros(len(cps) + 1, bool)
    text_begins[limits] = True
    begin = edge.copy()
    runs = np.flatnonzero(edge)
    stops = np.append(runs[1:], len(cps))
    space = np.flatnonzero((kind[runs] == 3) & ~text_begins[stops])  # space runs that something follows in their text
    last = stops[space] - 1
    blank = cps[last] == 0x20
    begin[stops[space[blank]]] = False
    begin[last] = True
    held = np.zeros(len(cps), bool)  # begins of runs that took a space
    held[stops[space[blank]]] = True
    quote = runs[(kind[runs] == 0) & (stops - runs == 1) & (cps[runs] == 0x27)]
    quote = quote[~held[quote] & ~text_begins[quote + 1]]
    quote = quote[kind[quote + 1] == 1]
    two = quote + 2
    inside = (two < len(cps)) & ~text_begins[np.minimum(two, len(cps))]
    a = cps[quote + 1]
    b = np.where(inside & (kind[np.minimum(two, len(cps) - 1)] == 1), cps[np.minimum(two, len(cps) - 1)], 0)
    one = np.isin(a, [ord(c) for c in "stmd"])
    pair = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    begin[quote[one | pair] + 1] = False
    for size, which in ((1, one), (2, pair)):
        after = quote[which] + 1 + size
        begin[after[after < len(cps)]] = True
    return np.flatnonzero(begin)


class Codec:
    """Texts to ids and back; keeps the ids of pieces it has met as text, up to MAX_PIECES."""

    def __init__(self, path: str, pattern: str):
        self.machine = Transducer(read_ranks(path))
        self.split = regex.compile(pattern).findall
        self.classes = _classes() if pattern == PIECES else None
        self.pieces: dict[str, bytes] = {}
        tokens = self.machine.tokens
        self.data = np.frombuffer(b"".join(tokens[i] for i in sorted(tokens)), np.uint8)
        self.length = np.zeros(max(tokens) + 1, np.int64)
        self.length[list(tokens)] = [len(t) for t in tokens.values()]
        self.place = np.cumsum(self.length) - self.length

    def _learn(self, pieces: set[str]) -> None:
        """Encode pieces that are not known yet."""
        if len(self.pieces) + len(pieces) > MAX_PIECES:
            self.pieces.clear()
        raw = {p: p.encode() for p in pieces}
        whole = {p: self.machine.ranks[b] for p, b in raw.items() if b in self.machine.ranks}
        self.pieces |= {p: b"%d" % i for p, i in whole.items()}
        short = [p for p, b in raw.items() if p not in whole and len(b) <= LOCKSTEP_BYTES]
        for p, ids in zip(short, self.machine.encode_many([raw[p] for p in short]), strict=True):
            self.pieces[p] = b" ".join([b"%d" % i for i in ids])
        for p, b in raw.items():
            if p not in whole and len(b) > LOCKSTEP_BYTES:
                self.pieces[p] = b" ".join([b"%d" % i for i in self.machine.encode(b)])

    def _split_all(self, texts: list[str]) -> Iterator[list[str]]:
        """The pieces of each text."""
        if self.classes is None:
            yield from map(self.split, texts)
            return
        limits = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        whole = "".join(texts)
        cps = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        begins = cut_places(cps, limits, self.classes)
        at = np.searchsorted(begins, limits)
        begins, at = [*begins.tolist(), len(whole)], at.tolist()
        for i in range(len(texts)):
            yield [whole[a:b] for a, b in zip(begins[at[i] : at[i + 1]], begins[at[i] + 1 : at[i + 1] + 1], strict=True)]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Decimal ids joined by one space, of each text."""
        cut = list(self._split_all(texts))
        found = [list(map(self.pieces.get, pieces)) for pieces in cut]
        new = {p for pieces, ids in zip(cut, found, strict=True) if None in ids for p, i in zip(pieces, ids, strict=True) if i is None}
        if new:
            self._learn(new)
        for pieces, ids in zip(cut, found, strict=True):
            yield b" ".join([self.pieces[p] if i is None else i for p, i in zip(pieces, ids, strict=True)] if None in ids else ids)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of all ids."""
        which = np.fromstring(ids, np.int32, sep=" ")
        length = self.length[which]
        begin = np.cumsum(length) - length
        return self.data[np.arange(length.sum()) + np.repeat(self.place[which] - begin, length)].tobytes()

    def text(self, ids: bytes, step: int = 1 << 16) -> str:
        """The text of the ids, decoded as a stream."""
        stream, data = Utf8Stream(), self.decode(ids)
        return "".join([stream.feed(data[i : i + step]) for i in range(0, len(data), step)]) + stream.close()


_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker: the automaton is grown once, not for each task."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _coded(path: str, pattern: str, ids_too: bool):
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids_too
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * ids_too

    def run(batches: Iterator[pa.RecordBatch]):
        codec = _codec(path, pattern)
        for batch in slices(batches, "text"):
            rows = []
            for ids in codec.encode_all(batch.column(1).to_pylist()):
                row = (
                    ids.count(b" ") + 1 if ids else 0,
                    hashlib.sha256(ids).hexdigest(),
                    hashlib.sha256(codec.decode(ids)).hexdigest(),
                )
                rows.append((*row, list(map(int, ids.split()))) if ids_too else row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[1:], strict=True)]], names=names
            )
        codec.pieces.clear()  # the worker may live on through other stages
        give_back()

    return run


def encoded(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, ids]) of each row.

    Whole texts are cut by ``pattern`` and each piece is encoded by the ranks in the file ``path`` (a path that
    every executor has); then the ids are decoded. Null text counts as empty: no tokens and the hash of nothing.
    Rows are independent: null or repeated keys stay as they are.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return rows.mapInArrow(_coded(path, pattern, ids), kind).withColumnRenamed("doc_id", key)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )

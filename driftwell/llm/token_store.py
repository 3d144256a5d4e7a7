"""Token ids in binary shards behind a minimal perfect hash index.

Shards hold raw ids in ascending key order; tasks write them to the shared folder under names of their own and
return one row per run of a key, so files of lost or repeated attempts are in no table and are never read.

    shard    "DWID" | version u32 | bytes per id u32 | 0 u32 | ids | (key i64, end u64) per document | footer
    footer   documents u64 | documents with a key u64 | ids u64 | "DWID-END"
    segment  "DWPH" | keys u32 | levels u32 | words u32 | words of each level u32 | ranks u32 | bits u64 | slots

Keys are dealt to segments of about SEGMENT_KEYS by a hash; a task builds the hash function of a segment level by
level: keys that meet no other key in a level's bit array set their bit, the rest go on to the next level. The rank
of a key's bit is its slot, without gaps. A slot has the key's fingerprint (a bijection of the 64-bit key, so a key
that is not there is never found) and where its documents are: shard, place and offset. A lookup reads one bit
array and one slot, whatever the number of keys. All numbers are little-endian.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell.llm.shared import SENT_IDS, groups_of, partitions, slices
from driftwell.llm.words import mix
from driftwell.session import cut_lineage, ensure_checkpoint_dir

U = np.uint64
_STEP, _MARK = U(0x9E3779B97F4A7C15), U(0xA0761D6478BD642F)
HEAD, FOOT = 16, 32
#: Bytes of ids after which a task begins a new shard.
SHARD_BYTES = 32 << 20
#: Keys of a segment on average, bits of a level for each key that is left, and the levels a build may take.
SEGMENT_KEYS, BITS, LEVELS = 4096, 2, 64
#: Words sent to the tokenizer in one text; longer words go alone.
TOGETHER, LONG_CHARS = 512, 256
#: Short words whose ids a Python worker keeps from one slice to the next.
KEPT_WORDS, KEPT_CHARS = 1 << 18, 32
#: Ids read at once.
READ_BYTES = 8 << 20
SLOT = np.dtype([("mark", "<u8"), ("shard", "<i8"), ("last", "<i8"), ("doc", "<u8"), ("docs", "<u8"), ("at", "<u8"), ("ids", "<u8")])
ROW = np.dtype([("key", "<i8"), ("end", "<u8")])
RUN = "shard long, file string, key long, doc long, docs long, at long, ids long"
PLACE = "key long, shard long, last long, doc long, docs long"


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _word_ids(path: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each word laid end to end, and how many each word has.

    Words hold no ASCII white space. Many go to the tokenizer as one text, a space between two; offsets tell
    which word an id belongs to. No piece, accent or special string of the tokenizer reaches over a space.
    """
    tokenizer = _tokenizer(path)
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    groups, first = [], 0
    for i in np.flatnonzero(lengths > LONG_CHARS).tolist():
        groups += [(a, min(a + TOGETHER, i)) for a in range(first, i, TOGETHER)] + [(i, i + 1)]
        first = i + 1
    groups += [(a, min(a + TOGETHER, len(words))) for a in range(first, len(words), TOGETHER)]
    text = words.to_pylist()
    ids, counts = [np.zeros(0, np.uint32)], np.zeros(len(words), np.int64)
    for held in range(0, len(groups), 64):
        some = groups[held : held + 64]
        for (a, b), e in zip(some, tokenizer.encode_batch([" ".join(text[a:b]) for a, b in some], add_special_tokens=False), strict=True):
            ids.append(np.array(e.ids, np.uint32))
            if b == a + 1:
                counts[a] = len(e.ids)
            elif e.ids:
                starts = np.append(0, np.cumsum(lengths[a : b - 1] + 1))
                of = np.searchsorted(starts, np.array(e.offsets, np.int64)[:, 0], side="right") - 1
                counts[a:b] = np.bincount(of, minlength=b - a)
    return np.concatenate(ids), counts


class _Kept:
    """Ids of the first KEPT_WORDS different short words that this worker has met."""

    def __init__(self):
        self.words, self.ids = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.starts = self.counts = np.zeros(0, np.int64)

    def of(self, path: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start of each word's ids in them, their number) of different words."""
        at = pc.index_in(words, self.words)
        new = words.filter(pc.is_null(at))
        ids, counts = _word_ids(path, new)
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = len(self.words) + np.arange(len(new))
        starts = np.append(self.starts, len(self.ids) + np.append(0, np.cumsum(counts))[:-1])
        every, counts = np.append(self.ids, ids), np.append(self.counts, counts)
        found = every, starts[at], counts[at]
        short = np.flatnonzero(pc.utf8_length(new).to_numpy(zero_copy_only=False) <= KEPT_CHARS)[: KEPT_WORDS - len(self.words)]
        if len(short):
            kept = np.append(np.arange(len(self.words)), len(self.words) + short)
            self.words = pa.concat_arrays([self.words, new.take(pa.array(short))])
            self.counts, starts = counts[kept], starts[kept]
            self.starts = np.append(0, np.cumsum(self.counts))[:-1]
            self.ids = every[np.repeat(starts - self.starts, self.counts) + np.arange(self.counts.sum())]
        return found


@cache
def _kept(path: str) -> _Kept:
    return _Kept()


def encode(path: str, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts (no nulls) end to end, each text closed by ``end_id``, and the number of ids of each.

    Each different word of the texts is encoded once.
    """
    words = pc.ascii_split_whitespace(texts)
    per_text = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    met = words.flatten().dictionary_encode()
    known, starts, known_counts = _kept(path).of(path, met.dictionary)
    which = met.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # a closing id follows the words of each text: one more word with one id
    close = np.cumsum(per_text)
    which = np.insert(which, close, len(starts))
    known, starts, known_counts = np.append(known, np.uint32(end_id)), np.append(starts, len(known)), np.append(known_counts, 1)
    counts = known_counts[which]
    ends = np.cumsum(counts)
    flat = known[np.repeat(starts[which] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
    closes = close + np.arange(len(per_text))
    return flat, np.diff(np.append(0, ends[closes]))


def _batch(columns: dict, kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[n], k) for n, k in kinds.items()], names=list(kinds))


_RUN = dict(shard=pa.int64(), file=pa.string(), key=pa.int64(), doc=pa.int64(), docs=pa.int64(), at=pa.int64(), ids=pa.int64())


class _Shard:
    def __init__(self, fs, base: str, width: int):
        self.name, self.kind = f"{uuid.uuid4().hex}.ids", f"<u{width}"
        self.out = fs.open_output_stream(f"{base}/{self.name}", compression=None)
        self.out.write(b"DWID" + np.array([1, width, 0], "<u4").tobytes())
        self.rows, self.docs, self.keyed, self.ids = [], 0, 0, 0

    def add(self, keys: np.ndarray, good: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.out.write(ids.astype(self.kind).tobytes())
        rows = np.zeros(len(keys), ROW)
        rows["key"], rows["end"] = keys, self.ids + np.cumsum(counts)
        self.rows.append(rows.tobytes())
        self.docs, self.keyed, self.ids = self.docs + len(keys), self.keyed + int(good.sum()), self.ids + len(ids)

    def close(self) -> None:
        for r in self.rows:
            self.out.write(r)
        self.out.write(np.array([self.docs, self.keyed, self.ids], "<u8").tobytes() + b"DWID-END")
        self.out.close()


def _written(folder: str, path: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]):
        fs, base = pafs.FileSystem.from_uri(folder)
        shard, made = None, 0
        try:
            for batch in slices(batches, "text"):
                key = batch.column("key")
                good = key.is_valid().to_numpy(zero_copy_only=False)
                keys = pc.fill_null(key, 0).to_numpy()
                ids, counts = encode(path, batch.column("text"), end_id)
                if shard is None:
                    shard, number = _Shard(fs, base, width), (batch.column("part")[0].as_py() << 24) + made
                    made += 1
                before, doc = shard.ids, shard.docs
                shard.add(keys, good, ids, counts)
                cut = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (good[1:] != good[:-1]))))
                starts = before + np.append(0, np.cumsum(counts))[:-1]
                yield _batch(
                    dict(
                        shard=np.full(len(cut), number), file=[shard.name] * len(cut), key=pa.array(keys[cut], mask=~good[cut]),
                        doc=doc + cut, docs=np.diff(np.append(cut, len(keys))), at=starts[cut], ids=np.add.reduceat(counts, cut),
                    ),
                    _RUN,
                )
                if shard.ids * width > SHARD_BYTES:
                    shard.close()
                    shard = None
        finally:
            if shard is not None:
                shard.close()

    return run


def _base(keys: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(U) + _STEP)


def _mark(keys: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(U) ^ _MARK)


def _bit(base: np.ndarray, level: int, bits: int) -> np.ndarray:
    step = U(int(_STEP) * (level + 1) & (1 << 64) - 1)
    return (mix(base + step) % U(bits)).astype(np.int64)


def hash_function(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(words of each level, bits of all levels as 64-bit words) of a minimal perfect hash of different keys."""
    left, words, arrays = _base(keys), [], []
    while len(left):
        if len(words) == LEVELS:
            raise ValueError(f"{len(left)} keys still collide after {LEVELS} levels")
        size = -(-BITS * len(left) // 64)
        at = _bit(left, len(words), size * 64)
        alone = np.bincount(at, minlength=size * 64)[at] == 1
        bits = np.zeros(size * 64, np.uint8)
        bits[at[alone]] = 1
        arrays.append(np.packbits(bits, bitorder="little").view("<u8"))
        words.append(size)
        left = left[~alone]
    return words, np.concatenate(arrays) if arrays else np.zeros(0, "<u8")


def _ranks(bits: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(np.bitwise_count(bits)))[:-1].astype("<u4")


def slots_of(keys: np.ndarray, words: list[int], ranks: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 where no level has its bit (a key of the set always has one)."""
    out, base, first = np.full(len(keys), -1, np.int64), _base(keys), 0
    for level, size in enumerate(words):
        open_ = np.flatnonzero(out < 0)
        if not len(open_):
            break
        at = _bit(base[open_], level, size * 64)
        word, bit = first + (at >> 6), (at & 63).astype(U)
        held = bits[word]
        there = (held >> bit) & U(1) == 1
        below = np.bitwise_count(held & ((U(1) << bit) - U(1))).astype(np.int64)
        out[open_[there]] = (ranks[word].astype(np.int64) + below)[there]
        first += size
    return out


def packed_segment(keys: np.ndarray, entries: np.ndarray) -> bytes:
    """A segment file part: the hash function of ``keys`` and their entries in slot order."""
    words, bits = hash_function(keys)
    ranks = _ranks(bits)
    slots = np.zeros(len(keys), SLOT)
    slots[slots_of(keys, words, ranks, bits)] = entries
    head = b"DWPH" + np.array([len(keys), len(words), len(bits), *words], "<u4").tobytes()
    return head + ranks.tobytes() + bits.astype("<u8").tobytes() + slots.tobytes()


def unpacked_segment(data: bytes) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    if data[:4] != b"DWPH":
        raise ValueError("not an index segment")
    n, levels, size = np.frombuffer(data, "<u4", 3, 4).tolist()
    at = 16 + 4 * levels
    words, ranks = np.frombuffer(data, "<u4", levels, 16).tolist(), np.frombuffer(data, "<u4", size, at)
    bits = np.frombuffer(data, "<u8", size, at + 4 * size)
    return words, ranks, bits, np.frombuffer(data, SLOT, n, at + 12 * size)


def _indexed(folder: str):
    """Build the segments that a task has, one file per task."""

    def run(batches: Iterator[pa.RecordBatch]):
        fs, base = pafs.FileSystem.from_uri(folder)
        out, name, at = None, f"{uuid.uuid4().hex}.mph", 0
        try:
            for t in groups_of(batches, "segment"):
                c = {n: t.column(n).to_numpy() for n in ("segment", "key", "shard", "doc", "docs", "at", "ids")}
                order = np.lexsort((c["doc"], c["shard"], c["key"], c["segment"]))
                c = {n: v[order] for n, v in c.items()}
                # runs of one key follow each other over slices and shards: one entry
                cut = np.flatnonzero(np.concatenate(([True], (c["key"][1:] != c["key"][:-1]) | (c["segment"][1:] != c["segment"][:-1]))))
                entries = np.zeros(len(cut), SLOT)
                keys = c["key"][cut]
                entries["mark"] = _mark(keys)
                for n in ("shard", "doc", "at"):
                    entries[n] = c[n][cut]
                entries["last"] = np.maximum.reduceat(c["shard"], cut)
                entries["docs"], entries["ids"] = np.add.reduceat(c["docs"], cut), np.add.reduceat(c["ids"], cut)
                segments = c["segment"][cut]
                part = np.flatnonzero(np.concatenate(([True], segments[1:] != segments[:-1], [True])))
                rows = []
                for a, b in zip(part, part[1:], strict=False):
                    data = packed_segment(keys[a:b], entries[a:b])
                    if out is None:
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(data)
                    rows.append((int(segments[a]), name, at, len(data)))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["segment", "file", "at", "length"])
        finally:
            if out is not None:
                out.close()

    return run


def _found(folder: str, strict: bool):
    def run(batches: Iterator[pa.RecordBatch]):
        fs, base = pafs.FileSystem.from_uri(folder)
        for t in groups_of(batches, "segment"):
            segments, keys = t.column("segment").to_numpy(), t.column("key").to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], segments[1:] != segments[:-1], [True])))
            for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False):
                name, at, length = (t.column(n)[a].as_py() for n in ("file", "at", "length"))
                some = keys[a:b]
                if name is None:
                    there = np.zeros(len(some), bool)
                else:
                    with fs.open_input_file(f"{base}/{name}") as f:
                        words, ranks, bits, slots = unpacked_segment(f.read_at(length, at))
                    slot = slots_of(some, words, ranks, bits)
                    there = slot >= 0
                    there[there] = slots["mark"][slot[there]] == _mark(some[there])
                if strict and not there.all():
                    raise ValueError(f"key {some[~there][0]} is not in the index")
                if there.any():
                    got = slots[slot[there]]
                    yield _batch(dict(key=some[there]) | {n: got[n].astype(np.int64) for n in ("shard", "last", "doc", "docs")}, {n: pa.int64() for n in ("key", "shard", "last", "doc", "docs")})

    return run


def _table(f, size: int) -> tuple[int, np.ndarray, int]:
    """(bytes per id, rows of the documents, documents with a key) of an open shard."""
    foot = f.read_at(FOOT, size - FOOT)
    if foot[-8:] != b"DWID-END":
        raise ValueError("not a shard of token ids")
    docs, keyed, ids = np.frombuffer(foot, "<u8", 3).tolist()
    width = int(np.frombuffer(f.read_at(HEAD, 0), "<u4", 4)[2])
    return width, np.frombuffer(f.read_at(docs * ROW.itemsize, HEAD + ids * width), ROW), keyed


def _read(folder: str, payload: bool):
    kinds = dict(key=pa.int64(), start=pa.int64(), n_tokens=pa.int64(), ids_crc32=pa.int64(), ids=pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]):
        fs, base = pafs.FileSystem.from_uri(folder)
        held, width, rows, keyed = None, 0, None, 0
        f = None
        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if held != r["file"]:
                        if f is not None:
                            f.close()
                        held, f = r["file"], fs.open_input_file(f"{base}/{r['file']}")
                        width, rows, keyed = _table(f, f.size())
                        ends = np.append(0, rows["end"].astype(np.int64))
                        cache_at, cached = 0, b""
                    first, limit = r["doc"] if r["shard"] == r["first"] else 0, keyed
                    if r["key"] is None:
                        limit = len(rows)
                    elif rows["key"][first] != r["key"]:
                        raise ValueError(f"shard {held} has another key than {r['key']} at {first}")
                    else:
                        limit = int(np.searchsorted(rows["key"][:keyed], r["key"], side="right"))
                    out = {n: [] for n in kinds}
                    for i in range(first, limit):
                        low, high = HEAD + int(ends[i]) * width, HEAD + int(ends[i + 1]) * width
                        if low < cache_at or high > cache_at + len(cached):
                            cache_at, cached = low, f.read_at(min(max(high - low, READ_BYTES), HEAD + int(ends[-1]) * width - low), low)
                        ids = np.frombuffer(cached, f"<u{width}", int(ends[i + 1] - ends[i]), low - cache_at)
                        out["key"].append(r["key"])
                        out["start"].append(r["base"] + int(ends[i]))
                        out["n_tokens"].append(len(ids))
                        out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                        out["ids"].append(ids.astype(np.int64) if payload else None)
                        if len(out["key"]) >= 4096 or payload:
                            yield _batch(out, kinds)
                            out = {n: [] for n in kinds}
                    if out["key"]:
                        yield _batch(out, kinds)
        finally:
            if f is not None:
                f.close()

    return run


def _gathered(run):
    """The same rows in larger batches: most keys have one document."""

    def whole(batches):
        some, n = [], 0
        for b in run(batches):
            some.append(b)
            n += b.num_rows
            if n >= 4096 or b.column("ids").null_count < b.num_rows:
                yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
                some, n = [], 0
        if some:
            yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]

    return whole


@dataclass
class TokenStore:
    """Shards and their index. ``shards``: (shard, file, docs, unkeyed, ids, base); ``directory``: (segment, file, at, length)."""

    folder: str
    shards: DataFrame
    directory: DataFrame
    segments: int

    def _near(self, table: DataFrame) -> DataFrame:
        """Sent to all executors where a count shows that it is small."""
        return F.broadcast(table) if table.count() <= SENT_IDS else table.hint("shuffle_merge")

    def lookup(self, keys: DataFrame, key: str = "key", strict: bool = False) -> DataFrame:
        """(key, shard, last, doc, docs): where the documents of each different key are.

        Null keys and keys without a document give no row; with ``strict`` a key that is not there is an error.
        """
        asked = keys.select(F.col(f"`{key}`").cast("long").alias("key")).filter("key IS NOT NULL").distinct()
        asked = asked.withColumn("segment", F.pmod(F.xxhash64("key"), F.lit(self.segments)))
        return (
            asked.join(self._near(self.directory), "segment", "left")
            .repartition(partitions(keys.sparkSession), "segment")
            .sortWithinPartitions("segment")
            .mapInArrow(_found(self.folder, strict), PLACE)
        )

    def unkeyed(self) -> DataFrame:
        """Places of the documents without a key, as ``lookup`` gives them, the key null."""
        return self.shards.filter("unkeyed > 0").selectExpr("cast(NULL AS long) AS key", "shard", "shard AS last", "docs - unkeyed AS doc", "unkeyed AS docs")

    def read(self, places: DataFrame, payload: bool = True) -> DataFrame:
        """(key, start, n_tokens, ids_crc32, ids) of each document of ``places``; ids is null without ``payload``.

        start counts the ids of all documents before it, over all shards. A key with more documents than a shard
        holds is read shard by shard, by different tasks.
        """
        met = places.select("key", "doc", F.col("shard").alias("first"), F.explode(F.sequence("shard", "last")).alias("shard"))
        return (
            met.join(self._near(self.shards.select("shard", "file", "base")), "shard")
            .repartition(partitions(places.sparkSession), "shard")
            .sortWithinPartitions("shard", F.asc_nulls_last("key"))
            .mapInArrow(_gathered(_read(self.folder, payload)), "key long, start long, n_tokens long, ids_crc32 long, ids array<long>")
        )

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of each document of one key, by a fixed number of reads a document; empty if the key is not there."""
        segment = xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), 42)
        segment = (segment - (1 << 64) if segment >> 63 else segment) % self.segments
        at = self.directory.filter(F.col("segment") == segment).first()
        if at is None:
            return []
        fs, base = pafs.FileSystem.from_uri(self.folder)
        with fs.open_input_file(f"{base}/{at['file']}") as f:
            words, ranks, bits, slots = unpacked_segment(f.read_at(at["length"], at["at"]))
        one = np.array([key], np.int64)
        slot = slots_of(one, words, ranks, bits)[0]
        if slot < 0 or slots["mark"][slot] != _mark(one)[0]:
            return []
        found, out = slots[slot], []
        for shard in self.shards.filter(F.col("shard").between(int(found["shard"]), int(found["last"]))).orderBy("shard").collect():
            with fs.open_input_file(f"{base}/{shard['file']}") as f:
                width, rows, keyed = _table(f, f.size())
                first = int(found["doc"]) if shard["shard"] == found["shard"] else 0
                ends = np.append(0, rows["end"].astype(np.int64))
                for i in range(first, int(np.searchsorted(rows["key"][:keyed], key, side="right"))):
                    out.append(np.frombuffer(f.read_at(int(ends[i + 1] - ends[i]) * width, HEAD + int(ends[i]) * width), f"<u{width}").astype(np.int64))
        return out


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> TokenStore:
    """Encode every row of ``docs`` and write shards in ascending order of ``key``, then the index over the keys.

    ``tokenizer`` is the file of a word tokenizer of the tokenizers library that no piece over white space leaves
    (its path must be readable on every executor). Null and empty texts have the closing id alone. Rows without a
    key come last, after all keys; they are in the shards but in no index entry. Rows that share a key lie next to
    each other, ordered by a hash of their text, exactly equal rows by place in the input; the index names the
    first and how many there are, over several shards if need be. An empty table gives no shard.
    """
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
    # a key that many rows share is split by the hash of the text, equal rows by their place
    order = [F.asc_nulls_last("key"), "same", "place"]
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("same"), F.monotonically_increasing_id().alias("place"))
    runs = cut_lineage(
        rows.repartitionByRange(partitions(spark), *order)
        .sortWithinPartitions(*order)
        .select("key", "text", F.spark_partition_id().cast("long").alias("part"))
        .mapInArrow(_written(folder, tokenizer, end_id, width), RUN)
    )
    # one row per shard of SHARD_BYTES: numbers without gaps, and the ids before each
    whole = runs.groupBy(F.col("shard").alias("task"), "file").agg(
        F.sum("docs").alias("docs"), F.expr("coalesce(sum(docs) FILTER (WHERE key IS NULL), 0) AS unkeyed"), F.sum("ids").alias("ids")
    )
    in_order = Window.orderBy("task")
    shards = cut_lineage(
        whole.select(
            "task", "file", "docs", "unkeyed", "ids", (F.row_number().over(in_order) - 1).cast("long").alias("shard"),
            F.coalesce(F.sum("ids").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        )
    )
    store = TokenStore(folder, shards, shards, 1)
    keyed = runs.filter("key IS NOT NULL")
    store.segments = max(1, -(-keyed.count() // SEGMENT_KEYS))
    entries = keyed.withColumnRenamed("shard", "task").drop("file").join(store._near(shards.select("task", "shard")), "task").drop("task")
    store.directory = cut_lineage(
        entries.withColumn("segment", F.pmod(F.xxhash64("key"), F.lit(store.segments)))
        .repartition(partitions(spark), "segment")
        .sortWithinPartitions("segment")
        .mapInArrow(_indexed(folder), "segment long, file string, at long, length long")
    )
    return store


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = write_store(docs, public_tokenizers.path("word_bpe_49k.json"))
    places = store.lookup(docs, "doc_id", strict=True).union(store.unkeyed())
    return store.read(places, payload=False).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")

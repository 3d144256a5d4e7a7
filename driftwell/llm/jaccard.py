"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, exact intersection of sorted arrays.

The join never lists the pairs of a group:

1. Each text's distinct shingles are sent, four bytes each and packed by hash range and slice of texts, to tasks
   that answer for each text how many of its shingles other texts have too; the answers of a slice meet again in
   one task. A text with a partner must share at least the threshold's part of its own set, so most texts leave
   here. Texts with equal set hashes become one class, whose smallest id goes on.
2. Of each class the rarest quarter of the shingles (a total order by counted hash bucket, then hash) is
   enough to meet every partner. Classes that share such a shingle meet in one run, sorted by size; within
   the size band the bit counts of hashed bitmaps bound the overlap from above. A run passes on a spanning
   forest of the pairs that the bound cannot exclude, not the pairs.
3. Each tree of candidates is cut into tiles of neighbouring size bands (large ones into blocks that meet
   two by two); there the sorted arrays are intersected exactly, skipping texts already connected.
4. Components of the exact links, by alternating stars over written tables.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.shared import connected, groups_of, one_row_per_id, partitions, rows_of_ids, slices
from driftwell.llm.words import SPACE_WORD, U, hashed, mix, roll
from driftwell.session import cut_lineage

#: Buckets of the shingle counts that put frequent shingles last; a fixed size, whatever the input.
ORDER_BUCKETS = 1 << 16
#: Texts of a tile before it is split into blocks.
TILE_ROWS = 2048
#: A class with more than this part of all copies is hot; there are fewer of these than the inverse.
HOT_PART = 1 / 1024
_SEEDS = (U(0x51ED270B9F9C1A35), U(0xA24BAED4963EE407))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than k words are one shingle, none are none."""
    _, limits, _, _, doc, h = hashed(texts, lower=True)
    grams = roll(h, k)
    at = np.searchsorted(doc, np.arange(len(limits)))
    for i in range(len(limits) - 1):
        low, high = at[i], at[i + 1]
        if high - low >= k:
            own = np.sort(grams[low : high - k + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own
        elif high > low:
            yield mix(roll(h[low:high], high - low) + U(high - low))
        else:
            yield np.zeros(0, U)


#: Rows between the tasks: a slice of texts (its number and a check of its ids), the hash range, packed arrays.
_REQUEST = "slice long, part int, head boolean, a binary, b binary"


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["slice", "part", "head", "a", "b"]
    )


def _packed(k: int, parts: int):
    """For each slice of texts its head (ids, sizes, set hashes) and, by hash range, shingle fingerprints in order of text."""

    def pack(batches):
        task, number = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text"):
            ids = batch.column(0).to_numpy()
            sets = list(shingle_sets(batch.column(1), k))
            sizes = np.array([len(s) for s in sets], np.int64)
            marks = np.array([[np.bitwise_xor.reduce(mix(s ^ c)) if len(s) else U(0) for c in _SEEDS] for s in sets], U)
            name = int.from_bytes(hashlib.blake2b(ids.tobytes() + b"%d:%d" % (task, number), digest_size=8).digest(), "little", signed=True)
            number += 1
            rows = [(name, name % parts, True, ids.tobytes(), np.hstack((sizes[:, None].view(U), marks)).tobytes())]
            grams = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
            part = (((grams >> U(32)) * U(parts)) >> U(32)).astype(np.uint32)
            order = np.argsort(part, kind="stable")
            part, owner, prints = part[order], owner[order], (grams[order] & U(0xFFFFFFFF)).astype(np.uint32)
            cuts = np.append(np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))), len(part)) if len(part) else []
            for low, high in zip(cuts, cuts[1:], strict=False):
                counts = np.bincount(owner[low:high], minlength=len(sets)).astype(np.uint32)
                rows.append((name, int(part[low]), False, prints[low:high].tobytes(), counts.tobytes()))
            yield _arrow(rows)

    return pack


def _answered(batches):
    """For each slice and hash range how many shingles of each text other texts have too; heads pass."""
    for t in groups_of(batches, "part"):
        part, head = t.column("part").to_numpy(), t.column("head").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        for low, high in zip(cuts, cuts[1:], strict=False):
            here = t.slice(low, high - low)
            names, packed, counted = (here.column(c).to_pylist() for c in ("slice", "a", "b"))
            p = int(part[low])
            rows = [(names[i], p, True, packed[i], counted[i]) for i in np.flatnonzero(head[low:high])]
            asks = np.flatnonzero(~head[low:high])
            if len(asks):
                lengths = [len(packed[i]) // 4 for i in asks]
                prints = np.frombuffer(b"".join(packed[i] for i in asks), np.uint32)
                order = np.argsort(prints)
                ranked = prints[order]
                same = ranked[1:] == ranked[:-1]
                shared = np.zeros(len(prints) + 1, np.int64)
                shared[order[1:][same]] = 1
                shared[order[:-1][same]] = 1
                sums = np.concatenate(([0], np.cumsum(shared)))
                at = 0
                for i, n in zip(asks, lengths, strict=True):
                    counts = np.frombuffer(counted[i], np.uint32).astype(np.int64)
                    stops = at + np.cumsum(counts)
                    found = (sums[stops] - sums[stops - counts]).astype(np.uint32)
                    rows.append((names[i], p, False, found.tobytes(), None))
                    at += n
            yield _arrow(rows)


def _summed(batches):
    """The answers of a slice added up over the hash ranges: a row for each text."""
    for t in groups_of(batches, "slice"):
        heads: dict[int, tuple[bytes, bytes]] = {}
        shared: dict[int, np.ndarray] = {}
        for name, head, a, b in zip(*(t.column(c).to_pylist() for c in ("slice", "head", "a", "b")), strict=True):
            if head:
                heads[name] = (a, b)
            else:
                found = np.frombuffer(a, np.uint32).astype(np.int64)
                shared[name] = shared[name] + found if name in shared else found
        if not set(shared) <= set(heads):
            raise ValueError("the input came in another order when it was read again")
        for name, (a, b) in heads.items():
            ids, rest = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (ids, rest[:, 0].copy(), shared.get(name, np.zeros(len(ids), np.int64)), rest[:, 1].copy(), rest[:, 2].copy())],
                names=["doc_id", "n", "shared", "s1", "s2"],
            )


def _width(n: int) -> int:
    """Bits of the bitmap of a set of n: the next power of two, 64 at least."""
    return max(64, 1 << max(0, int(n - 1).bit_length()))


def _bitmap(grams: np.ndarray) -> np.ndarray:
    width = _width(len(grams))
    flags = np.zeros(width, bool)
    flags[(grams & U(width - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(U)


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """The bitmap of the same set at a smaller width."""
    while bits.shape[-1] * 64 > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


class Forest:
    """Union-find over the rows of one tile."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


class Tile:
    """Rows in order of size with their bitmaps; says which earlier rows the bound cannot exclude."""

    def __init__(self, sizes: np.ndarray, bitmaps: list[bytes], percent: int):
        self.sizes, self.percent = sizes, percent
        self.bits = [np.frombuffer(b, U) for b in bitmaps]
        self.at_width: dict[int, tuple[np.ndarray, int]] = {}
        self.rows: dict[int, np.ndarray] = {}

    def _matrix(self, width: int) -> np.ndarray:
        """All rows folded to ``width`` (rows whose own bitmap is narrower stay empty)."""
        if width not in self.rows:
            out = np.zeros((len(self.bits), width // 64), U)
            for i, b in enumerate(self.bits):
                if width <= len(b) * 64 <= 4 * width:
                    out[i] = _folded(b, width)
            self.rows[width] = out
        return self.rows[width]

    def partners(self, i: int, low: int = 0) -> np.ndarray:
        """Rows before i whose size and bit counts allow a link with i."""
        n, need = int(self.sizes[i]), self.percent
        first = max(low, int(np.searchsorted(self.sizes, -(-n * need // 100))))
        if first >= i:
            return np.zeros(0, np.int64)
        found = []
        own = self.bits[i]
        widths = np.array([_width(int(x)) for x in self.sizes[[first, i - 1]]])
        width = int(widths.min())
        others = self._matrix(width)[first:i]
        mine = _folded(own, width)
        # a bit of one set that the other lacks is at least one shingle outside the overlap
        least = np.minimum(
            n - np.bitwise_count(mine & ~others).sum(axis=1, dtype=np.int64),
            self.sizes[first:i] - np.bitwise_count(others & ~mine).sum(axis=1, dtype=np.int64),
        )
        found = np.flatnonzero(least * (100 + need) >= need * (n + self.sizes[first:i]))
        return found + first


def _sketched(batches):
    """Shingles of each order bucket, added up over a task."""
    total = np.zeros(ORDER_BUCKETS, np.int64)
    for batch in batches:
        for grams in batch.column(0).to_pylist():
            total += np.bincount((np.frombuffer(grams, U) >> U(40)).astype(np.int64) % ORDER_BUCKETS, minlength=ORDER_BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "c"])


def _keyed(load: np.ndarray, percent: int):
    """A row for each of a set's rarest shingles, enough of them to meet any partner."""

    def keys(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            held = 0
            columns = (batch.column(i).to_pylist() for i in range(4))
            for doc, n, bits, grams in zip(*columns, strict=True):
                g = np.frombuffer(grams, U)
                count = n - -(-n * percent // 100) + 1
                weight = load[(g >> U(40)).astype(np.int64) % ORDER_BUCKETS]
                chosen = g[np.lexsort((g, weight))[:count]] if count < n else g
                out[0].append(chosen.view(np.int64))
                out[1].append(np.full(len(chosen), doc))
                out[2].append(np.full(len(chosen), n))
                out[3].append((bits, len(chosen)))
                held += len(chosen) * (len(bits) + 24)
                if held > 8 << 20:
                    yield _key_batch(out)
                    out, held = [[], [], [], []], 0
            if out[0]:
                yield _key_batch(out)

    return keys


def _key_batch(out: list[list]) -> pa.RecordBatch:
    bits = [b for b, times in out[3] for _ in range(times)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(c)) for c in out[:3]] + [pa.array(bits, pa.binary())], names=["key", "doc_id", "n", "bits"]
    )


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges, strict=True) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _candidates(percent: int):
    """A spanning forest of each run's pairs that the bitmaps do not exclude."""

    def run(batches):
        for t in groups_of(batches, "key"):
            key, doc, n = (t.column(c).to_numpy() for c in ("key", "doc_id", "n"))
            change = np.concatenate(([True], key[1:] != key[:-1], [True]))
            cuts = np.flatnonzero(change)
            long = np.flatnonzero(np.diff(cuts) > 1)
            if not len(long):
                continue
            bits = t.column("bits").combine_chunks()
            edges: list[tuple[int, int]] = []
            for r in long:
                low, high = int(cuts[r]), int(cuts[r + 1])
                tile = Tile(n[low:high], bits[low:high].to_pylist() if isinstance(bits, pa.Array) else bits.chunk(0)[low:high].to_pylist(), percent)
                forest = Forest(high - low)
                for i in range(1, high - low):
                    for j in tile.partners(i):
                        if forest.join(int(j), i):
                            edges.append((int(doc[low + j]), int(doc[low + i])))
            if edges:
                yield _edge_batch(sorted(set(edges)))

    return run


def _exact(percent: int):
    """A spanning forest of the exact links within a tile."""

    def links(batches):
        for t in groups_of(batches, "tile"):
            tiles = t.column("tile").to_pylist()
            cuts = [i for i in range(len(tiles)) if not i or tiles[i] != tiles[i - 1]] + [len(tiles)]
            edges: list[tuple[int, int]] = []
            for low, high in zip(cuts, cuts[1:], strict=False):
                part = t.slice(low, high - low)
                doc, n = part.column("doc_id").to_numpy(), part.column("n").to_numpy()
                sets = [np.frombuffer(g, U) for g in part.column("grams").to_pylist()]
                tile, forest = Tile(n, part.column("bits").to_pylist(), percent), Forest(high - low)
                for i in range(1, high - low):
                    for j in tile.partners(i)[::-1]:
                        j = int(j)
                        if forest.root(i) == forest.root(j):
                            continue
                        at = np.searchsorted(sets[i], sets[j])
                        at[at == len(sets[i])] = 0
                        both = int(np.count_nonzero(sets[i][at] == sets[j]))
                        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                            forest.join(i, j)
                            edges.append((int(doc[j]), int(doc[i])))
            if edges:
                yield _edge_batch(edges)

    return links


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id) for each key of ``docs``.

    Words are runs of non-space after A-Z become a-z; a set holds the distinct runs of k words (fewer words:
    the whole sequence as one; none or null text: empty, no links). Sets link when 100 * intersection >=
    percent * union. component_id is the smallest key that links lead to, the own key included. Rows without a
    key give no row; keys that repeat count once, with the greatest text. Other columns are not read.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = one_row_per_id(docs, key, text).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    width = partitions(spark)
    packed = rows.mapInArrow(_packed(k, width), _REQUEST)
    answers = packed.repartition(width, "part").sortWithinPartitions("part").mapInArrow(_answered, _REQUEST)
    sums = cut_lineage(
        answers.repartition(width, "slice")
        .sortWithinPartitions("slice")
        .mapInArrow(_summed, "doc_id long, n long, shared long, s1 long, s2 long")
    )
    likely = sums.filter((F.col("n") > 0) & (F.col("shared") * 100 >= F.col("n") * percent))
    firsts = cut_lineage(
        likely.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    )
    reps = firsts.select(F.col("rep").alias("doc_id"))

    def sets(batches):
        for batch in slices(batches, "text"):
            found = list(shingle_sets(batch.column(1), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.array([_bitmap(s).tobytes() for s in found], pa.binary()),
                    pa.array([s.tobytes() for s in found], pa.binary()),
                ],
                names=["doc_id", "n", "bits", "grams"],
            )

    held = cut_lineage(rows_of_ids(rows, reps, "doc_id").mapInArrow(sets, "doc_id long, n long, bits binary, grams binary"))
    load = np.zeros(ORDER_BUCKETS, np.int64)
    for row in held.select("grams").mapInArrow(_sketched, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).collect():
        load[row["bucket"]] = row["c"]  # ORDER_BUCKETS rows at most
    keys = held.mapInArrow(_keyed(load, percent), "key long, doc_id long, n long, bits binary")
    edges = (
        keys.repartition(width, "key")
        .sortWithinPartitions("key", "n", "doc_id")
        .mapInArrow(_candidates(percent), "a long, b long")
    )
    trees = cut_lineage(connected(edges).select(F.col("node").alias("doc_id"), "root"))
    links = _tiles(held.join(trees, "doc_id"), percent, width)
    comps = connected(links.mapInArrow(_exact(percent), "a long, b long"))
    comps = comps.select(F.col("node").alias("rep"), F.col("root").alias("component"))
    named = firsts.join(comps, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    # every text has a row in sums
    return sums.join(_members(likely, cut_lineage(named)), "doc_id", "left").select(
        F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def _members(likely: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, component) of the texts of all classes; hot classes meet their texts without a shuffle."""
    same = ["s1", "s2", "n"]
    total = classes.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") > total * HOT_PART
    few = F.broadcast(classes.filter(hot).select(*same, F.col("component")))  # fewer than 1 / HOT_PART rows
    rest = classes.filter(~hot).select(*same, "component")
    return (
        likely.join(few, same)
        .select("doc_id", "component")
        .union(likely.join(few, same, "left_anti").join(rest, same).select("doc_id", "component"))
    )


def _tiles(rows: DataFrame, percent: int, width: int) -> DataFrame:
    """Rows dealt to tiles: a size band with the band below it, blocks of large tiles two by two."""
    ratio = math.log(100 / percent)
    rows = rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(ratio) + F.lit(1e-9)))
    sizes = rows.groupBy("root", "band").agg(F.count("*").alias("c"))
    # a tile holds bands b-1 and b; its blocks follow from the larger of both counts
    above = sizes.select("root", (F.col("band") + 1).alias("band"), F.col("c").alias("below"))
    blocks = (
        sizes.join(above, ["root", "band"], "full")
        .select("root", "band", F.ceil(F.greatest(F.coalesce("c", F.lit(0)), F.coalesce("below", F.lit(0))) / TILE_ROWS).cast("int").alias("blocks"))
    )
    placed = rows.withColumn("tile_band", F.explode(F.array("band", F.col("band") + 1)))
    placed = placed.join(blocks.withColumnRenamed("band", "tile_band"), ["root", "tile_band"])
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    name = F.concat_ws(":", "root", "tile_band", F.least("own", "other"), F.greatest("own", "other"))
    return (
        placed.select(name.alias("tile"), "doc_id", "n", "bits", "grams")
        .repartition(width, "tile")
        .sortWithinPartitions("tile", "n", "doc_id")
    )


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g
  FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS r FROM documents
  UNION
  SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.a),
comps AS (SELECT a AS doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN comps USING (doc_id)
"""


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


__all__ = ["SPACE_WORD", "SQL", "jaccard_components", "query"]

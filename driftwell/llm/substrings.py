"""Removal of long repeated spans: De Bruijn compaction of the token graph.

Every window of ``width`` words is an edge of the graph. The windows of a text that share their minimizer (the
least hashed ``anchor``-gram in the window, first of equals) are consecutive: they form a path, and equal paths of
different texts have equal anchors and equal words.

1. Each text sends one row per path: anchor hash, hash of the path's words, place. A twentieth of the windows.
2. Equal paths become one row with the smallest text id (map-side combined, so thousands of copies cost one row
   per task). Where an anchor leads to one path only, the path does not branch and stays compact.
3. Where an anchor leads to several paths, they may still have windows in common. The first source of each is
   opened again at its coordinates into single windows, each with two hashes, and these meet in a join.
4. Spans of texts that are not the first source are cut out of the words at the coordinates.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.shared import one_row_per_id, partitions, rows_of_ids, slices
from driftwell.llm.words import U, hashed, mix, roll
from driftwell.session import cut_lineage

ANCHOR = 12
#: Second, independent hash of a word.
_SECOND = U(0x6A09E667F3BCC909)


def _least_at(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of the first least one."""
    n = len(values) - width + 1
    at, size = np.arange(len(values)), 1
    # windows of doubled length, then two that overlap
    while size * 2 <= width:
        left, right = at[:-size], at[size:]
        at = np.where(values[right] < values[left], right, left)
        size *= 2
    left, right = at[:n], at[width - size : width - size + n]
    better = values[right] < values[left]
    return np.where(better, right, left)


def _paths(width: int, anchor: int):
    """A row for each path, and one for each text with its count of words and the hash of all of them."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("anchor", pa.int64()), ("path", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("n_words", pa.int64()), ("sha", pa.string())]
    )

    def run(batches):
        for batch in slices(batches, "text"):
            ids = batch.column(0).to_numpy()
            data, limits, starts, ends, doc, h = hashed(batch.column(1), lower=False)
            at = np.searchsorted(doc, np.arange(len(limits)))
            shas = [_sha(data, starts[a:b], ends[a:b]) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), *[pa.nulls(len(ids), t) for t in schema.types[1:5]], pa.array(np.diff(at)), pa.array(shas)], schema=schema
            )
            if len(h) < width:
                continue
            least = _least_at(roll(h, anchor), width - anchor + 1)
            whole = doc[: len(least)] == doc[width - 1 : width - 1 + len(least)]
            new = np.concatenate(([True], (least[1:] != least[:-1]) | ~whole[:-1])) & whole
            first = np.flatnonzero(new)
            if not len(first):
                continue
            # a path ends before the next one, or before the first window that leaves its text
            stop = np.flatnonzero(np.concatenate((new | ~whole, [True])))
            last = stop[np.searchsorted(stop, first, side="right")]
            grams = roll(h, anchor)
            words = last - first + width - 1
            # the words of a path: windows at its ends overlap, so two windows and the length tell it apart
            wide = roll(h, width)
            path = mix(wide[first] * U(0x9E3779B97F4A7C15) + mix(wide[last - 1] + words.astype(U)))
            begin = at[doc[first]]
            n = len(first)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[doc[first]]),
                    pa.array(grams[least[first]].view(np.int64)),
                    pa.array(path.view(np.int64)),
                    pa.array((first - begin).astype(np.int32)),
                    pa.array((last - begin).astype(np.int32)),
                    pa.nulls(n, pa.int64()),
                    pa.nulls(n, pa.string()),
                ],
                schema=schema,
            )

    return run


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words joined by one space."""
    if not len(starts):
        return b""
    lengths = ends - starts + 1
    place = np.cumsum(lengths) - lengths
    take = np.arange(lengths.sum()) - np.repeat(place - starts, lengths)
    out = data[np.minimum(take, len(data) - 1)]
    out[place + lengths - 1] = 0x20
    return out[:-1].tobytes()


def _sha(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    return hashlib.sha256(_joined(data, starts, ends)).hexdigest()


def _windows(width: int):
    """Every window of the paths that are opened, with two hashes of its words."""

    def run(batches):
        for batch in slices(batches, "text"):
            ids, opened = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            _, limits, _, _, doc, h = hashed(batch.column(1), lower=False)
            at = np.searchsorted(doc, np.arange(len(limits)))
            one, two = roll(h, width), roll(mix(h ^ _SECOND), width)
            place, owner = [], []
            for i, paths in enumerate(opened):
                own = np.unique(np.concatenate([np.arange(p["low"], p["high"]) for p in paths]))
                place.append(own + at[i])
                owner.append(np.full(len(own), i))
            at_word, who = np.concatenate(place), np.concatenate(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[who]),
                    pa.array((at_word - at[who]).astype(np.int32)),
                    pa.array(one[at_word].view(np.int64)),
                    pa.array(two[at_word].view(np.int64)),
                ],
                names=["doc_id", "low", "w1", "w2"],
            )

    return run


def _cut(width: int):
    """Each text without the words of its spans."""

    def run(batches):
        for batch in slices(batches, "text"):
            ids, cut = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            data, limits, starts, ends, doc, = hashed(batch.column(1), lower=False)[:5]
            at = np.searchsorted(doc, np.arange(len(limits)))
            removed, kept = [], []
            for i, spans in enumerate(cut):
                a, b = at[i], at[i + 1]
                change = np.zeros(b - a + 1, np.int64)
                for s in spans:
                    change[s["low"]] += 1
                    change[s["high"] - 1 + width] -= 1
                keep = np.cumsum(change)[:-1] == 0
                removed.append(int((~keep).sum()))
                kept.append(_joined(data, starts[a:b][keep], ends[a:b][keep]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_removed", "kept"],
            )

    return run


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 50, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, counts, cut) of ``docs``.

    rows: doc_id, text, one row per key. counts: doc_id, n_words, sha of all words. cut: doc_id, n_removed, kept
    (the words left, joined by one space) of the texts that lose any word: those covered by a window of
    ``width`` consecutive words that also starts in a text with a smaller key. Words are runs of non-space,
    unchanged. Texts shorter than a window, empty or null, lose nothing. Rows without a key are left out; keys
    that repeat count once, with the greatest text. Repeats inside one text stay.
    """
    spark = docs.sparkSession
    rows = one_row_per_id(docs, key, text).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = cut_lineage(
        rows.mapInArrow(
            _paths(width, anchor), "doc_id long, anchor long, path long, low int, high int, n_words long, sha string"
        )
    )
    paths = found.filter("path is not null")
    same = cut_lineage(
        paths.groupBy("anchor", "path").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last_id"))
    )
    # anchors that branch: their paths may share windows, which the first sources show one by one
    forks = same.groupBy("anchor").agg(F.count("*").alias("c"), F.min("source").alias("d"), F.max("source").alias("e"))
    forks = forks.filter("c > 1 and e > d").select("anchor", F.lit(True).alias("fork"))
    wanted = same.join(forks, "anchor", "left").filter("fork or last_id > source").select("anchor", "path", "source", "fork")
    met = cut_lineage(
        paths.join(wanted, ["anchor", "path"])
        .filter("fork or doc_id > source")
        .select("doc_id", "low", "high", (F.col("doc_id") > F.col("source")).alias("copy"))
    )
    copied = met.filter("copy").select("doc_id", "low", "high")
    opened = cut_lineage(met.filter("not copy").groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("paths")))
    windows = cut_lineage(
        rows_of_ids(rows, opened.select("doc_id"), "doc_id")
        .join(opened, "doc_id")
        .select("doc_id", "text", "paths")
        .mapInArrow(_windows(width), "doc_id long, low int, w1 long, w2 long")
    )
    sources = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("e")).filter("e > source")
    single = windows.join(sources, ["w1", "w2"]).filter("doc_id > source").select("doc_id", "low", (F.col("low") + 1).alias("high"))
    spans = cut_lineage(copied.union(single).groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("spans")))
    cut = (
        rows_of_ids(rows, spans.select("doc_id"), "doc_id")
        .join(spans, "doc_id")
        .select("doc_id", "text", "spans")
        .mapInArrow(_cut(width), "doc_id long, n_removed long, kept string")
    )
    return rows, found.filter("n_words is not null").select("doc_id", "n_words", "sha"), cut


def kept_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 50) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of each key; see ``repeated_spans``."""
    _, counts, cut = repeated_spans(docs, key, text, width)
    cut = cut.select("doc_id", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))
    return counts.join(cut, "doc_id", "left").select(
        F.col("doc_id").alias(key),
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 50) -> DataFrame:
    """``docs`` with the repeated words gone; texts that lose nothing stay to the letter.

    Expects one row per key, as ``docs`` of a pipeline has; all columns stay.
    """
    _, _, cut = repeated_spans(docs, key, text, width)
    kept = cut.select(F.col("doc_id").alias("__id"), "kept")
    return docs.join(kept, docs[key] == kept["__id"], "left").select(
        *[F.coalesce("kept", docs[c]).alias(c) if c == text else docs[c] for c in docs.columns]
    )


SQL = r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS MATERIALIZED (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i+49], ' ')))) AS h
  FROM words WHERE len(w) >= 50),
firsts AS (SELECT h, min(doc_id) AS source FROM starts GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM starts JOIN firsts USING (h) WHERE doc_id > source),
cut AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
    ELSE coalesce(array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_contains(ps, i) THEN NULL ELSE w[i] END), lambda x: x IS NOT NULL), ' '), '') END) AS kept_sha256
FROM words LEFT JOIN cut USING (doc_id)
"""


def query(spark, sf_dir: str) -> DataFrame:
    return kept_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


__all__ = ["SQL", "kept_digests", "partitions", "query", "repeated_spans", "without_repeats"]

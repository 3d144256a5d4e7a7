"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; windows of canonical tokens of documents and benchmark items
meet in a hash join; along each alignment the placeholders must translate consistently (one value of the item is one
value of the document throughout), so an item with other numbers or names is found and a chance mixture is not.
Windows that are nearly all placeholders, and items shorter than a window as a whole, meet by what was written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.shared import slices
from driftwell.llm.words import LOWER, U, buffers, mix, roll, spans, word_hashes
from driftwell.session import cut_lineage

#: Tokens of a window, of these at least so many that are no placeholder, and the part of an item that makes a leak.
WINDOW, LITERALS, SHARE = 6, 3, 0.5
#: Bits of the filter that documents' windows pass before the join; a fixed size, whatever the benchmark.
FILTER_BITS = 1 << 23

#: Units of measure, as written after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ounce ounces gram grams kilogram kilograms "
    "ton tons ml cl l liter liters litre litres gallon gallons pint pints cup cups s sec second seconds min minute minutes h hr hour hours "
    "day days week weeks month months year years hz khz mhz ghz w kw kwh j kj cal kcal v mv a ma pa kpa k c f percent pct usd eur gbp "
    "dollar dollars cent cents euro euros pound pounds kph mph kmh meter meters metre metres centimeter centimeters kilometer kilometers"
).split()

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?:\n"]] = True
_NUMBER, _NAME, _UNIT = U(0x1F83D9ABFB41BD6B), U(0x5BE0CD19137E2179), U(0x3C6EF372FE94F82B)
_EXACT = U(0x510E527FADE682D1)


def canonical(texts: pa.Array):
    """(token hashes with placeholders, hashes of what was written, which are placeholders, text number, limits)."""
    raw, limits = buffers(texts)
    inside = _WORD[raw]
    point = np.zeros(len(raw), bool)  # points and commas within a number
    if len(raw) > 2:
        point[1:-1] = ((raw[1:-1] == 0x2E) | (raw[1:-1] == 0x2C)) & _DIGIT[raw[:-2]] & _DIGIT[raw[2:]]
        cuts = limits[(limits > 0) & (limits < len(raw))]
        point[cuts] = point[cuts - 1] = False
    marked = np.where(point, np.uint8(0x80), np.where(inside, raw, np.uint8(0x20)))
    starts, ends, doc = spans(marked, limits, _WORD)
    data = LOWER[raw]
    folded = (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)  # capitals of the Latin-1 letters
    folded[1:] &= raw[:-1] == 0xC3
    folded[:1] = False
    data[folded] += 0x20
    own = word_hashes(data, starts, ends)
    out, slot = own.copy(), np.zeros(len(own), bool)
    if not len(own):
        return out, own, slot, doc, limits
    number = _DIGIT[raw[starts]]
    enders = np.concatenate(([0], np.cumsum(_ENDS[raw] & ~point)))
    first = np.ones(len(own), bool)  # tokens that begin a sentence
    first[1:] = (doc[1:] != doc[:-1]) | (enders[starts[1:]] > enders[ends[:-1]])
    capital = ((raw[starts] >= 65) & (raw[starts] <= 90)) | folded[np.minimum(starts + 1, len(raw) - 1)] & (raw[starts] == 0xC3)
    name = capital & ~first
    unit = np.zeros(len(own), bool)
    unit[1:] = number[:-1] & (doc[1:] == doc[:-1]) & np.isin(own[1:], _unit_hashes())
    for which, value in ((name, _NAME), (unit, _UNIT), (number, _NUMBER)):
        out[which] = value
        slot |= which
    return out, own, slot, doc, limits


def _unit_hashes() -> np.ndarray:
    data, limits = buffers(pa.array([" ".join(UNITS)]))
    starts, ends, _ = spans(data, limits, _WORD)
    return word_hashes(data, starts, ends)


def _windows(bits: np.ndarray | None, window: int, literals: int, short: list[int] | None = None):
    """Windows (all, or those that pass the filter): hash, id, place, values of the placeholders, tokens of the text, exact.

    Windows of fewer than ``literals`` tokens that are no placeholder are exact: the hash is of what was written. So
    are texts shorter than a window, taken whole; ``short``: windows of these lengths instead, of every text.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text"):
            ids = batch.column(0).to_numpy()
            tokens, own, slot, doc, limits = canonical(batch.column(1))
            if not len(tokens):
                continue
            held = np.concatenate(([0], np.cumsum(~slot)))
            begin = np.searchsorted(doc, np.arange(len(limits)))
            count = np.diff(begin)
            values = own.view(np.int64)
            for size in (window, *(range(1, window) if short is None else short)):
                n = len(tokens) - size + 1
                if n <= 0:
                    continue
                good = doc[:n] == doc[size - 1 :]
                exact = held[size:] - held[:-size] < literals
                keys = mix(roll(own, size) ^ (_EXACT + U(size)))
                if size == window:
                    keys = np.where(exact, keys, roll(tokens, size))
                else:
                    exact[:] = True
                    if short is None:
                        good &= count[doc[:n]] == size
                if bits is not None:
                    at = (mix(keys) % U(FILTER_BITS)).astype(np.int64)
                    good &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                at = np.flatnonzero(good)
                if not len(at):
                    continue
                written = [values[i : i + size][slot[i : i + size]].tolist() for i in at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[at].view(np.int64)),
                        pa.array(ids[doc[at]]),
                        pa.array((at - begin[doc[at]]).astype(np.int32)),
                        pa.array(written, pa.list_(pa.int64())),
                        pa.array(count[doc[at]].astype(np.int32)),
                        pa.array(exact[at]),
                    ],
                    names=["w", "id", "at", "slots", "n", "exact"],
                )

    return run


_ROWS = "w long, id long, at int, slots array<long>, n int, exact boolean"


def leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    window: int = WINDOW, literals: int = LITERALS, share: float = SHARE,
) -> DataFrame:
    """(doc_id, item_id, share, n_slots, n_changed): documents that hold at least ``share`` of an item's tokens.

    Covered tokens are those of windows shared along one alignment whose placeholders translate consistently;
    where they do not, only windows without placeholders and exact ones (see ``_windows``) count. n_slots counts
    different placeholder values of the item that were met, n_changed those written otherwise in the document. Items
    shorter than a window count where all their tokens stand in a row as written, but for capitals. Rows
    without key and null or empty texts on either side take no part; repeated rows of a key count as one text
    with all their windows.
    """
    asked = items.filter(F.col(item_key).isNotNull()).select(F.col(item_key).cast("long").alias("id"), F.col(item_text).cast("string").alias("text"))
    sought = cut_lineage(asked.mapInArrow(_windows(None, window, literals), _ROWS).distinct())

    def bit(batches):
        for batch in batches:
            at = (mix(batch.column(0).to_numpy().view(U).copy()) % U(FILTER_BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["k", "b"])

    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for row in sought.select("w").mapInArrow(bit, "k long, b long").groupBy("k").agg(F.bit_or("b").alias("b")).toLocalIterator():
        bits[row["k"]] = row["b"]  # FILTER_BITS / 64 rows at most
    texts = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    short = [r["n"] for r in sought.filter(F.col("n") < window).select("n").distinct().collect()]
    met = texts.mapInArrow(_windows(bits.view(np.uint8), window, literals, short), _ROWS)
    hits = (
        met.select("w", F.col("id").alias("doc_id"), F.col("at").alias("d_at"), F.col("slots").alias("d_slots"))
        .join(sought.select("w", F.col("id").alias("item_id"), F.col("at").alias("i_at"), F.col("slots").alias("i_slots"), "n", "exact"), "w")
        .withColumn("line", F.col("d_at") - F.col("i_at"))
    )
    lines = hits.groupBy("doc_id", "item_id", "line").agg(
        F.max("n").alias("n"),
        F.collect_set("i_at").alias("all_at"),
        F.collect_set(F.when((F.size("i_slots") == 0) | F.col("exact"), F.col("i_at"))).alias("bare_at"),
        F.array_distinct(F.flatten(F.collect_list(F.arrays_zip(F.col("i_slots").alias("i"), F.col("d_slots").alias("d"))))).alias("pairs"),
    )
    ok = F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"]))) == F.size("pairs")
    lines = lines.select(
        "doc_id", "item_id", "n",
        F.when(ok, F.col("all_at")).otherwise(F.col("bare_at")).alias("at"),
        F.when(ok, F.col("pairs")).otherwise(F.slice("pairs", 1, 0)).alias("pairs"),
    )
    # an insertion moves the alignment: the lines of a document and item add up
    both = lines.groupBy("doc_id", "item_id").agg(
        F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_set("at"))).alias("at"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, F.least(p + window, F.col("n")) - 1)))))
    return (
        both.select(
            "doc_id", "item_id", (covered / F.col("n")).alias("share"),
            F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"]))).alias("n_slots"),
            F.size(F.filter("pairs", lambda p: p["i"] != p["d"])).alias("n_changed"),
        )
        .filter(F.col("share") >= share)
    )


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark; all columns stay."""
    found = cut_lineage(leaks(docs, items, key, text).select(F.col("doc_id").alias("__leak")).distinct())
    return docs.join(found, docs[key] == found["__leak"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

"""Language identification: blended-spectrum presence kernels, Nystrom landmarks, one-versus-rest ridge regression.

A text is the set of its byte n-grams of 1 to 4 (letters lower-case, all else of ASCII one space), hashed to a fixed
number of flags; the kernel of two texts is the part of flags they share, normalised by both set sizes. A bounded
sample of labelled texts, drawn in the scan tasks and written, gives landmarks and the ridge weights; the fit runs in
one task on that sample alone. Scoring is a
product of the flag matrix of a batch with the landmarks' flags, then with the weights.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.llm.shared import slices
from driftwell.llm.words import buffers
from driftwell.session import cut_lineage

#: Flags of a text, landmarks in all, sample rows of a language at most, languages at most (more are an error).
FLAGS, LANDMARKS, SAMPLE, LANGUAGES = 1 << 13, 256, 400, 1000
#: Rows whose flags are unpacked at once.
ROWS = 512
RIDGE = 1e-3
#: Rejection: bytes of the pieces cut from each learning text, texts laid together, least margins of a size that set a
#: limit, and the part of the way from the lowest clean margin to the median margin of random flags that is left free.
PIECES, TOGETHER, LEAST, SLACK = (8, 16, 32, 64, 128, 256, 512, 1024), (2, 8, 32), 30, 0.25
#: Bytes of a text whose n-grams are set at once.
_STEP = 1 << 20

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def flags(texts: pa.Array) -> np.ndarray:
    """The n-gram flags of each text of an array without nulls, packed to bits."""
    data, limits = buffers(texts)
    out = np.zeros((len(limits) - 1, FLAGS // 8), np.uint8)
    row = np.empty(FLAGS, bool)
    for i, (low, high) in enumerate(zip(limits, limits[1:], strict=False)):
        row[:] = False
        for at in range(low, high, _STEP):
            b = _FOLD[data[at : min(high, at + _STEP + 3)]].astype(np.uint32)
            code = np.zeros(len(b), np.uint32)
            for n in range(1, 5):
                if len(b) < n:
                    break
                code = code[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :] + np.uint32(n)
                row[((code * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int32)] = True
        out[i] = np.packbits(row)
    return out


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared flags over the geometric mean of the set sizes; both sides are 0/1 in float32."""
    return (a @ b.T) / np.sqrt(np.maximum(a.sum(1), 1)[:, None] * np.maximum(b.sum(1), 1)[None, :])


def _chunks(bits: np.ndarray) -> Iterator[np.ndarray]:
    """Packed flags as 0/1 in float32, ROWS rows at a time."""
    for low in range(0, len(bits), ROWS):
        yield np.unpackbits(bits[low : low + ROWS], axis=1).astype(np.float32)


def _products(bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Kernel of packed rows with the landmarks' flags."""
    return np.vstack([_kernel(x, marks) for x in _chunks(bits)])


def _model(names: list[str], lang: np.ndarray, bits: np.ndarray, landmarks: int, ridge: float, noise: np.ndarray | None = None) -> dict:
    """Ridge weights of the labelled rows (packed flags); ``noise``: rows that belong to no language."""
    # landmarks in turn of the languages, evenly over each one's rows
    each = max(1, landmarks // len(names))
    marks = np.concatenate([np.flatnonzero(lang == c)[:: max(1, int((lang == c).sum()) // each)][:each] for c in range(len(names))])
    m = np.unpackbits(bits[marks], axis=1).astype(np.float32)
    values, vectors = np.linalg.eigh(_kernel(m, m).astype(np.float64))
    good = values > 1e-6
    whiten = vectors[:, good] / np.sqrt(values[good])
    classes = len(names)
    products = _products(bits, m)
    if noise is not None:
        products, lang, classes = np.vstack([products, _products(noise, m)]), np.append(lang, np.full(len(noise), classes)), classes + 1
    z = np.hstack([products @ whiten, np.ones((len(products), 1))])
    target = np.where(lang[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = (len(lang) / (classes * np.maximum(np.bincount(lang, minlength=classes), 1)))[lang]  # rare languages count as much
    inner = (z * weight[:, None]).T @ z + ridge * len(z) * np.eye(z.shape[1])
    beta = np.linalg.solve(inner, (z * weight[:, None]).T @ target)
    return {"names": names, "marks": bits[marks], "map": whiten @ beta[:-1], "bias": beta[-1]}


def _random(sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Packed random flags, about as many in each row as ``sizes`` says."""
    rows = [np.packbits(rng.random((len(part), FLAGS), np.float32) < (part / FLAGS)[:, None], axis=1) for part in (sizes[a : a + ROWS] for a in range(0, len(sizes), ROWS))]
    return np.concatenate(rows) if rows else np.zeros((0, FLAGS // 8), np.uint8)


def _sizes(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(1).astype(np.int64)


def _margins(model: dict, marks: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _kernel(x, marks) @ model["map"] + model["bias"]


def _size(x: np.ndarray) -> np.ndarray:
    """The power of two below the number of flags of each row."""
    return np.log2(np.maximum(x.sum(1), 1)).astype(np.int64)


def _limits(names: list[str], lang: np.ndarray, bits: np.ndarray, pieces: list[list[bytes]], landmarks: int, ridge: float) -> list[float]:
    """The margin below which a text of a size (see ``_size``) is no language.

    Each half of the rows is scored by a model of the other half: whole texts, pieces of them, and several of a
    language together. The limit of a size lies SLACK of the way from the lowest of these margins to the median of
    random flags of that size. Sizes that too few margins reach take the limit of the next smaller one; the
    smallest, and all where a half lacks a language, have none.
    """
    low = np.full((2, FLAGS.bit_length()), np.inf)
    count = np.zeros(FLAGS.bit_length(), np.int64)
    chance = np.zeros(FLAGS.bit_length())
    rng = np.random.default_rng(11)
    half = np.empty(len(lang), np.int64)
    for c in range(len(names)):
        half[lang == c] = np.arange(int((lang == c).sum())) % 2
    for side in (0, 1):
        own, other = np.flatnonzero(half == side), np.flatnonzero(half != side)
        if len(set(lang[own])) < len(names) or len(set(lang[other])) < len(names):
            return []
        model = _model(names, lang[other], bits[other], landmarks, ridge, _random(_sizes(bits[other]), rng))
        marks = np.unpackbits(model["marks"], axis=1).astype(np.float32)
        rows = [bits[i] for i in own] + [np.frombuffer(b, np.uint8) for i in own for b in pieces[i]]
        for c in range(len(names)):
            mine = own[lang[own] == c]
            rows += [np.bitwise_or.reduce(bits[mine[k : k + n]], axis=0) for n in TOGETHER for k in range(0, len(mine) - n + 1, max(1, n // 4))]
        for at in range(0, len(rows), ROWS):
            x = np.unpackbits(np.stack(rows[at : at + ROWS]), axis=1).astype(np.float32)
            size, best = _size(x), _margins(model, marks, x).max(1)
            np.minimum.at(low[side], size, best)
            count += np.bincount(size, minlength=len(count))
        for k in range(len(chance)):
            x = np.unpackbits(_random(np.full(64, min(1.4 * (1 << k), FLAGS)), rng), axis=1).astype(np.float32)
            chance[k] += np.median(_margins(model, marks, x).max(1)) / 2
    limits = []
    for k, clean in enumerate(low.min(0)):
        before = limits[-1] if limits else -np.inf
        limits.append(float(clean - SLACK * max(0.0, clean - chance[k])) if count[k] >= LEAST else before)
    return limits


def _fitted(landmarks: int, ridge: float, reject: bool = False):
    def fit(batches: Iterator[pa.RecordBatch]):
        rows = sorted(r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        if not rows:
            return
        names = sorted({r[0] for r in rows})
        lang = np.array([names.index(r[0]) for r in rows])
        bits = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1)
        noise = _random(_sizes(bits), np.random.default_rng(11)) if reject else None
        model = _model(names, lang, bits, landmarks, ridge, noise)
        if reject:
            model["limits"] = _limits(names, lang, bits, [r[2] for r in rows], landmarks, ridge)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return fit


def _pieces(text: str) -> list[str]:
    """Pieces of growing length, each from another place of the text; whole texts are no pieces."""
    raw = text.encode()
    places = [(n, zlib.crc32(raw[:256] + bytes([i])) % (len(raw) - n)) for i, n in enumerate(PIECES) if n < len(raw)]
    return [raw[at : at + n].decode(errors="ignore") for n, at in places]


def fit_languages(
    docs: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE, reject: bool = False
) -> dict | None:
    """A model from rows where ``usable`` holds and the language is known; None if there is none.

    The sample is bounded: of each language the ``sample`` rows with the smallest hash of key and text, equal rows
    once; every language with a row is in it. More than LANGUAGES languages are an error. With ``reject`` random
    flags are learned as no language, and the model has the margins below which a text is none.
    """
    rows = docs.filter(usable & F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    counts = cut_lineage(rows.groupBy("lang").count())
    if counts.count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    # tasks pass on about 4 samples of a language, of equal rows one each; the smallest hashes of these are the sample
    some = F.broadcast(counts.select("lang", (F.lit(4.0 * sample) / F.col("count")).alias("share")))
    rows = rows.withColumn("draw", F.xxhash64("k", "text", F.lit("language")))
    passed = rows.join(some, "lang").filter(F.col("draw") < F.lit(2.0**64) * F.col("share") - F.lit(2.0**63))
    smallest = Window.partitionBy("lang").orderBy("draw")
    picked = passed.groupBy("lang", "draw").agg(F.min("text").alias("text")).withColumn("at", F.row_number().over(smallest))
    picked = cut_lineage(picked.filter(F.col("at") <= sample).select("lang", "text"))

    def turned(batches):
        for batch in slices(batches, "text"):
            columns = [batch.column(0), pa.array([r.tobytes() for r in flags(batch.column(1))], pa.binary())]
            if reject:
                cut = [[r.tobytes() for r in flags(pa.array(_pieces(t), pa.string()))] for t in batch.column(1).to_pylist()]
                columns.append(pa.array(cut, pa.list_(pa.binary())))
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "bits", "pieces"][: len(columns)])

    kind = "lang string, bits binary" + ", pieces array<binary>" * reject
    found = picked.mapInArrow(turned, kind).repartition(1).mapInArrow(_fitted(landmarks, ridge, reject), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def _scored(model: dict | None):
    marks = None

    def run(batches: Iterator[pa.RecordBatch]):
        nonlocal marks
        if model is not None and marks is None:
            marks = np.unpackbits(model["marks"], axis=1).astype(np.float32)
        for batch in slices(batches, "text"):
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            n = batch.num_rows
            if model is None:
                langs, score = ["und"] * n, np.zeros(n)
            else:
                langs, score = [], np.zeros(n)
                bits = flags(batch.column(1))
                for low in range(0, n, 512):
                    x = np.unpackbits(bits[low : low + 512], axis=1).astype(np.float32)
                    margin = _kernel(x, marks) @ model["map"] + model["bias"]
                    share = np.exp(4 * (margin - margin.max(1, keepdims=True)))
                    best = margin.argmax(1)
                    langs += [model["names"][b] for b in best]
                    score[low : low + 512] = 1 / share.sum(1)
                langs = [x if ok else "und" for x, ok in zip(langs, letters, strict=True)]
                score = np.where(letters, np.clip(score, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    return run


def held_out(key: str) -> Column:
    """Rows that take no part in learning: crc32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score) of each row.

    Learns from rows that are not held out and have a language; a row without a key is not held out. ``und`` with score 0 where the text is
    null or has no letter, and for every row if there is nothing to learn from. Rows are independent: repeated
    or null keys stay. Only the text is an input of a prediction.
    """
    model = fit_languages(docs, ~held_out(key), key, text, lang)
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters")
    )
    found = rows.mapInArrow(_scored(model), "doc_id long, lang_pred string, score double")
    return found.select(F.col("doc_id").alias(key), held_out("doc_id").alias("held_out"), "lang_pred", "score")


def _recognised(model: dict | None, texts: pa.Array) -> np.ndarray:
    """Whether the margin of each text's best language reaches the limit of the text's size."""
    keep = np.ones(len(texts), bool)
    if model is None or not model["limits"]:
        return keep
    limits = np.array(model["limits"])
    marks = np.unpackbits(model["marks"], axis=1).astype(np.float32)
    bits = flags(texts)
    for low in range(0, len(texts), 512):
        x = np.unpackbits(bits[low : low + 512], axis=1).astype(np.float32)
        keep[low : low + 512] = _margins(model, marks, x).max(1) >= limits[_size(x)]
    return keep


def known_language(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text is in a language like those learned; rows stand for themselves.

    Texts without a letter go, and those whose margin is below the limit of their size, which ``_limits`` draws from the
    learning rows. If there is nothing to learn from every text with a letter stays.
    """
    model = fit_languages(docs, ~held_out(key), key, text, lang, reject=True)
    at = docs.schema.fieldNames().index(text)

    def run(batches):
        for batch in slices(batches, text):
            yield batch.filter(pa.array(_recognised(model, batch.column(at)), pa.bool_()))

    lettered = docs.filter(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    return lettered.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return identified(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Masked pseudo-likelihood: a bidirectional window network scores every token from both sides.

A token is one of the most frequent words of all documents or a hash bucket of the others. The network sees the
WINDOW tokens before and after a position, not the position itself: an embedding table per offset is summed (the
first layer), tanh, and a two-step softmax (class of the token, token within the class) gives the conditional
probability. A word of a bucket has this times its share of the bucket's count, from a table of the counts of all words
that grows with the corpus and is joined by hash. Documents are scored by the sum of their words' conditional
log-probabilities.

Training covers all documents: every task trains a copy of the parameters on its own rows, one pass, and the copies
are averaged by tokens seen, in groups of bounded size level by level, so neither the driver nor a task ever holds
more than a few copies. Every token of every text is a target and context in training, and every token is scored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.shared import groups_of, partitions, slices
from driftwell.llm.words import word_hashes
from driftwell.session import cut_lineage

#: Frequent words, buckets of other words, classes of the output, tokens to each side, width of the hidden layer.
KNOWN, OTHERS, CLASSES, WINDOW, HIDDEN = 768, 254, 32, 2, 24
#: Positions per step; step size; words counted before they are sent on.
BATCH, RATE, COUNTED = 4096, 0.3, 200_000
#: Copies of the parameters that a task averages.
FAN_IN = 16

VOCABULARY = KNOWN + OTHERS + 2  # and one for the text's edge, one to fill the last class
_EDGE = KNOWN + OTHERS
_PER_CLASS = VOCABULARY // CLASSES


def _word_counts(batches: Iterator[pa.RecordBatch]):
    held: Counter[str] = Counter()

    def out():
        words = list(held)
        batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], names=["word", "c"])
        held.clear()
        return batch

    for batch in slices(batches, "text"):
        for text in batch.column(0).to_pylist():
            held.update(text.lower().split())
            if len(held) > COUNTED:
                yield out()
    if held:
        yield out()


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % OTHERS


def _hashes(words: list[str]) -> np.ndarray:
    lengths = np.array([0, *(len(w.encode()) for w in words)], np.int64)
    limits = np.cumsum(lengths)
    return word_hashes(np.frombuffer("".join(words).encode(), np.uint8), limits[:-1], limits[1:]).view(np.int64)


def _with_hashes(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        words = batch.column(0).to_pylist()
        if words:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(_hashes(words)), pa.array([_bucket(w) for w in words], pa.int32())], names=["word", "c", "h", "bucket"]
            )


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c, h, bucket), a written row for each distinct word of all texts."""
    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_word_counts, "word string, c long")
    return cut_lineage(counted.groupBy("word").agg(F.sum("c").alias("c")).mapInArrow(_with_hashes, "word string, c long, h long, bucket int"))


def vocabulary(docs: DataFrame, text: str = "text", size: int = KNOWN, counts: DataFrame | None = None) -> dict[str, int]:
    """The ``size`` most frequent words of all texts, ties by word; the counts cover every word of every text."""
    counts = word_counts(docs, text) if counts is None else counts
    top = counts.select("word", "c").orderBy(F.desc("c"), "word").limit(size).collect()
    return {r["word"]: i for i, r in enumerate(top)}


def _bucket_logs(counts: DataFrame, known: dict[str, int]) -> np.ndarray:
    """Logarithm of the count of each bucket's words, those that are known by themselves left out."""
    total = np.zeros(OTHERS)
    for row in counts.groupBy("bucket").agg(F.sum("c").alias("c")).collect():  # OTHERS rows at most
        total[row["bucket"]] = row["c"]
    for row in counts.filter(F.col("word").isin(list(known))).select("bucket", "c").collect():  # KNOWN rows at most
        total[row["bucket"]] -= row["c"]
    return np.log(np.maximum(total, 1))


class Network:
    """Parameters as one flat array: tables per offset, class layer, layers within the classes."""

    SHAPES = (
        ("tables", (2 * WINDOW, VOCABULARY, HIDDEN)),
        ("bias", (HIDDEN,)),
        ("top", (HIDDEN, CLASSES)),
        ("top_bias", (CLASSES,)),
        ("low", (CLASSES, HIDDEN, _PER_CLASS)),
        ("low_bias", (CLASSES, _PER_CLASS)),
    )

    def __init__(self, flat: np.ndarray | None = None):
        sizes = [int(np.prod(s)) for _, s in self.SHAPES]
        if flat is None:
            flat = np.random.default_rng(7).normal(0, 0.1, sum(sizes)).astype(np.float32)
        self.flat, at = flat, 0
        for (name, shape), n in zip(self.SHAPES, sizes, strict=True):
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.tables[0].take(context[0], 0, mode="clip")
        for j in range(1, len(context)):
            total += self.tables[j].take(context[j], 0, mode="clip")
        total += self.bias
        return np.tanh(total, out=total)

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        """In place, over the first axis: a column is a position, so each reduction runs along whole rows."""
        x -= x.max(0)
        np.exp(x, out=x)
        x /= x.sum(0)
        return x

    def _forward(self, h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Probabilities (class x position, token of the position's class x position) and the runs (class, first, stop).

        Positions come sorted by their class, so a class is one slice of every array and one softmax does for all.
        """
        limits = np.searchsorted(group, np.arange(CLASSES + 1)).tolist()
        runs = [(c, i, k) for c, (i, k) in enumerate(zip(limits, limits[1:], strict=False)) if i < k]
        top = self.top.T @ h.T
        top += self.top_bias[:, None]
        low = np.empty((_PER_CLASS, len(h)), h.dtype)
        for c, i, k in runs:
            np.matmul(self.low[c].T, h[i:k].T, out=low[:, i:k])
            low[:, i:k] += self.low_bias[c][:, None]
        return self._softmax(top), self._softmax(low), runs

    def log_prob(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of positions sorted by their target."""
        group, inner = np.divmod(target, _PER_CLASS)
        top, low, _ = self._forward(self.hidden(context), group)
        at = np.arange(len(target))
        return np.log(top[group, at] + 1e-12) + np.log(low[inner, at] + 1e-12)

    def step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step of gradient descent on the mean loss of the positions, which come sorted by their target."""
        n = len(target)
        h = self.hidden(context)
        group, inner = np.divmod(target, _PER_CLASS)
        d_top, d_low, runs = self._forward(h, group)
        at = np.arange(n)
        d_top[group, at] -= 1
        d_low[inner, at] -= 1
        d_h = d_top.T @ self.top.T
        scale = rate / n
        for c, i, k in runs:
            d = d_low[:, i:k]
            d_h[i:k] += d.T @ self.low[c].T
            self.low[c] -= scale * CLASSES * (h[i:k].T @ d.T)
            self.low_bias[c] -= scale * CLASSES * d.sum(1)
        self.top -= scale * (h.T @ d_top.T)
        self.top_bias -= scale * d_top.sum(1)
        d_h *= 1 - h * h
        self.bias -= scale * d_h.sum(0)
        # sums by token, a hidden unit at a time; rare tokens move by the root of their share, so they learn too
        size = len(context) * VOCABULARY
        ids = (context + VOCABULARY * np.arange(len(context))[:, None]).ravel()
        rates = rate / 4 / np.sqrt(n * np.maximum(np.bincount(ids, minlength=size), 1))
        tables = self.tables.reshape(size, HIDDEN)
        sums = np.empty((HIDDEN, size))
        for k, moved in enumerate(np.tile(d_h.T.astype(np.float64), len(context))):
            sums[k] = np.bincount(ids, moved, size)
        sums *= rates
        tables -= sums.T


class _Tokens(dict):
    """Tokens of words: the known ones, and buckets of the others as they come."""

    def __missing__(self, word: str) -> int:
        token = self[word] = KNOWN + _bucket(word)
        return token


def _contexts(batch: pa.RecordBatch, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Tokens of all texts with edges between them, the number of tokens of each text, and all words in order."""
    ids: list[int] = []
    counts = []
    every: list[str] = []
    edges = [_EDGE] * WINDOW
    token = _Tokens(known).__getitem__
    for text in batch.column(1).to_pylist():
        words = text.lower().split()
        counts.append(len(words))
        ids += edges
        ids += map(token, words)
        every += words
    ids += edges
    return np.array(ids, np.int16), np.array(counts, np.int64), every


def _around(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([tokens[at + d] for d in (*range(-WINDOW, 0), *range(1, WINDOW + 1))])


def _by_target(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the positions by their tokens (16 bits: a radix sort), and the tokens in it."""
    target = tokens[at]
    order = np.argsort(target, kind="stable")
    return order, target[order]


def _trained(start: np.ndarray, known: dict[str, int]):
    """A copy of the network trained on a task's rows: (copy, weight, parameters)."""

    def run(batches: Iterator[pa.RecordBatch]):
        net, seen = Network(start.copy()), 0
        for batch in slices(batches, "text"):
            tokens, _, _ = _contexts(batch, known)
            at = np.flatnonzero(tokens != _EDGE)
            at = at[np.random.default_rng(len(at)).permutation(len(at))]
            for low in range(0, len(at), BATCH):
                part = at[low : low + BATCH]
                order, target = _by_target(tokens, part)
                net.step(_around(tokens, part[order]), target, RATE * min(1.0, len(part) / BATCH))
                seen += len(part)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(seen)]), pa.array([net.flat.tobytes()], pa.binary())], names=["copy", "weight", "net"]
            )

    return run


def _averaged(batches: Iterator[pa.RecordBatch]):
    """The weighted mean of the copies of each group."""
    sums: dict[int, list] = {}
    for batch in batches:
        for copy, weight, net in zip(*(batch.column(i) for i in range(3)), strict=True):
            part = weight.as_py() * np.frombuffer(net.as_py(), np.float32).astype(np.float64)
            held = sums.setdefault(copy.as_py(), [0.0, 0.0])
            held[0] += weight.as_py()
            held[1] = held[1] + part
    for copy, (weight, total) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([copy]), pa.array([weight]), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], names=["copy", "weight", "net"])


def train(docs: DataFrame, known: dict[str, int], rounds: int = 1) -> Network:
    """The network after ``rounds`` of local training and averaging; untrained if there is no token."""
    kind = "copy long, weight double, net binary"
    net = Network()
    for _ in range(rounds):
        copies = cut_lineage(docs.mapInArrow(_trained(net.flat, known), kind))
        n = copies.count()
        while n > 1:
            groups = -(-n // FAN_IN)
            # copies are dealt evenly by their number: a task averages the copies of a few groups, one sum each
            dealt = copies.withColumn("copy", F.pmod("copy", F.lit(groups))).repartition(min(groups, partitions(docs.sparkSession)), "copy")
            copies = cut_lineage(dealt.mapInArrow(_averaged, kind))
            n = copies.count()
        best = copies.first()
        if best is not None:
            net = Network(np.frombuffer(best["net"], np.float32).copy())
    return net


def _scores(net: Network, tokens: np.ndarray) -> np.ndarray:
    """The log-probability of each token that is no edge."""
    at = np.flatnonzero(tokens != _EDGE)
    scores = np.empty(len(at))
    for low in range(0, len(at), 4 * BATCH):
        part = at[low : low + 4 * BATCH]
        order, target = _by_target(tokens, part)
        scores[low + order] = net.log_prob(_around(tokens, part[order]), target)
    return scores


def _totals(scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    stops = np.cumsum(counts)
    return sums[stops] - sums[stops - counts]


def _scored(flat: np.ndarray, known: dict[str, int]):
    """Texts scored by the network alone: a bucket counts as one token."""

    def run(batches: Iterator[pa.RecordBatch]):
        net = Network(flat)
        for batch in slices(batches, "text"):
            tokens, counts, _ = _contexts(batch, known)
            total = _totals(_scores(net, tokens), counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(total)], names=["doc_id", "n_tokens", "log_prob"])

    return run


_FOUND = "row long, doc_id long, n_tokens long, log_prob double, h long, at binary"


def _asked(flat: np.ndarray, known: dict[str, int], bucket_logs: np.ndarray):
    """A numbered row for each text, its words in buckets still without their counts; and one for each such word of a slice.

    The latter has the hash, the number of the slice's first row and, for each occurrence, the row counted from there.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        net, row = Network(flat), TaskContext.get().partitionId() << 33
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.binary()]
        names = ["row", "doc_id", "n_tokens", "log_prob", "h", "at"]
        for batch in slices(batches, "text"):
            tokens, counts, words = _contexts(batch, known)
            scores = _scores(net, tokens)
            inner = tokens[tokens != _EDGE]
            rare = np.flatnonzero(inner >= KNOWN)
            scores[rare] -= bucket_logs[inner[rare] - KNOWN]
            n = batch.num_rows
            columns = [pa.array(row + np.arange(n)), batch.column(0), pa.array(counts), pa.array(_totals(scores, counts)), pa.nulls(n, kinds[4]), pa.nulls(n, kinds[5])]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            if len(rare):
                h = _hashes(list(compress(words, inner >= KNOWN)))
                order = np.argsort(h, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], np.diff(h[order]) != 0)))
                places = np.repeat(np.arange(n, dtype=np.uint32), counts)[rare][order]
                limits = (4 * np.append(first, len(order))).astype(np.int32)
                m = len(first)
                at = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(limits.tobytes()), pa.py_buffer(places.tobytes())])
                columns = [pa.array(np.full(m, row)), *(pa.nulls(m, k) for k in kinds[1:4]), pa.array(h[order][first]), at]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            row += n

    return run


def _added(batches: Iterator[pa.RecordBatch]):
    """The logarithms of the words' counts added up for each row, from batches sorted by slice: one row out per text."""
    for table in groups_of(batches, "row"):
        at = table.column("at").combine_chunks()
        limits = np.frombuffer(at.buffers()[1], np.int32)[at.offset : at.offset + len(at) + 1]
        places = np.frombuffer(at.buffers()[2], np.uint8)[limits[0] : limits[-1]].view(np.uint32).astype(np.int64)
        sizes = np.diff(limits) // 4
        ids, inverse = np.unique(np.repeat(table.column("row").to_numpy(), sizes) + places, return_inverse=True)
        total = np.bincount(inverse, weights=np.repeat(np.log(table.column("c").to_numpy()), sizes))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["row", "more"])


def pseudo_likelihood(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, log_prob, perplexity) of each row.

    log_prob sums the conditional log-probabilities of all words of the whole text; perplexity is
    exp(-log_prob / n_tokens), null for a text without tokens (null, empty or white space: 0 tokens, log_prob 0).
    Words are runs of non-space in lower case. Rows stand for themselves: null and repeated keys stay.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    counts = word_counts(rows)
    known = vocabulary(rows, counts=counts)
    net = train(rows, known)
    asked = cut_lineage(rows.mapInArrow(_asked(net.flat, known, _bucket_logs(counts, known)), _FOUND))
    words = asked.filter("h is not null").select("row", "at", "h").join(counts.select("h", "c").hint("shuffle_merge"), "h").select("row", "at", "c")
    # a slice's words meet again, so that a text's sum leaves one task as one row
    more = words.repartition("row").sortWithinPartitions("row").mapInArrow(_added, "row long, more double")
    found = asked.filter("h is null").join(more, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    return found.select(
        F.col("doc_id").alias(key), "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.exp(-F.col("log_prob") / F.col("n_tokens"))).alias("perplexity")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(spark.read.parquet(f"{sf_dir}/documents.parquet"))

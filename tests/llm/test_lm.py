"""The language model learns from every token."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from driftwell.llm import pseudo_likelihood


def test_every_token_is_a_target(spark):
    texts = [(i, " ".join(["one", "two", "three", "four", "five"][: i % 6]), 1) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string, n long").select("doc_id", "text").repartition(3)
    run = pseudo_likelihood._trained(pseudo_likelihood.Network().flat, pseudo_likelihood.vocabulary(df))
    copies = df.mapInArrow(run, "copy long, weight double, net binary").collect()
    assert sum(r["weight"] for r in copies) == sum(len(t.split()) for _, t, _ in texts) == 150


def test_words_in_buckets_count_by_their_own_frequency(spark):
    rng = random.Random(3)
    words = [f"wort{i}ü" for i in range(3000)]
    texts = [(i % 50 if i % 7 else None, " ".join(rng.choices(words, [1 / (k + 9) for k in range(3000)], k=rng.randrange(80)))) for i in range(200)]
    df = spark.createDataFrame([*texts, (1, None), (1, "neu " * 3)], "doc_id long, text string").repartition(3)
    known = pseudo_likelihood.vocabulary(df)
    counts = Counter(w for r in df.collect() for w in (r["text"] or "").split())
    buckets = Counter()
    for w, c in counts.items():
        if w not in known:
            buckets[zlib.crc32(w.encode()) % pseudo_likelihood.OTHERS] += c
    assert len(known) == pseudo_likelihood.KNOWN < len(counts)
    net = pseudo_likelihood.train(df, known)
    # the network's scores with the texts at hand
    plain = df.selectExpr("xxhash64(doc_id, text) id", "text").mapInArrow(pseudo_likelihood._scored(net.flat, known), "id long, n long, s double").collect()
    by_id = {r["id"]: r["s"] for r in plain}
    want = []
    for r in df.selectExpr("doc_id", "text", "xxhash64(doc_id, text) id").collect():
        others = [w for w in (r["text"] or "").split() if w not in known]
        share = sum(math.log(counts[w] / buckets[zlib.crc32(w.encode()) % pseudo_likelihood.OTHERS]) for w in others)
        want.append((r["doc_id"] or -1, len((r["text"] or "").split()), by_id[r["id"]] + share))
    got = [(r["doc_id"] or -1, r["n_tokens"], r["log_prob"]) for r in pseudo_likelihood.pseudo_likelihood(df).collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-3, abs=1e-3)


def test_a_step_follows_the_gradient_of_the_loss():
    """Against plain sums over the positions, one after the other."""
    p = pseudo_likelihood
    rng = np.random.default_rng(5)
    target = np.sort(rng.integers(0, p.VOCABULARY, 300)).astype(np.int16)
    context = rng.integers(0, 40, (2 * p.WINDOW, 300)).astype(np.int16)
    net, plain = p.Network(), p.Network()
    group, inner = np.divmod(target, p._PER_CLASS)
    scores = net.log_prob(context, target)
    d_hidden = np.zeros((300, p.HIDDEN))
    d_top, d_low = np.zeros(plain.top.shape), np.zeros(plain.low.shape)
    for i in range(300):
        h = np.tanh(sum(plain.tables[j][context[j, i]] for j in range(len(context))) + plain.bias).astype(np.float64)
        a, b = h @ plain.top + plain.top_bias, h @ plain.low[group[i]] + plain.low_bias[group[i]]
        a, b = np.exp(a) / np.exp(a).sum(), np.exp(b) / np.exp(b).sum()
        assert scores[i] == pytest.approx(math.log(a[group[i]] * b[inner[i]]), abs=1e-4)
        a[group[i]] -= 1
        b[inner[i]] -= 1
        d_top += np.outer(h, a)
        d_low[group[i]] += np.outer(h, b)
        d_hidden[i] = (plain.top @ a + plain.low[group[i]] @ b) * (1 - h * h)
    rate = 0.3
    net.step(context, target, rate)
    assert np.allclose(net.top, plain.top - rate / 300 * d_top, atol=1e-5)
    assert np.allclose(net.low, plain.low - rate / 300 * p.CLASSES * d_low, atol=1e-5)
    assert np.allclose(net.bias, plain.bias - rate / 300 * d_hidden.sum(0), atol=1e-5)
    for j in range(len(context)):
        for word in range(45):
            at = np.flatnonzero(context[j] == word)
            moved = rate / 4 / math.sqrt(300 * max(len(at), 1)) * d_hidden[at].sum(0)
            assert np.allclose(net.tables[j][word], plain.tables[j][word] - moved, atol=1e-5)


def test_one_row_leaves_for_each_text(spark):
    words = [f"w{i}" for i in range(2500)]
    texts = [(i, " ".join(words[(i * 37 + j) % 2500] for j in range(i % 90))) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    p = pseudo_likelihood
    counts = p.word_counts(df)
    known = p.vocabulary(df, counts=counts)
    asked = df.mapInArrow(p._asked(p.Network().flat, known, p._bucket_logs(counts, known)), p._FOUND)
    found = asked.filter("h is not null").select("row", "at", "h").join(counts.select("h", "c"), "h").select("row", "at", "c")
    more = found.repartition("row").sortWithinPartitions("row").mapInArrow(p._added, "row long, more double").collect()
    assert len(more) == len({r["row"] for r in more})
    assert len(more) == sum(any(w not in known for w in t.split()) for _, t in texts)

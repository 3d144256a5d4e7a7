"""Joins and spans against plain versions, with nulls, empty and short texts, repeats, ties and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from driftwell.llm import jaccard, substrings
from driftwell.llm.shared import connected

SCHEMA = "doc_id long, text string, n long, rep string, path string"
WS = "[\x20\x09-\x0d]+"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", None) for i, t in texts], SCHEMA)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(40)]
    base = [[rng.choice(words) for _ in range(rng.randint(20, 160))] for _ in range(8)]
    out = []
    for i in range(n):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            b[rng.randrange(len(b))] = rng.choice(words)
        if rng.random() < 0.3:
            b = [rng.choice(words) for _ in range(30)] + b
        out.append((i * 3 % 101, " ".join(b)))
    return [*out, (200, None), (201, ""), (202, " \n "), (203, "one two"), (204, "One\ttwo"), (205, "ein zwei drei vier fünf")]


def plain_sets(texts):
    sets = {}
    for i, t in texts:
        w = [x for x in re.split(WS, lower(t or "")) if x]
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return sets


def plain_components(sets):
    comp = {i: i for i in sets}
    ids = sorted(sets)

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                comp[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_plain_version(spark, seed):
    texts = corpus(seed)
    sets = plain_sets(texts)
    want = {(i, len(sets[i]), c) for i, c in plain_components(sets).items()}
    got = {tuple(r) for r in jaccard.jaccard_components(frame(spark, texts)).collect()}
    assert got == want


def test_repeated_and_null_ids_in_pairs(spark):
    texts = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, None), (3, "x")]
    got = {tuple(r) for r in jaccard.jaccard_components(frame(spark, texts)).collect()}
    assert got == {(1, 2, 1), (2, 2, 1), (3, 1, 3)}


def test_empty_tables(spark):
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0
    assert substrings.kept_digests(frame(spark, [])).count() == 0


def test_tiles_split_into_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_ROWS", 3)
    texts = corpus(5)
    want = plain_components(plain_sets(texts))
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(frame(spark, texts)).collect()} == want


def test_connected_takes_the_least_node(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 45), (7, 7)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 40: 40, 45: 40, 50: 40}


def plain_cut(texts, width=50):
    words = {i: [x for x in re.split(WS, t or "") if x] for i, t in texts}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][j : j + width]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < i:
                gone.update(range(j, j + width))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_cut_matches_plain_version(spark, seed):
    rng = random.Random(seed)
    texts = corpus(seed) + [(300, " ".join(["loop"] * 200)), (301, "x " + " ".join(["loop"] * 120)), (302, " ".join(["a", "b"] * 70))]
    spans = [" ".join("s%d" % rng.randrange(300) for _ in range(n)) for n in (50, 51, 75, 130)]
    for i in range(310, 330):
        texts.append((i, " ".join(["p%d" % rng.randrange(9) for _ in range(rng.randrange(5))] + rng.sample(spans, 2) + [rng.choice(spans)])))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.kept_digests(frame(spark, texts)).collect()}
    assert got == plain_cut(texts)


def test_texts_that_lose_nothing_stay_to_the_letter(spark):
    span = " ".join("s%d" % i for i in range(60))
    texts = [(1, "A  b\n" + span), (2, span + "\n\tend  x"), (3, "Keep \n this"), (4, None)]
    got = {r["doc_id"]: r["text"] for r in substrings.without_repeats(frame(spark, texts)).collect()}
    assert got == {1: "A  b\n" + span, 2: "end x", 3: "Keep \n this", 4: None}
    assert substrings.without_repeats(frame(spark, texts)).columns == ["doc_id", "text", "n", "rep", "path"]


def test_very_long_word_and_text(spark):
    long = "x" * 9000
    texts = [(1, long + " " + " ".join(str(i) for i in range(30000))), (2, long + " " + " ".join(str(i) for i in range(30000)))]
    row = substrings.kept_digests(frame(spark, texts)).filter(F.col("doc_id") == 2).first()
    assert (row["n_words"], row["n_removed"]) == (30001, 30001)


def test_members_of_hot_and_small_classes(spark):
    # 1,500 copies of one class, 1,500 classes of one text each, one class of two
    likely = spark.range(3002).selectExpr(
        "id AS doc_id",
        "CASE WHEN id < 1500 THEN 0 WHEN id < 3000 THEN id ELSE -1 END AS s1",
        "7L AS s2",
        "9L AS n",
    )
    classes = likely.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("component"), F.count("*").alias("copies"))
    found = {r["doc_id"]: r["component"] for r in jaccard._members(likely, classes).collect()}
    assert found == {i: 0 if i < 1500 else min(i, 3000) for i in range(3002)}
    assert not jaccard._members(likely.limit(0), classes.limit(0)).collect()

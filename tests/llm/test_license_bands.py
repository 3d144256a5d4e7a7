"""License scan: bands against a plain version on texts with repeated and moved pieces of templates, and long texts."""

from __future__ import annotations

import random
import time

from driftwell.llm import licenses


def plain(text: str) -> dict[str, float]:
    """Label: greatest share of a long template's words proved within GAP + 1 neighbouring diagonals."""
    words, k, out = text.split(), licenses.LONG_K, {}
    for label, template in licenses.TEMPLATES:
        t = template.split()
        if len(t) < licenses._LONG_WORDS:
            continue
        lines = {}
        for i in range(len(words) - k + 1):
            for j in range(len(t) - k + 1):
                if words[i : i + k] == t[j : j + k]:
                    lines.setdefault(i - j, set()).update(range(j, j + k))
        for line in lines:
            proved = set().union(*(v for other, v in lines.items() if line <= other <= line + licenses.GAP))
            if len(proved) / len(t) >= licenses.SHARE:
                out[label] = max(out.get(label, 0), len(proved) / len(t))
    return out


def test_bands_match_plain_version(spark):
    rng = random.Random(3)
    long = [t.split() for _, t in licenses.TEMPLATES if len(t.split()) >= licenses._LONG_WORDS]
    texts = ["copies of the software x " * 30, "you may obtain a copy of the license at " * 9, " ".join(w for t in long for w in t)]
    for _ in range(60):
        out = []
        for _ in range(rng.randint(1, 4)):
            t = list(rng.choice(long))
            for _ in range(rng.randint(0, 6)):
                at, n = rng.randrange(len(t)), rng.randint(1, 4)
                t[at : at + n] = rng.choice([[], ["zz"], ["zz"] * 4, t[at : at + n] * 2, t[:n]])
            out += t + ["qq"] * rng.randint(0, 3)
        texts.append(" ".join(out))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert found[0]["labels"] == "" and found[0]["score"] == 0
    several = 0
    for i, text in enumerate(texts):
        expected = plain(text)
        labels = set(found[i]["labels"].split(",")) - {""}
        assert set(expected) <= labels
        assert {x for x in labels if x == "mit" or x == "isc" or x == "unlicense"} == {x for x in expected if x in ("mit", "isc", "unlicense")}
        if expected and found[i]["score"] < 1:
            assert abs(found[i]["score"] - max(expected.values())) < 1e-12
            several += 1
    assert several > 5


def test_time_is_linear_in_the_length(spark):
    rng = random.Random(1)
    words = ["mit", "license", "software", "copies", "of", "the", *("w%d" % i for i in range(500))]

    def seconds(n):
        df = spark.createDataFrame([(1, " ".join(rng.choices(words, k=n)))], "doc_id long, text string")
        start = time.time()
        assert licenses.scan(df).collect()[0]["n_words"] == n
        return time.time() - start

    seconds(20_000)
    assert seconds(320_000) < 6 * seconds(80_000)

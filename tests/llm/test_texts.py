"""Operators on single texts, pages and vectors against plain versions."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from driftwell.llm import bpe, decontamination, html, language, licenses, pseudo_likelihood, topk, warc

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", "   \n\n x", "a" * 3000, "日本語テキスト🎉🎉", "'s 'll don't!!!???" * 30, "   é\r\n\r\n", "0123456789" * 50, "<|endoftext|>", " " * 300]


def docs(spark, texts, extra=", n_words long, ids string"):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string" + extra)


# ---- byte-level BPE


def test_encoding_matches_library(spark):
    rng = random.Random(1)
    alphabet = " \n\t'  stmdrevllaB1é٣，!?\x1c\x85日🎉''"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    rows = list(enumerate(texts)) + [(None, "x"), (0, "again")]
    got = bpe.encoded(docs(spark, rows), PATH, public_tokenizers.PATTERN, ids=True).collect()
    assert len(got) == len(rows)
    for r, (i, t) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"])), sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, len(own.encode_ordinary(x[1] or "")))), strict=True):
        ids = own.encode_ordinary(t or "")
        assert (r["doc_id"], r["ids"], r["n_tokens"]) == (i, ids, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_transducer_alone_settles_long_pieces():
    machine = bpe.Transducer(bpe.read_ranks(PATH))
    own = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=machine.ranks, special_tokens={})
    rng = random.Random(2)
    for piece in ["ab" * 9000, "".join(rng.choice("abcdeé ") for _ in range(12000))]:
        assert machine.encode(piece.encode()) == own.encode_ordinary(piece)


def test_stream_decodes_any_cut():
    rng = random.Random(3)
    data = "aé日🎉".encode() * 5 + b"\xff\xe6\x97" + b"ok" + b"\xf0\x9f"
    for _ in range(200):
        stream, at, out = bpe.Utf8Stream(), 0, ""
        while at < len(data):
            step = rng.randint(1, 5)
            out += stream.feed(data[at : at + step])
            at += step
        assert out + stream.close() == data.decode("utf-8", "replace")


# ---- licenses


def test_license_places_and_labels(spark):
    mit = dict(t for t in licenses.TEMPLATES if t[0] == "mit")["mit"]
    part = mit.split()
    texts = [
        (1, "MIT License, mit-license; MIT licenses. Licensed under CC BY-NC 4.0"), (2, None), (3, ""), (4, "nothing here"),
        (5, "x " + " ".join(part[:12] + ["ODD", "words"] + part[12:40])), (6, " ".join(part[:6])), (6, "gnu general public license"),
    ]
    rows = licenses.scan(docs(spark, texts)).collect()
    got = {(r["doc_id"], r["n_words"]): r for r in rows}
    assert len(rows) == 7
    r = got[1, 13]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == (3, 0, 8, "cc-by,mit", "cc-by,cc-by-nc,mit", 1.0)
    assert tuple(got[2, 0])[2:] == (0, None, None, "", "", 0.0) == tuple(got[3, 0])[2:]
    assert got[4, 2]["labels"] == ""
    assert got[5, 43]["labels"] == "mit" and got[5, 43]["n_base"] == 0 and 0.6 <= got[5, 43]["score"] < 1
    assert got[6, 6]["labels"] == "" and got[6, 4]["labels"] == "gpl"
    assert licenses.scan(docs(spark, [])).count() == 0


# ---- language


def test_language_held_out_accuracy(spark):
    rng = random.Random(4)
    parts = {"xx": ["sha", "ti", "on", "er"], "yy": ["çe", "ou", "é", "aux"], "zz": ["pf", "ge", "ü", "sch"]}
    rows = [(i, " ".join("".join(rng.choices(parts[c], k=3)) for _ in range(30)), c) for i, c in enumerate(list(parts) * 60)]
    odd = [(900, None, "xx"), (901, "", "xx"), (902, "123 --", None), (None, "shation erti", None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    found = language.identified(df).collect()
    got = {r["doc_id"]: r for r in found}
    assert len(found) == 184 and all(0 <= r["score"] <= 1 for r in found)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[None]["lang_pred"] == "xx"
    held = [(r["lang_pred"], c) for i, _, c in rows for r in [got[i]] if r["held_out"]]
    assert len(held) > 30 and sum(a == b for a, b in held) / len(held) >= 0.95
    assert {r["lang_pred"] for r in language.identified(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identified(df.limit(0)).count() == 0
    kept = language.known_language(df)
    assert kept.columns == df.columns and kept.count() == 181


# ---- decontamination


def test_reparameterised_items_are_found(spark):
    item = "A farmer sells 12 crates of apples at 3 dollars each to Maria and then Maria gives 12 crates to a school near the river."
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (None, item)], "item_id long, text string")
    same = item.replace("12", "77.5").replace("3 dollars", "9 euros").replace("Maria", "Oleg")
    mixed = item.replace("12", "77", 1).replace("Maria", "Oleg", 1).replace("3 dollars", "9 euros")
    texts = [(10, "Before. " + item + " After."), (11, same), (12, mixed), (13, "A farmer walks by the river"), (14, None), (15, ""), (None, item)]
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.leaks(docs(spark, texts), items).collect()}
    assert set(got) == {(10, 1), (11, 1)}
    assert got[10, 1]["n_changed"] == 0 and got[11, 1]["n_changed"] >= 3
    assert decontamination.without_leaks(docs(spark, texts), items).count() == 5
    assert decontamination.leaks(docs(spark, []), items).count() == 0
    assert decontamination.leaks(docs(spark, texts), items.limit(0)).count() == 0


# ---- language model


def test_network_prefers_the_order_it_was_trained_on(spark):
    rng = random.Random(5)
    cycle = ["a", "b", "c", "d", "e", "f"]
    rows = []
    for i in range(300):
        at = rng.randrange(6)
        rows.append((i, " ".join(cycle[(at + j) % 6] for j in range(400))))
    df = docs(spark, rows).repartition(4)
    known = pseudo_likelihood.vocabulary(df)
    assert len(known) == 6
    net = pseudo_likelihood.train(df.select("doc_id", "text"), known)
    line, mixed = rows[0][1], " ".join(rng.sample(rows[0][1].split(), 400))
    both = docs(spark, [(1, line), (2, mixed), (3, None), (4, " \n")]).select("doc_id", "text")
    got = {r[0]: r for r in both.mapInArrow(pseudo_likelihood._scored(net.flat, known), "doc_id long, n_tokens long, log_prob double").collect()}
    assert got[1]["log_prob"] > got[2]["log_prob"] + 20
    assert got[3][1:] == (0, 0.0) == got[4][1:]
    assert {r["perplexity"] for r in pseudo_likelihood.pseudo_likelihood(docs(spark, [(1, None), (None, "")])).collect()} == {None}
    assert pseudo_likelihood.pseudo_likelihood(docs(spark, [])).count() == 0


def test_steps_follow_the_gradient():
    net = pseudo_likelihood.Network()
    rng = np.random.default_rng(6)
    target = rng.integers(0, 50, 512)
    context = np.stack([target + 1, target, target, target])
    before = net.log_prob(context, target).mean()
    for _ in range(30):
        net.step(context, target, 0.3)
    assert net.log_prob(context, target).mean() > before + 1


# ---- search


def test_topk_with_ties_repeats_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 16)
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 64]) for i in range(90)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 4), (220, []), (None, [1.0] * 4), (5, [0.5] * 4), (221, [1.0, float("inf")])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.exact_topk(topk.quantised(df), F.col("vec_id") % 20 == 0, k=7).collect()]
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in [x for x in good if x[0] % 20 == 0]:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q)[:7]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    assert sorted(got) == sorted(want)
    assert topk.exact_topk(topk.quantised(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


# ---- pages

PAGES = "page_id long, url string, html string, text string"


def test_marked_article(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><p>menu</nav><div class='ad'>buy</div>"
        "<article><h1>Head &amp; line</h1><script>var t='</p>';</script><p>One\n two<br>three <b>bold</b><p>Four<div class=\"comments\"><p>me too</div>"
        "<form>mail</form></article><footer>f</footer>"
    )
    rows = [(1, "http://a.example/x", page, "c"), (2, None, None, "c"), (3, "odd", "", "c"), (None, "u", "<p>bare &lt;text", "c"), (1, "http://a.example/x", page, "c")]
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html.main_text(spark.createDataFrame(rows, PAGES)).collect()), key=str)
    text = "Head & line\n\nOne two three bold\n\nFour"
    assert got == sorted([(1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "", 0), (None, "bare <text", 10)], key=str)
    assert html.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_repeats_of_a_host_go_where_no_article_is_marked(spark):
    notice = "this site keeps a small file on your machine so that it works"
    rows = [(i, f"http://h.example/{i}", f"<body><p>{notice}</p><p>page {i} has words of its own number {i} {i * i}</p><p>Home</p></body>", "") for i in range(6)]
    rows.append((9, "http://other.example/", f"<p>{notice}</p>", ""))
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[3] == "page 3 has words of its own number 3 9" and got[9] == notice


def test_covered_matches_plain_runs():
    rng = random.Random(8)
    pages = [[" ".join(rng.choice("abc") for _ in range(rng.randint(1, 20))) for _ in range(4)] for _ in range(12)]
    run = 5
    seen: dict = {}
    for i, blocks in enumerate(pages):
        for b in blocks:
            w = b.split()
            for g in {tuple(w[j : j + run]) for j in range(len(w) - run + 1)} if len(w) >= run else {b}:
                seen.setdefault(g, set()).add(i)
    for got, blocks in zip(html.covered(pages, run), pages, strict=True):
        for share, b in zip(got, blocks, strict=True):
            w = b.split()
            if len(w) < run:
                assert share == float(len(seen[b]) > 1)
                continue
            on = set()
            for j in range(len(w) - run + 1):
                if len(seen[tuple(w[j : j + run])]) > 1:
                    on.update(range(j, j + run))
            assert share == pytest.approx(len(on) / len(w))


def test_warc_round_trip(spark):
    long = "<p>" + "é" * 80
    rows = [(3, "http://a/\r\nX: y", long, "t"), (1, "http://b/é", long, "t"), (2, None, "short", "t"), (4, "u", "short", "t"), (5, "u", None, "t"), (6, "u", "", "t"), (None, "u", long, "t"), (7, "u", "x\r\n\r\n" * 50, "t")]
    index, folder = warc.write_archives(spark.createDataFrame(rows, PAGES))
    assert index.count() == 8
    got = {(r["page_id"], r["url"]): r for r in warc.read_archives(index, folder).collect()}
    for i, url, page, _ in rows:
        r, payload = got[i, url], (page or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 1) if i == 3 else ("response", None))
        assert bytes(r["payload"]) == (b"" if i == 3 else payload)
    some = warc.read_archives(index.filter("page_id in (2, 7)"), folder).collect()
    assert {r["page_id"] for r in some} == {2, 7}
    empty, at = warc.write_archives(spark.createDataFrame([], PAGES))
    assert warc.read_archives(empty, at).count() == 0


def test_reads_take_neighbours_together(monkeypatch):
    monkeypatch.setattr(warc, "GAP_BYTES", 10)
    monkeypatch.setattr(warc, "RUN_BYTES", 100)
    assert list(warc._runs([(200, 20), (0, 30), (35, 10), (50, 60)])) == [(0, 45, [1, 2]), (50, 60, [3]), (200, 20, [0])]

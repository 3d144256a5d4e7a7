"""Boilerplate of a host goes however many shards its pages are dealt to."""

from __future__ import annotations

import random
import re
from pathlib import Path

from driftwell.llm import html


def test_repeats_across_shards_go(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    banners = [text(12) for _ in range(20)]
    own = [text(30) for _ in range(40)]
    pages = [(i if i % 9 else None, "http://big.example/x", f"<body><p>{own[i]}</p><p>{banners[i // 2]}</p><p>Kurz {i % 20}</p></body>") for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    whole = sorted(r["text"] for r in html.main_text(df).collect())
    assert whole == sorted(own)
    monkeypatch.setattr(html, "SHARD_PAGES", 3)
    assert sorted(r["text"] for r in html.main_text(df).collect()) == whole


def test_pages_are_shuffled_once_and_written_packed(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    pages = [(i, f"http://h{i % 7}.example/x", "<body>" + "".join(f"<p>{' '.join(rng.choices(words, k=30))}</p>" for _ in range(40)) + "</body>") for i in range(60)]
    written = []
    cut = html.cut_lineage
    monkeypatch.setattr(html, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        judged = html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string"))
        plan = judged._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    physical = plan[plan.index("== Physical Plan ==") :]
    assert not re.search(r"SortMergeJoin \[host#\d+L?\], \[host#\d+L?\]", physical)  # no second shuffle of the pages by host
    parts = Path(written[0].inputFiles()[0].removeprefix("file:")).parent.glob("*.parquet")
    assert sum(f.stat().st_size for f in parts) < 0.6 * sum(len(p[2]) for p in pages)
    assert sorted(r["text"] for r in judged.collect()) == sorted("\n\n".join(re.findall(r"<p>(.*?)</p>", p[2])) for p in pages)


def test_packed_blocks_come_back():
    for blocks in ([], ["a"], ["one two", "\u00e4\u2028x \U0001f600", "\x00"]):
        assert html._unpacked(html._packed(blocks)) == blocks

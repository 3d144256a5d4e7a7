"""Which blocks of a page are its article: markup, class names as hints, repeats of the host."""

from __future__ import annotations

import random
import time

import pytest

from driftwell.llm import html

PAGES = "page_id long, url string, html string"


def texts(spark, pages, url="https://one.example/p"):
    rows = [(i, url, page) for i, page in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, PAGES)).collect()}


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<main><p>Story</p></main><aside><article><p>Teaser</p></article></aside>", "Story"),
        ("<aside><article><p>Teaser</p></article></aside><main><p>Story</p></main>", "Story"),
        ("<article><p>Story</p></article><section class='comments'><article><p>A reader</p></article></section>", "Story"),
        ("<article><p>Story</p><article class='comment'><p>A reader</p></article></article>", "Story"),
        ("<article><p class='share-price'>Shares fell.</p><div class='search-results'><p>Two finds.</p></div></article>", "Shares fell.\n\nTwo finds."),
        ("<main><div class='page-with-sidebar'><p>Story</p></div></main>", "Story"),
        ("<body><div class='layout has-sidebar'><p>Story</p></div></body>", "Story"),
        ("<nav><ul><li>Home<li>News</ul><article><p>Story</p></article>", "Story"),
        ("<nav><ul><li>Home<li>News</ul><p>A story of some nine words that stands alone here</p>", "A story of some nine words that stands alone here"),
        ("<div class='sponsored'><article><p>Story</p></article></div>", "Story"),
        ("<p class='ad'>Buy<p>Story</p><div class='site-footer'>Foot</div>", "Story"),
        ("<article><header><h1>Head</h1></header><p>Story &amp; more<br>line</p><form><p>Mail</p></form></article><p>Outside</p>", "Head\n\nStory & more line"),
        ("<body></body>", ""),
        (None, ""),
    ],
)
def test_one_page(spark, page, expected):
    assert texts(spark, [page])[0] == expected


def test_hints_in_articles_go_where_the_host_repeats_them(spark):
    promo = "<p class='share-this'>Tell all of your many friends about this fine site today</p>"
    pages = [f"<article><p>Story {i} begins</p>{promo}<p class='share-price'>Shares of number {i} fell {i} in the hundred</p></article>" for i in range(4)]
    for i, text in texts(spark, pages).items():
        assert text == f"Story {i} begins\n\nShares of number {i} fell {i} in the hundred"


def test_articles_copied_between_pages_stay(spark):
    copied = "<article>" + "".join(f"<p>Words of paragraph {i} that two pages of this host have in common</p>" for i in range(5)) + "</article>"
    got = texts(spark, [copied, copied, "<p>Words of paragraph 3 that two pages of this host have in common</p>"])
    assert got[0] == got[1] and got[0].count("\n\n") == 4
    assert got[2].startswith("Words of paragraph 3")  # articles are no witnesses of boilerplate


def test_planted_articles_of_unmarked_hosts_are_found(spark):
    """Recall and precision over words, where repeats alone decide."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    hosts = [[line(14) for _ in range(4)] for _ in range(5)]
    rows, truth = [], {}
    for i in range(150):
        top, side, notice, foot = hosts[i % 5]
        story = [line(rng.randrange(10, 60)) for _ in range(rng.randrange(1, 6))]
        truth[i] = story
        body = "".join(f"<p>{s}</p>" for s in story)
        rows.append((i, f"http://h{i % 5}.example/{i}", f"<div>{top}</div><div>{notice}</div>{body}<ul><li>{side}</li></ul><div>{foot}</div>"))
    got = {r["page_id"]: r["text"].split("\n\n") for r in html.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    right = sum(len(set(got[i]) & set(truth[i])) for i in truth)
    assert right / sum(map(len, truth.values())) > 0.99 and right / sum(map(len, got.values())) > 0.99


def test_long_broken_pages_take_linear_time():
    start = time.process_time()
    html.blocks_of("<div class='ad'><p class=ad>" * 60000 + "x" + "<li class='menu'><b>" * 60000)
    assert time.process_time() - start < 20


def test_every_page_goes_through_the_host_streams(spark, monkeypatch):
    """Pages that mark their article too: their text comes out of the stage that holds the host's suffix array."""
    judged = html.main_text(spark.createDataFrame([(i, "https://one.example/p", f"<nav>Home</nav><article><p>Story {i}</p></article>") for i in range(3)], PAGES))
    plan = judged._jdf.queryExecution().analyzed().toString()
    assert "Union" in plan and plan.split("\n")[1].lstrip("+- ").startswith("MapInArrow _unique_runs")
    assert {r["text"] for r in judged.collect()} == {"Story 0", "Story 1", "Story 2"}


def test_article_blocks_are_measured_but_tell_nothing():
    line = "one two three four five six seven eight nine"
    pages = [[line, "own words of this page alone stand here now"], [line], ["other words that no page but this one has here"]]
    parts = html.covered(pages, witness=[[False, True], [False], [True]])
    assert [list(p) for p in parts] == [[0.0, 0.0], [0.0], [0.0]]
    parts = html.covered([*pages, [line], [line]], witness=[[False, True], [False], [True], [True], [True]])
    assert [list(p) for p in parts] == [[1.0, 0.0], [1.0], [0.0], [1.0], [1.0]]

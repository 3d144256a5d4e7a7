"""Exact copies of short items and of items made mostly of numbers and names are found."""

from __future__ import annotations

from driftwell.llm import decontamination


def test_exact_copies_are_found(spark):
    items = spark.createDataFrame(
        [(1, "Who wrote Hamlet?"), (2, "Sort 5 3 9 1 7 2 8 4 6 11 12"), (3, "Name: Anna Bert Carl Dora Emil Fritz Gerd Hans Ida"), (4, "What is the capital of France?")],
        "item_id long, text string",
    )
    texts = [
        (10, "A quiz asked: who wrote Hamlet? Nobody knew."),
        (11, "Who wrote Hamlet?"),
        (12, "Who wrote Macbeth? Hamlet was not."),
        (20, "now sort 5 3 9 1 7 2 8 4 6 11 12 please"),
        (21, "now sort 6 4 8 2 7 1 9 3 5 12 11 please"),
        (30, "Here. Name: Anna Bert Carl Dora Emil Fritz Gerd Hans Ida."),
        (40, "what is the capital of France"),
        (50, ""), (51, "wrote"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["share"] for r in decontamination.leaks(docs, items).collect()}
    assert got == {(10, 1): 1.0, (11, 1): 1.0, (20, 2): 1.0, (30, 3): 1.0, (40, 4): 1.0}
    assert {r["doc_id"] for r in decontamination.without_leaks(docs, items).collect()} == {12, 21, 50, 51}

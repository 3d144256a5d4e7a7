"""Registered queries against their SQL forms, and the pipeline against plain versions of its stages."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle_check import check, connect  # noqa: E402
from test_pairs import lower, plain_components, plain_cut, plain_sets  # noqa: E402,F401

import corpus_pipeline  # noqa: E402
from driftwell.llm.entry import QUERIES, SQL  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    problem, *_ = check(spark, connect(SF_DIR), name, QUERIES[name], SQL[name], SF_DIR)
    assert problem == ""


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = corpus_pipeline.known_language(spark, docs, SF_DIR)
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == {i for i, t in before.items() if any(c.isalpha() for c in t)}
    second = corpus_pipeline.near_duplicates(spark, docs, SF_DIR)
    assert second.columns == columns
    comps = plain_components(plain_sets(before.items()))
    assert {r["doc_id"] for r in second.collect()} == {i for i, c in comps.items() if i == c}
    third = corpus_pipeline.repeated_substrings(spark, docs, SF_DIR)
    assert third.columns == columns
    cut = plain_cut(before.items())
    for r in third.collect():
        assert (r["text"] == before[r["doc_id"]]) == (cut[r["doc_id"]][1] == 0)
    items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF_DIR}/benchmark.parquet'").fetchall()]
    fourth = {r["doc_id"] for r in corpus_pipeline.decontaminated(spark, docs, SF_DIR).collect()}
    assert not any(x in before[i] for i in fourth for x in items)
    assert set(before) - fourth == {i for i, t in before.items() if any(x in t for x in items)}


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < out.count() < 200

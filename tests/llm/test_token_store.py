"""Token store: shards against the tokenizer itself, the hash function, keyed access and odd inputs."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from tokenizers import Tokenizer

from driftwell.llm import token_store

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(rows):
    """{key: [(start, ids)]} of (key, text) in order of key, nulls last."""
    tokenizer, out, start = Tokenizer.from_file(PATH), {}, 0
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.setdefault(key, []).append((start, ids))
        start += len(ids)
    return out


def test_encode_is_the_tokenizer():
    texts = [
        "", " ", "Plain words, and 12 numbers!", "tabs\tand\x0blines\r\nmore\n\n", "non breaking  wide　blank\x85next",
        "café ́alone ẛ̣", "ab<|endoftext|>cd <|startoftext|>", "It's we'll THEY'VE 'd", "\x1cfile\x1dsep\x00nul",
        "x" * 5000 + " y " + "zé" * 3000, "\U0001f44b\U0001f3fd 日本語" * 30, "İstanbul ΣΣ", "word " * 2000,
    ]
    tokenizer = Tokenizer.from_file(PATH)
    for some in (texts, texts[::-1], [texts[0]], texts[8:9]):
        ids, counts = token_store.encode(PATH, pa.array(some), 1)
        whole = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in some]
        assert counts.tolist() == [len(w) for w in whole]
        assert ids.tolist() == [i for w in whole for i in w]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 20_000])
def test_hash_function_is_minimal_and_perfect(n):
    keys = np.unique(np.concatenate([np.arange(n // 2) * 7 - n, np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n - n // 2)]))
    words, bits = token_store.hash_function(keys)
    found = token_store.slots_of(keys, words, token_store._ranks(bits), bits)
    assert sorted(found.tolist()) == list(range(len(keys)))
    assert 64 * len(bits) <= 5 * len(keys) + 64 * 64


def test_absent_keys_are_never_found():
    keys = np.arange(0, 20_000, 2)
    entries = np.zeros(len(keys), token_store.SLOT)
    entries["mark"], entries["doc"] = token_store._mark(keys), keys
    words, ranks, bits, slots = token_store.unpacked_segment(token_store.packed_segment(keys, entries))
    asked = np.arange(-5, 20_005)
    at = token_store.slots_of(asked, words, ranks, bits)
    there = at >= 0
    there[there] = slots["mark"][at[there]] == token_store._mark(asked[there])
    assert asked[there].tolist() == keys.tolist()
    assert slots["doc"][at[there]].tolist() == keys.tolist()


def test_store_of_odd_rows(spark):
    rows = [(i * 3 - 20, f"text number {i} " * (i % 7)) for i in range(200)]
    rows += [(4, "again"), (4, "again"), (4, None), (None, "no key"), (None, None), (2**62, "last"), (-(2**63), "first")]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, place int, same string").repartition(5)
    store = token_store.write_store(df, PATH)
    got = store.read(store.lookup(df, "doc_id", strict=True).union(store.unkeyed())).collect()
    expected = plain(rows)
    assert len(got) == len(rows)
    order = sorted(got, key=lambda r: r.start)
    at = 0
    for r in order:
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert [r.key for r in order] == sorted((k for k, _ in rows if k is not None)) + [None, None]
    for key, docs in expected.items():
        assert sorted(r.ids for r in got if r.key == key) == sorted(ids for _, ids in docs)
        if key in (4, -(2**63), 2**62):
            assert sorted(x.tolist() for x in store.get(key)) == sorted(ids for _, ids in docs)
    assert store.get(5) == []
    absent = spark.createDataFrame([(5,), (4,), (4,), (None,)], "key long")
    assert [r.key for r in store.lookup(absent).collect()] == [4]
    with pytest.raises(Exception, match="not in the index"):
        store.lookup(absent, strict=True).collect()


def test_key_over_many_shards(spark):
    """A key that most rows share is cut into shards and read back whole."""
    rows = [(7, f"{i} {i * i}") for i in range(300)] + [(i, "x") for i in (1, 9, 8)]
    store = token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), PATH)
    place = {r.key: r for r in store.lookup(spark.createDataFrame(rows, "key long, t string")).collect()}
    assert place[7].docs == 300 and place[7].last > place[7].shard
    got = [r for r in store.read(store.lookup(spark.createDataFrame([(7,)], "key long"))).collect()]
    assert sorted(r.ids for r in got) == sorted(ids for _, ids in plain(rows)[7]) and len({r.start for r in got}) == 300
    assert len(store.get(7)) == 300


def test_empty_and_nothing_keyed(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    store = token_store.write_store(empty, PATH)
    assert store.read(store.lookup(empty, "doc_id").union(store.unkeyed())).count() == 0 and store.get(1) == []
    store = token_store.write_store(spark.createDataFrame([(None, "a b"), (None, "")], "doc_id long, text string"), PATH)
    assert store.lookup(empty, "doc_id").count() == 0
    assert sorted(r.n_tokens for r in store.read(store.unkeyed(), payload=False).collect()) == [1, 3]


def test_shard_bytes(spark):
    """The files are as the module describes them."""
    store = token_store.write_store(spark.createDataFrame([(2, "hello"), (1, "a b")], "doc_id long, text string").coalesce(1), PATH)
    raw = b""
    fs, base = pafs.FileSystem.from_uri(store.folder)
    for r in store.shards.orderBy("shard").collect():
        data = fs.open_input_file(f"{base}/{r['file']}").read()
        assert data[:4] == b"DWID" and np.frombuffer(data, "<u4", 4)[1:].tolist() == [1, 2, 0] and data[-8:] == b"DWID-END"
        raw += data[16 : 16 + 2 * r["ids"]]
    tokenizer = Tokenizer.from_file(PATH)
    assert np.frombuffer(raw, "<u2").tolist() == [*tokenizer.encode("a b").ids, 1, *tokenizer.encode("hello").ids, 1]

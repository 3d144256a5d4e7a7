"""What the operators share: one row per id, joins on id lists, lineage cuts, Arrow slices."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.session import cut_lineage

#: Id lists of at most this many rows (8 bytes each) are sent to all executors; longer ones are joined by a shuffle.
SENT_IDS = 500_000
#: Bytes of text that a Python task holds in its work arrays at once, unless one text is longer.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def one_row_per_id(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text), one row per key.

    Rows without a key cannot be named in a result and are left out. Of rows that share a key the greatest
    text counts (a null one only if there is no other). The texts are only shuffled if a key does repeat.
    """
    rows = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text)).filter(F.col(f"`{key}`").isNotNull())
    if rows.groupBy(key).count().filter("count > 1").limit(1).count() == 0:
        return rows
    return cut_lineage(rows.groupBy(key).agg(F.max(text).alias(text)))


def rows_of_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``ids`` (a written table); the list is broadcast only after a count of it."""
    small = ids.count() <= SENT_IDS
    return rows.join(F.broadcast(ids) if small else ids.hint("shuffle_merge"), key, "left_semi")


@cache
def _trim():
    """The C library's call that gives free memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return memory that nothing holds any more: Python workers live on from task to task and from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about ``size`` bytes of ``column`` (null: empty), never less than a row."""
    give_back()  # what the task before has left
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        full = pc.fill_null(batch.column(at), pa.scalar("", batch.column(at).type))
        batch = batch.set_column(at, column, full)
        lengths = pc.binary_length(full).to_pylist()
        first, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > size:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n + 16
        yield batch.slice(first)
    give_back()


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of ``key`` from batches sorted by it; several small runs share a table."""
    held: list[pa.RecordBatch] = []
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(key))
        last = col[batch.num_rows - 1].as_py()
        if held and col[0].as_py() == last and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() == last:
            held.append(batch)  # one run goes on through the whole batch
            continue
        cut = batch.num_rows - 1
        values = col.to_numpy(zero_copy_only=False)
        while cut > 0 and values[cut - 1] == last:
            cut -= 1
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held:
            before = held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py()
            if before != last:
                yield pa.Table.from_batches(held)
                held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
        held = []
    give_back()


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the smallest node that links lead to.

    Alternating large-star and small-star rounds: every round points nodes to the smallest neighbour known.
    Degrees are never gathered in a task: a minimum per node (map-side combined) is joined back to the edges.
    Each round is a written table, so a lost executor costs one round at most.
    """
    links = cut_lineage(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )

    def sign(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    known = sign(links)
    for _ in range(max_rounds):
        if not known[0]:
            break
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        links = cut_lineage(small.filter("a <> b").distinct())
        now = sign(links)
        if now == known:
            break
        known = now
    else:
        raise RuntimeError("components did not settle")
    return links.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )

"""WARC archives: write records, index them, read them back by coalesced byte ranges.

Tasks write archives of gzipped records (one member each) to the shared folder under names of their own, and
return one index row per record. The index is a written table, so only rows of tasks that ended well count: files
of lost or repeated attempts are in no index row and are never read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.shared import groups_of, partitions
from driftwell.session import cut_lineage, ensure_checkpoint_dir

#: Payloads shorter than this are always written out.
REVISIT_BYTES = 100
#: Bytes after which a task begins a new archive.
ARCHIVE_BYTES = 64 << 20
#: Ranges of one archive that are closer than this are read in one go, up to RUN_BYTES.
GAP_BYTES, RUN_BYTES = 64 << 10, 8 << 20
INDEX = "page_id long, url string, file string, at long, length long, digest string, record_type string"


def _member(head: list[str], payload: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    plain = ("\r\n".join(["WARC/1.1", *head]) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"
    return packer.compress(plain) + packer.flush()


def _line(value: str) -> str:
    """A header value on one line; a percent sign keeps what is replaced readable."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _archived(folder: str):
    def run(batches: Iterator[pa.RecordBatch]):
        fs, base = pafs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    payload = (r["html"] or "").encode()
                    digest, first = r["digest"], r["first_id"]
                    revisit = first is not None and first != r["page_id"]
                    kind = "revisit" if revisit else "response"
                    head = [f"WARC-Type: {kind}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
                    if r["page_id"] is not None:
                        head.append(f"WARC-Record-ID: <urn:page:{r['page_id']}>")
                    if r["url"] is not None:
                        head.append(f"WARC-Target-URI: {_line(r['url'])}")
                    if revisit:
                        head.append(f"WARC-Refers-To: <urn:page:{first}>")
                        payload = b""
                    head.append(f"Content-Length: {len(payload)}")
                    data = _member(head, payload)
                    out.write(data)
                    rows.append((r["page_id"], r["url"], name, at, len(data), digest, kind))
                    at += len(data)
                    if at > ARCHIVE_BYTES:
                        out.close()
                        out = None
                if rows:
                    cols = list(zip(*rows, strict=True))
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["page_id", "url", "file", "at", "length", "digest", "record_type"])
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> tuple[DataFrame, str]:
    """Write a record per row of ``pages``; return (index, folder).

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of REVISIT_BYTES or more the one
    with the smallest key is a response and the others revisit it; shorter payloads, and rows without a key, are
    responses. A row that repeats the smallest key is a response too. Index rows hold file, offset, length,
    url and digest.
    """
    spark = pages.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    raw = F.encode(F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(
        F.col(f"`{key}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.col(f"`{html}`").cast("string").alias("html"),
        F.sha2(raw, 256).alias("digest"),
        F.octet_length(raw).alias("size"),
    )
    # digests that repeat; a copy that thousands of pages have is one row per task before the shuffle
    firsts = (
        rows.filter(F.col("page_id").isNotNull() & (F.col("size") >= REVISIT_BYTES))
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("c"))
        .filter("c > 1")
        .select("digest", "first_id")
    )
    firsts = cut_lineage(firsts)
    marked = rows.join(firsts, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(F.col("page_id").isNotNull() & (F.col("size") >= REVISIT_BYTES), F.col("first_id")).alias("first_id")
    )
    return cut_lineage(marked.mapInArrow(_archived(folder), INDEX)), folder


def _runs(places: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """(offset, length, indices) of reads that take neighbouring ranges together."""
    order = sorted(range(len(places)), key=places.__getitem__)
    start, end, held = 0, 0, []
    for i in order:
        at, length = places[i]
        if held and (at - end > GAP_BYTES or at + length - start > RUN_BYTES):
            yield start, end - start, held
            held = []
        if not held:
            start, end = at, at
        held.append(i)
        end = max(end, at + length)
    if held:
        yield start, end - start, held


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    plain = zlib.decompress(data, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    found = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return found, rest[: int(found["Content-Length"])]


def _named(value: str | None) -> int | None:
    return None if value is None else int(value.rpartition(":")[2].rstrip(">"))


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _fetched(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]):
        fs, base = pafs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for t in groups_of(batches, "file"):
            index = t.to_pylist()
            by_file: dict[str, list[dict]] = {}
            for r in index:
                by_file.setdefault(r["file"], []).append(r)
            for name, rows in by_file.items():
                with fs.open_input_file(f"{base}/{name}") as f:
                    for start, length, held in _runs([(r["at"], r["length"]) for r in rows]):
                        data, out = f.read_at(length, start), []
                        for i in held:
                            at = rows[i]["at"] - start
                            head, payload = _headers(data[at : at + rows[i]["length"]])
                            kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                            if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"payload of {name} at {rows[i]['at']} does not fit its digest")
                            size = int(head["X-Payload-Length"]) if kind == "revisit" else len(payload)
                            out.append((_named(head.get("WARC-Record-ID")), rows[i]["url"], size, digest, kind, _named(head.get("WARC-Refers-To")), payload if payloads else None))
                        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of ``index`` (any selection of its rows), read by sorted byte ranges.

    Each archive belongs to one task; its ranges are sorted and neighbours are read together. Archives are of
    bounded size, so no task depends on how many records were written. Digests of responses are checked; a
    revisit has no payload of its own and gives the full payload's digest and length from its header.
    """
    return (
        index.select("file", "at", "length", "url")
        .repartition(partitions(index.sparkSession), "file")
        .sortWithinPartitions("file", "at")
        .mapInArrow(_fetched(folder, payloads), READ)
    )


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY 1)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON f.d = p.d AND n >= 100
"""


def query(spark, sf_dir: str) -> DataFrame:
    index, folder = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(index, folder, payloads=False).drop("payload", "url")

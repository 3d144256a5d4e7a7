"""Main text of web pages: host suffix arrays over the blocks of all pages, with marked articles as a check.

A page is read once, into blocks. Elements that are furniture by name (nav, footer, aside, form ...) or whose class, id or
role says so go whole, articles within them too. The token streams of all pages of a host are laid end to end and their
suffixes sorted as far as the length of a long run; runs that stand on distinct pages are boilerplate, blocks they cover go,
unique runs stay. The markup is checked after that: what stands in an article (or main) element is kept, repeated or not, and is no
witness against others; what a page with an article shows outside of it goes, but tells what repeats. So repeats alone
decide the blocks of a page that marks no article, blocks whose class only contains a furniture word (``share-price``), and what
follows furniture that is never closed.
Hosts are dealt in shards of bounded size, so one that owns a third of all pages is many tasks; runs that stand on
pages of several of its shards are found by a count of the runs' hashes and handed to each shard that has them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.shared import groups_of, partitions, slices
from driftwell.llm.words import U, hashed, roll, word_hashes
from driftwell.session import cut_lineage

#: Tokens of a long run, pages of a shard, part of a block that repeated runs must cover for it to go.
RUN, SHARD_PAGES, COVERED = 8, 2048, 0.5
_WHOLE = U(0x9B05688C2B3E6C1F)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|([^<]+|<)",
    re.S | re.I,
)
_BLOCKS = frozenset(
    "p div section article main ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 blockquote pre hr "
    "figure figcaption header footer nav aside form fieldset address details summary body html head".split()
)
_DROPPED = frozenset("nav footer aside form button select dialog menu head".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HINT = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
#: Words that name furniture in class, id and role attributes.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer "
    "header masthead menu menubar nav navbar navigation newsletter notice popup promo promotion related share sharing sidebar "
    "social sponsor sponsored subscribe widget toolbar disqus respond complementary contentinfo search".split()
)
#: Furniture words that own what the rest of a hyphenated name adds (comment-body, nav-item).
OWNERS = frozenset("ad ads advert adverts breadcrumb breadcrumbs comment comments cookie cookies footer nav navbar newsletter sidebar".split())
#: Parts of names that say what a layout has, not what it is (has-sidebar, page-with-sidebar).
LAYOUT = frozenset("has with no without layout".split())
#: Elements that a block after them ends, closed or not.
_IMPLIED = frozenset("p li dt dd td th tr option".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: What becomes of a block: it stays, the host's repeats decide, it goes (and is only a witness of repeats), it goes if repeated or short.
STAYS, OPEN, GOES, LOOSE = range(4)


def furniture(attributes: str) -> tuple[bool, bool]:
    """(the element is furniture, a name of it only contains a furniture word).

    A name counts whole, by its last part (site-footer) or by an owner as its first (comment-body); a name that tells of
    a layout counts for nothing."""
    hint = False
    for value in _HINT.findall(attributes):
        for name in value.strip("\"'").split():
            parts = [p.lower() for p in _PART.findall(name)]
            if not parts or LAYOUT.intersection(parts):
                continue
            if parts[-1] in FURNITURE or parts[0] in OWNERS:
                return True, False
            hint = hint or not FURNITURE.isdisjoint(parts)
    return False, hint


class _Page:
    """The tags and texts of a page; ``ends`` has the place where an element closes, -1 if it never does."""

    def __init__(self, html: str):
        self.parts: list[tuple[str, str, bool, str]] = []  # (name or "", text, closing, attributes)
        self.ends: list[int] = []
        unclosed: dict[str, list[int]] = {}
        for m in _TOKEN.finditer(html):
            text, name = m.group(5), m.group(3)
            if text is not None:
                self.parts.append(("", text, False, ""))
            elif name is not None:
                name, closing = name.lower(), m.group(2) == "/"
                if closing:
                    if unclosed.get(name):
                        self.ends[unclosed[name].pop()] = len(self.parts)
                elif name not in _VOID and not m.group(4).endswith("/"):
                    unclosed.setdefault(name, []).append(len(self.parts))
                self.parts.append((name, "", closing, m.group(4)))
            else:
                continue
            self.ends.append(-1)

    def implied_end(self, at: int) -> int:
        """Place of the block after ``at``, which ends a paragraph or item that is not closed."""
        at += 1
        while at < len(self.parts) and self.parts[at][0] not in _BLOCKS:
            at += 1
        return at

    def blocks(self, wrappers: bool) -> tuple[list[tuple[str, int]], bool]:
        """Blocks with what becomes of them, and whether an article is marked. ``wrappers``: class names do not make
        furniture of an element that holds an article."""
        out: list[tuple[str, int]] = []
        held: list[str] = []
        skip = article = hinted = -1  # places where furniture, the article and a hinted element end
        loose = marked = False
        articles = [i for i, (name, _, closing, _) in enumerate(self.parts) if name in ("article", "main") and not closing]
        after = np.searchsorted(articles, np.arange(len(self.parts) + 1)).tolist() if wrappers else []

        def close(at: int) -> None:
            if held:
                text = " ".join(unescape("".join(held)).split())
                held.clear()
                if text:
                    inside = at <= article
                    kind = OPEN if at <= hinted else LOOSE if loose and not inside else STAYS
                    out.append((text, kind if inside else kind + 4))

        for i, (name, text, closing, attributes) in enumerate(self.parts):
            if i < skip:
                continue
            if not name:
                held.append(text)
                continue
            if i == skip:
                skip = -1
                if name not in _BLOCKS and name not in _DROPPED:
                    continue
            end = self.ends[i]
            is_block = name in _BLOCKS or name in _DROPPED
            if is_block or name == "hr":
                close(i)
            elif name == "br":
                held.append(" ")
            if closing or name in _VOID:
                continue
            strong, hint = furniture(attributes) if attributes and name not in ("body", "html") else (False, False)
            if strong and wrappers and end > i and after[end] > after[i]:
                strong = False
            if name in _DROPPED or (name == "header" and i > article) or strong:
                if end > i:
                    skip = end
                elif name in _IMPLIED:
                    skip = self.implied_end(i)
                elif is_block:
                    loose = True
                continue
            if hint and end > i:
                hinted = max(hinted, end)
            if name in ("article", "main") and i > article:
                article, marked, loose = end if end > i else len(self.parts), True, False
        close(len(self.parts))
        return out, marked


def blocks_of(html: str) -> tuple[list[str], list[int]]:
    """Visible blocks of a page in their order, and what becomes of each."""
    page = _Page(html)
    found, marked = page.blocks(False)
    if not found:
        found, marked = page.blocks(True)
    marked = marked and any(kind < 4 for _, kind in found)

    def settled(kind: int) -> int:
        if kind < 4:
            return kind
        return GOES if marked else max(kind - 4, OPEN)

    return [text for text, _ in found], [settled(kind) for _, kind in found]


def _run_hashes(blocks: list[str], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the run at each place, places of runs within one block, block of each token, hash of each whole block)."""
    data, limits, _, _, block, words = hashed(pa.array(blocks, pa.string()), False)
    runs = roll(words, run)
    n = len(runs)
    return runs.view(np.int64), np.flatnonzero(block[:n] == block[len(block) - n :]), block, (word_hashes(data, limits[:-1], limits[1:]) ^ _WHOLE).view(np.int64)


def covered(
    pages: list[list[str]], run: int = RUN, known: np.ndarray | None = None, witness: list[list[bool]] | None = None
) -> list[np.ndarray]:
    """For each block of each page the part of its tokens that runs on several pages cover.

    ``known``: hashes of runs and short blocks (see ``_run_hashes``) that pages not given here have too.
    ``witness``: which blocks tell that a run stands on their page, all by default.

    The pages' tokens are laid end to end and the suffixes ranked by prefix doubling up to ``run`` tokens, which
    is a suffix array as deep as repeats matter. Shorter blocks count when they repeat whole.
    """
    numbers: dict[str, int] = {}
    tokens, owner, block, counts = [], [], [], []
    tells = [w for page in witness for w in page] if witness is not None else [True] * sum(map(len, pages))
    short: dict[str, set[int]] = {}
    for i, blocks in enumerate(pages):
        for b in blocks:
            words = b.split(" ")
            if len(words) < run:
                seen = short.setdefault(b, set())
                if tells[len(counts)]:
                    seen.add(i)
            tokens.extend(numbers.setdefault(w, len(numbers) + 1) for w in words)
            owner.extend([i] * len(words))
            block.extend([len(counts)] * len(words))
            counts.append(len(words))
    flags = np.zeros(len(tokens), bool)
    n = len(tokens) - run + 1
    elsewhere = np.zeros(len(counts), bool)
    if known is not None and len(known) and counts:
        hashes, _, _, wholes = _run_hashes([b for blocks in pages for b in blocks], run)
        elsewhere = np.isin(wholes, known)
    if n > 0:
        rank, page, piece = np.array(tokens, np.int64), np.array(owner), np.array(block)
        size = 1
        while size < run:
            step = min(size, run - size)  # the last round overlaps where run is no power of two
            pair = rank[: len(rank) - step] * (rank.max() + 1) + rank[step:]
            rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
            size += step
        whole = piece[:n] == piece[run - 1 :]
        starts = np.flatnonzero(whole)
        order = starts[np.lexsort((page[starts], rank[starts]))]
        r, p = rank[order], page[order]
        group = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.zeros(0, np.int64)
        if len(group):
            told = np.array(tells, bool)[piece[order]]
            low, high = np.where(told, p, len(pages)), np.where(told, p, -1)
            many = np.minimum.reduceat(low, group) < np.maximum.reduceat(high, group)
            if known is not None and len(known):
                many |= np.isin(hashes[order[group]], known)
            hits = order[np.repeat(many, np.diff(np.append(group, len(r))))]
            change = np.zeros(len(tokens) + 1, np.int64)
            np.add.at(change, hits, 1)
            np.add.at(change, hits + run, -1)
            flags = np.cumsum(change)[:-1] > 0
    out, at, k = [], 0, 0
    for blocks in pages:
        parts = []
        for b in blocks:
            size = counts[k]
            parts.append(float(len(short[b]) > 1 or elsewhere[k]) if size < run else flags[at : at + size].mean())
            at, k = at + size, k + 1
        out.append(np.array(parts))
    return out


def _packed(blocks: list[str]) -> bytes:
    """The blocks of a page, deflated: they are written once and shuffled once. No block has a line break in it."""
    return zlib.compress("\n".join(blocks).encode())


def _unpacked(data: bytes) -> list[str]:
    text = zlib.decompress(data).decode()
    return text.split("\n") if text else []


def _read(batches: Iterator[pa.RecordBatch]):
    """One row a page, numbered: its blocks, and what its markup says of them."""
    row = TaskContext.get().partitionId() << 33
    for batch in slices(batches, "html"):
        blocks, kinds = [], []
        for html in batch.column(2).to_pylist():
            found, become = blocks_of(html) if html else ([], [])
            blocks.append(_packed(found))
            kinds.append(become)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(row + np.arange(len(blocks))), batch.column(0), batch.column(1),
                pa.array(kinds, pa.list_(pa.int32())), pa.array(blocks, pa.binary()),
            ],
            names=["row", "page_id", "url", "kinds", "blocks"],
        )
        row += len(blocks)


def _kept(kinds: list[int], blocks: list[str], part: np.ndarray) -> str:
    """The text of a page; ``part``: how much of each block repeats on the host. The markup is the check that follows: a
    block of a marked article stays though it repeats (articles are copied whole), what stands outside of one goes."""
    out = []
    for kind, block, repeated in zip(kinds, blocks, part, strict=True):
        unique = repeated < COVERED and not (kind == LOOSE and block.count(" ") + 1 < RUN)
        if kind == STAYS or (kind != GOES and unique):
            out.append(block)
    return "\n\n".join(out)


def _runs(batches: Iterator[pa.RecordBatch]):
    """(host, shard, hash, row) of each run and short block that is no marked article's, once for a page."""
    for batch in batches:
        kinds = batch.column(4).to_pylist()
        pages = [[b for b, k in zip(blocks, kind, strict=True) if k != STAYS] for blocks, kind in zip(map(_unpacked, batch.column(3).to_pylist()), kinds, strict=True)]
        sizes = np.array([len(b) for b in pages], np.int64)
        if not sizes.sum():
            continue
        runs, at, block, wholes = _run_hashes([b for blocks in pages for b in blocks])
        short = np.bincount(block, minlength=len(wholes)) < RUN
        page = np.repeat(np.arange(len(pages)), sizes)
        values, owner = np.concatenate((runs[at], wholes[short])), np.concatenate((page[block[at]], page[short]))
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        first = np.ones(len(values), bool)
        first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        taken = pa.array(owner[first])
        for low in range(0, len(taken), 100_000):
            part = batch.take(taken[low : low + 100_000])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(values[first][low : low + 100_000]), part.column(2)], names=["host", "shard", "w", "row"])


def _unique_runs(batches: Iterator[pa.RecordBatch]):
    for t in groups_of(batches, "shard"):
        shard = t.column("shard").to_pylist()
        cuts = [i for i in range(len(shard)) if not i or shard[i] != shard[i - 1]] + [len(shard)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            whole = t.slice(low, high - low)
            pages = whole.filter(pc.is_null(whole.column("w"))).to_pylist()
            for r in pages:
                r["blocks"] = _unpacked(r["blocks"])
            known = whole.column("w").drop_null().to_numpy()
            parts = covered([r["blocks"] for r in pages], known=known, witness=[[k != STAYS for k in r["kinds"]] for r in pages])
            out = [(r["page_id"], r["url"], _kept(r["kinds"], r["blocks"], part)) for r, part in zip(pages, parts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages``.

    Character references are decoded, white space inside a block is one space, blocks are joined by an empty
    line; pages without text, empty or null html give "". Rows are independent but for the repeats on their
    host (a null or odd url: the host ""): null and repeated keys stay as rows of their own.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    schema = "row long, page_id long, url string, kinds array<int>, blocks binary"
    read = cut_lineage(rows.mapInArrow(_read, schema))
    streams = read.withColumn("host", host)
    sizes = read.groupBy(host.alias("host")).agg(F.ceil(F.count("*") / SHARD_PAGES).alias("shards"))
    width = partitions(pages.sparkSession)
    # only hosts of several shards are sent, at most one per SHARD_PAGES pages, so that the pages themselves are shuffled once
    large = F.broadcast(sizes.filter("shards > 1"))
    dealt = streams.join(large, "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    dealt = dealt.withColumn("shard", F.concat_ws(" ", "host", F.pmod(F.xxhash64("row"), F.col("shards"))))
    # hosts of several shards: each run once for a shard, then those that two pages have, back to the shards that have them
    runs = dealt.filter("shards > 1").select("host", "shard", "row", "blocks", "kinds").mapInArrow(_runs, "host string, shard string, w long, row long")
    by_shard = cut_lineage(runs.groupBy("host", "shard", "w").agg(F.min("row").alias("low"), F.max("row").alias("high")))
    repeated = by_shard.groupBy("host", "w").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("host", "w")
    known = by_shard.join(repeated, ["host", "w"]).selectExpr(
        "shard", "null AS page_id", "null AS url", "null AS kinds", "null AS blocks", "w"
    )
    judged = (
        dealt.select("shard", "page_id", "url", "kinds", "blocks", F.lit(None).cast("long").alias("w"))
        .union(known)
        .repartition(width, "shard")
        .sortWithinPartitions("shard", "page_id")
        .mapInArrow(_unique_runs, "page_id long, url string, text string")
    )
    return judged.select(F.col("page_id").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))


def query(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))

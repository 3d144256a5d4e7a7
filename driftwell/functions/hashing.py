"""Random draws as hashes of their keys.

A draw depends on nothing but its key, so a task that is run again on another
executor draws the same rows, and any SQL engine with ``md5`` can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_DIGITS = 13
HASH_SPAN = 16.0**HASH_DIGITS


def _as_column(part: Column | str | int) -> Column:
    return part if isinstance(part, Column) else F.lit(str(part))


def hash_key(*parts: Column | str | int) -> Column:
    """md5 (hex) of the parts joined by colons."""
    return F.md5(hash_text(*parts))


def hash_text(*parts: Column | str | int) -> Column:
    """The parts joined by colons, nulls left out."""
    return F.concat_ws(":", *[_as_column(p).cast("string") for p in parts])


def unit_draw(*parts: Column | str | int) -> Column:
    """Uniform double in [0, 1) made of the first 52 bits of the key's md5."""
    digits = F.substring(hash_key(*parts), 1, HASH_DIGITS)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(HASH_SPAN)


def index_draw(size: Column, *parts: Column | str | int) -> Column:
    """Uniform integer in [0, size)."""
    return F.floor(unit_draw(*parts) * size.cast("double")).cast("bigint")

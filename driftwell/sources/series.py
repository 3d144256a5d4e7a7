"""Fixed-length series from an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble_series(
    events: DataFrame,
    entity: list[str],
    *,
    time: str,
    value: str,
    start: str,
    length: int,
) -> DataFrame:
    """(entity..., row_id, v, n_filled): daily means over ``length`` days from ``start``,
    days without events being 0.

    Days are averaged first (with map-side partial sums), so an entity that holds a
    third of all events brings at most ``length`` numbers to its group.
    """
    day = F.datediff(F.col(time).cast("date"), F.lit(start).cast("date"))
    daily = (
        events.select(*entity, day.alias("_day"), F.col(value).cast("double").alias("_x"))
        .filter(F.col("_day").between(0, length - 1))
        .groupBy(*entity, "_day")
        .agg(F.avg("_x").alias("_mean"))
    )
    by_day = daily.groupBy(*entity).agg(F.map_from_entries(F.collect_list(F.struct("_day", "_mean"))).alias("_days"))
    # the outer one-element array names the map, so that it is built once and not per day
    filled = F.transform(
        F.array("_days"),
        lambda days: F.transform(
            F.sequence(F.lit(0), F.lit(length - 1)), lambda d: F.coalesce(days[d], F.lit(0.0)).cast("float")
        ),
    )[0]
    # the parts of the key are told apart whatever they hold: bars and backslashes are escaped, nulls are \\N
    parts = [
        F.coalesce(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\\N"))
        for c in entity
    ]
    return by_day.select(
        *entity,
        F.concat_ws("|", *parts).alias("row_id"),
        filled.alias("v"),
        F.size("_days").alias("n_filled"),
    )

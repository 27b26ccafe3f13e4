"""Totals over trailing periods for every day of an entity's calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlore.session import cut


def trailing_totals(daily: DataFrame, periods: Sequence[int] = (7, 30), *, active: bool = False) -> DataFrame:
    """entity, day and, for each period p, total_p and mean_p over the p days that end with day; days without rows count.

    daily has the columns entity, day (int, days since 1970-01-01) and n. The calendar of an entity runs from its first to
    its last day in daily. mean_p is total_p / p. active=True leaves out days whose longest total has no row of daily in it, so a
    calendar with a hole of years costs nothing.

    Method: calendar dates and daily totals meet in coarse date buckets as wide as the longest period; a total is put into
    the bucket of its day and the next one, which holds every date whose period can reach it. Both sides are placed by
    entity and bucket once, the dates are unfolded after that, the range condition picks the totals within the bounds, and
    the sums need no further exchange. A busy entity is no larger than its calendar, and is spread over its buckets.

    Defined cases: rows with NULL entity or day are left out; a NULL n counts as 0; several rows of one day are added up;
    negative day numbers are allowed; further columns are ignored; an empty table gives no rows.
    """
    width = max(periods)
    # Daily rows are few against the input: at most one per entity and day. They are written once and read for the span, for the
    # chunks and for the totals.
    clean = cut(
        daily.where(F.col("entity").isNotNull() & F.col("day").isNotNull())
        .groupBy("entity", "day")
        .agg(F.sum(F.coalesce(F.col("n"), F.lit(0))).cast("long").alias("n"))
    )
    bucket = lambda c: F.floor(c / F.lit(width)).cast("int")
    span = clean.groupBy("entity").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    if active:
        near = clean.select("entity", F.explode(F.array(bucket(F.col("day")), bucket(F.col("day")) + 1)).alias("bucket")).distinct()
        chunks = near.join(span, "entity").where(F.col("bucket") * width <= F.col("last")).repartition("entity", "bucket")
    else:
        of_span = F.explode(F.sequence(bucket(F.col("first")), bucket(F.col("last")))).alias("bucket")
        chunks = span.select("entity", "first", "last", of_span).repartition("entity", "bucket")
    dates = chunks.select(
        "entity",
        "bucket",
        F.explode(
            F.sequence(F.greatest(F.col("first"), F.col("bucket") * width), F.least(F.col("last"), F.col("bucket") * width + (width - 1)))
        ).alias("day"),
    )
    totals = clean.select(
        "entity",
        F.col("day").alias("of_day"),
        "n",
        F.explode(F.array(bucket(F.col("day")), bucket(F.col("day")) + 1)).alias("bucket"),
    )
    d, t = dates.alias("d"), totals.alias("t")
    within = (
        (F.col("d.entity") == F.col("t.entity"))
        & (F.col("d.bucket") == F.col("t.bucket"))
        & (F.col("t.of_day") <= F.col("d.day"))
        & (F.col("t.of_day") > F.col("d.day") - width)
    )
    sums = [
        F.coalesce(F.sum(F.when(F.col("t.of_day") > F.col("d.day") - p, F.col("t.n"))), F.lit(0)).cast("long").alias(f"total_{p}") for p in periods
    ]
    out = d.join(t, within, "inner" if active else "left").groupBy(F.col("d.entity"), F.col("d.bucket"), F.col("d.day")).agg(*sums)
    return out.select("entity", "day", *(c for p in periods for c in (f"total_{p}", (F.col(f"total_{p}") / p).alias(f"mean_{p}"))))

"""Visits: the events of an entity split where nothing happened for longer than a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, *, gap: int = 1800, chunk: int = 3600, items: bool = True) -> DataFrame:
    """entity, start, end, duration, n and, unless items is False, items: one row per visit; items is the exact number of distinct
    items in it.

    events has the columns entity, time (epoch seconds) and item. A new visit begins when more than `gap` seconds have
    passed since the entity's preceding event.

    Method: events are placed by entity and second and counted there, so a chunk of time holds at most as many counts as
    seconds, however busy an entity is. Each entity's chunk gives local visits, at most chunk/gap + 1, which are then merged
    where the gap over the boundary is no longer than `gap`. Distinct items are counted over the seconds of a visit, item by
    item, so that no task holds the items of a busy visit.

    Defined cases: events with NULL entity or time are left out; a NULL item is counted as an event, not as an item; equal
    times are in one visit; repeated rows are separate events (make them distinct before, if they are one); further columns
    are ignored; an empty table gives no rows.
    """
    own = events.where(F.col("entity").isNotNull() & F.col("time").isNotNull()).select("entity", "time", "item").repartition("entity", "time")
    return of_placed(own, gap=gap, chunk=chunk, items=items)


def of_placed(placed: DataFrame, *, gap: int = 1800, chunk: int = 3600, items: bool = True) -> DataFrame:
    """sessions of events that are placed by entity and time already, with neither of them NULL."""
    local = local_visits(placed.groupBy("entity", "time").agg(F.count(F.lit(1)).alias("n")), gap, chunk)
    chained = merged(local.groupBy("entity", "chunk", "local_start").agg(F.max("time").alias("local_end"), F.sum("n").alias("n")), gap)
    visits = chained.groupBy("entity", "start").agg(F.max("local_end").alias("end"), F.sum("n").alias("n"))
    shown = ["entity", "start", "end", (F.col("end") - F.col("start")).alias("duration"), "n"]
    if not items:
        return visits.select(*shown)
    of_second = local.join(chained, ["entity", "chunk", "local_start"]).select("entity", "time", "start")
    distinct = placed.where(F.col("item").isNotNull()).join(of_second, ["entity", "time"]).select("entity", "start", "item").distinct()
    counted = distinct.groupBy("entity", "start").agg(F.count(F.lit(1)).alias("items"))
    return visits.join(counted, ["entity", "start"], "left").select(*shown, F.coalesce("items", F.lit(0)).alias("items"))


def local_visits(seconds: DataFrame, gap: int, chunk: int) -> DataFrame:
    """entity, chunk, time, n, local_start: for each second with events the start of its visit within the chunk."""
    parted = seconds.withColumn("chunk", F.floor(F.col("time") / chunk))
    inside = Window.partitionBy("entity", "chunk").orderBy("time")
    before = F.lag("time").over(inside)
    marked = parted.withColumn("begins", F.when(before.isNull() | (F.col("time") - before > gap), F.col("time")))
    start = F.last("begins", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return marked.select("entity", "chunk", "time", "n", start.alias("local_start"))


def merged(local: DataFrame, gap: int) -> DataFrame:
    """entity, chunk, local_start, local_end, n, start: local visits with the start of the visit they are part of."""
    along = Window.partitionBy("entity").orderBy("local_start")
    before = F.lag("local_end").over(along)
    begins = F.when(before.isNull() | (F.col("local_start") - before > gap), F.col("local_start"))
    start = F.last("begins", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    return local.withColumn("begins", begins).withColumn("start", start).drop("begins")

"""Feature table: one row per entity, with count, latest time and total for each of hundreds of event types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitlore.session import bucketed

FEATURE = "map<string,struct<n:bigint,last:bigint,total:bigint>>"


def block_of(event_type: Column, blocks: int) -> Column:
    """The block an event type belongs to; no dictionary of types is needed."""
    return F.pmod(F.xxhash64(event_type), F.lit(blocks)).cast("int")


def feature_table(events: DataFrame, entities: DataFrame, *, blocks: int = 4) -> DataFrame:
    """One row per entity: `entity` and the maps `block_0` ... `block_{blocks-1}` from event type to (n, last, total).

    events has the columns entity, event_type, time, amount; entities has the column entity, each entity at least once.

    Method: the events are counted per entity and type with map-side combining, so a busy entity leaves each input
    partition as at most one row per type; the counts are written once to the shared folder, in buckets of the entity. Every
    block of types is then aggregated by entity and joined to the complete entity table; all of them keep the buckets, so
    neither the aggregations nor the joins move rows of counts.

    Defined cases: an entity without events has empty maps; NULL event types are counted as the type ''; NULL times do not
    count towards `last`, NULL amounts count as 0; an entity NULL is left out; events of entities that the entity table
    lacks are left out; further columns are ignored; empty tables give empty tables.
    """
    counts = (
        events.where(F.col("entity").isNotNull())
        .groupBy("entity", F.coalesce(F.col("event_type"), F.lit("")).alias("event_type"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("time").alias("last"), F.coalesce(F.sum("amount"), F.lit(0).cast("long")).alias("total"))
    )
    placed = bucketed(counts.withColumn("block", block_of(F.col("event_type"), blocks)), "entity")
    table = entities.where(F.col("entity").isNotNull()).select("entity").distinct()
    for block in range(blocks):
        part = (
            placed.where(F.col("block") == block)
            .groupBy("entity")
            .agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("n", "last", "total")))).alias(f"block_{block}"))
        )
        table = table.join(part, "entity", "left")
    empty = F.map_from_arrays(F.array(), F.array()).cast(FEATURE)
    return table.select("entity", *(F.coalesce(F.col(f"block_{b}"), empty).alias(f"block_{b}") for b in range(blocks)))


def unfold(features: DataFrame) -> DataFrame:
    """entity, event_type, n, last, total of a feature table."""
    blocks = [c for c in features.columns if c.startswith("block_")]
    entries = F.concat(*(F.map_entries(F.col(c)) for c in blocks))
    return features.select("entity", F.explode(entries).alias("e")).select(
        "entity", F.col("e.key").alias("event_type"), F.col("e.value.n").alias("n"), F.col("e.value.last").alias("last"), F.col("e.value.total").alias("total")
    )

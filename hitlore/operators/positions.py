"""Dense positions for rows that have an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitlore.session import cut


def numbered(rows: DataFrame, order: Sequence[str], *, start: int = 0, name: str = "position") -> DataFrame:
    """rows with dense numbers from `start` in the order of some columns, which must order the rows fully.

    The rows are range-partitioned by the order and written once, sorted; the rows of each partition are counted, and the
    prefix sums of the counts are the offsets of the partitions. A row's place in its partition is that of reading, so no row
    moves again. Only one row per partition meets in one task.
    """
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    # The number of a partition in the upper bits, that of a row in it in the lower 33.
    read = placed.withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    counts = placed.groupBy(F.spark_partition_id().cast("long").alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        "__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset")
    )
    # One row per partition of the input: a bounded table.
    joined = read.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    place = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(name, (F.col("__offset") + place + start).cast("long")).drop("__part", "__offset", "__id")

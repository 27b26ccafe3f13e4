"""The most frequent values of columns with very many distinct values, exactly and in bounded memory."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def item_counts(rows: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """field, item, n: the exact counts of the values of several columns, made in one pass.

    Aggregation combines on the map side and spills, so memory does not follow the number of distinct values; a value that
    fills a third of all rows leaves each input partition as one row.
    """
    pairs = F.array(*(F.struct(F.lit(name).alias("field"), value.cast("string").alias("item")) for name, value in fields.items()))
    return rows.select(F.explode(pairs).alias("p")).select("p.field", "p.item").where(F.col("item").isNotNull()).groupBy("field", "item").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(rows: DataFrame, fields: Mapping[str, Column], k: int) -> DataFrame:
    """field, item, n, of: the k most frequent values of each field; `of` is the number of values that were counted.

    Method: exact grouping with map-side combining, hash partitions that spill, the first k of each partition (a window
    whose group limit runs before the exchange), then one ordered limit over the k rows of each partition.

    Defined cases: NULL is no value; ties are broken by the value in ascending order; fewer than k values give fewer rows;
    an empty table gives no rows; columns are converted to text; further columns are ignored.
    """
    counts = item_counts(rows, fields)
    order = Window.partitionBy("field").orderBy(F.desc("n"), F.asc("item"))
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    of = counts.groupBy("field").agg(F.sum("n").alias("of"))
    return top.join(of, "field").select("field", "item", "n", "of")


def heavy_items(rows: DataFrame, fields: Mapping[str, Column], share: float) -> DataFrame:
    """field, item, n, of: the values that hold at least `share` of their field. No more than 1/share values can."""
    return most_frequent(rows, fields, int(1 / share) + 1).where(F.col("n") >= F.lit(share) * F.col("of"))

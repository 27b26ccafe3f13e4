"""Several logs to one, in the order of time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlore.operators.positions import numbered
from hitlore.schema import MERGED_ROWS


def merge_logs(logs: Sequence[DataFrame], *, block_rows: int = MERGED_ROWS) -> DataFrame:
    """The rows of all logs by time, with new dense positions from 0 and block_start; equal times keep the order of the
    inputs, and inside an input that of position. Nothing is de-duplicated. NULL times count as 0.

    Columns one log lacks are NULL there. No log, or only empty ones, give an empty log.
    """
    tagged = [log.withColumn("__input", F.lit(i)).withColumnRenamed("position", "__seq") for i, log in enumerate(logs)]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).withColumn("time", F.coalesce("time", F.lit(0).cast("long")))
    out = numbered(together.drop("block_start"), ["time", "__input", "__seq"]).drop("__input", "__seq")
    return out.withColumn("block_start", F.col("position") - F.col("position") % block_rows)

"""Queries over block_rows: problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlore.operators import drift
from hitlore.sources.requests import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(load(spark, sf_dir, "block_rows"))


def p1_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified table in plain columns."""
    table = drift.unify(load(spark, sf_dir, "block_rows"))
    return table.select(
        "log_dir", "block_start", "row_no", "position", "status", "method", "uri", "ua", "referer", F.lower(F.hex("ip")).alias("ip_hex"), "ip4",
        "port", "time", F.lower(F.hex("body")).alias("body_hex"),
        F.array_join(F.transform("headers", lambda h: F.concat(h["key"], F.lit(":"), h["value"])), "\n").alias("headers"),
        "host", "proto", "location", F.lower(F.hex("tls_fp")).alias("tls_fp_hex"),
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_table)}

"""Stored logs: Parquet files sorted by position, with the block and the format version of each row as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitlore.schema import BLOCK_ROWS, COLUMNS, STORED, VERSION

_FILE = T.StructType([*STORED.fields, T.StructField("block_start", T.LongType()), T.StructField("version", T.IntegerType())])


def write_blocks(rows: DataFrame, path: str, *, block_rows: int = BLOCK_ROWS, codec: str = "zstd", mode: str = "append", version: int = VERSION) -> None:
    """Rows with positions, in blocks of `block_rows`. Files appear whole or not at all, when the job commits.

    A block is a value of block_start, not a folder: files hold ranges of positions and are as large as the session's advisory
    size of partitions, whatever the size of a block; row groups are skipped by position.
    """
    start = F.col("position") - F.col("position") % block_rows
    placed = rows.withColumns({"block_start": start, "version": F.lit(version)}).repartitionByRange("position").sortWithinPartitions("position")
    placed.write.mode(mode).option("compression", codec).parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """A stored log. Columns that older blocks lack come with their defaults, those that newer ones have are left out.

    The schema is given, so no footer is read before the rows are. A block of a version that is not known yet is an error, not
    a block with defaults.
    """
    read = spark.read.schema(_FILE).parquet(path)
    newer = F.raise_error(F.concat(F.lit("block of version "), F.col("version"), F.lit(f", known is {VERSION}"))).cast("boolean")
    defaults = {"headers": F.array().cast("array<struct<key:string,value:string>>"), "host": F.lit(""), "proto": F.lit(0), "tls_fp": F.unhex(F.lit("0" * 32))}
    out = [(F.coalesce(F.col(f.name), defaults[f.name]) if f.name in defaults else F.col(f.name)).alias(f.name) for f in STORED]
    return read.where(F.when(F.col("version") > VERSION, newer).otherwise(F.lit(True))).select(*out, "block_start")


def columns_of(rows: DataFrame) -> DataFrame:
    return rows.select(*COLUMNS)

"""request_entries: valid rows, and the requests that remain of re-sent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlore.functions import net

PROTOCOLS = ("Unknown", "Http", "Https")
#: Two rows that agree in these are one request.
REQUEST_KEY = ("ip_hex", "port", "time", "method", "host_name", "uri")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def in_range(column: Column) -> Column:
    return column.between(0, 65535)


def valid_rows(entries: DataFrame) -> DataFrame:
    """The rows of request_entries that keep the ingest rules, with the columns ip_hex, host_name and a time without NULL.

    Dropped: a NULL in status, method, uri, ip, port, host or proto; status or port outside 0..65535; an address that is
    not well formed; another proto than Unknown, Http or Https. Other columns may be NULL or missing from the query.
    Columns of these names in the input are replaced.
    """
    keep = F.col("method").isNotNull() & F.col("uri").isNotNull() & F.col("host").isNotNull()
    return (
        entries.where(keep & in_range(F.col("status")) & in_range(F.col("port")) & F.col("proto").isin(*PROTOCOLS) & F.col("ip").isNotNull())
        .withColumns({
            "ip_hex": net.once(net.address_hex(F.col("ip"))),
            "host_name": net.host_name(F.col("host")),
            "time": F.coalesce(F.col("time"), F.lit(0).cast("long")),
        })
        .where(F.col("ip_hex").isNotNull())
    )


def requests(valid: DataFrame, *, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row for each request of valid rows: the key columns, and for each entry of carry its value on the first arrival.

    Rows that agree in the whole key are one request; the first to arrive (lowest entry_id) gives what the copies disagree
    about. The key is as fine as a request, so a busy address is spread over all partitions.
    """
    first = [F.min_by(value, F.col("entry_id")).alias(name) for name, value in (carry or {}).items()]
    rows = valid.groupBy(*REQUEST_KEY)
    return rows.agg(*first) if first else valid.select(*REQUEST_KEY).distinct()

"""From requests as they are sent to rows as they are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitlore import schema
from hitlore.functions import jsontext, net, text, wide
from hitlore.sources.requests import valid_rows


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """The well-formed requests of JSON-lines files, in the columns of request_entries; bad lines are skipped.

    A line is skipped if it is no JSON object or breaks a rule of the ingest (see sources.requests.valid_rows), and if its time is
    no number or more than the 63 bits of the stored column; a time that is missing or null is 0. Unknown fields are passed over. file_path, file_block and seq order the lines as they stand in the files.
    """
    block = F.col("_metadata.file_block_start").alias("file_block")
    lines = spark.read.text(path).select("value", "_metadata.file_path", block, F.monotonically_increasing_id().alias("seq"))
    return parsed(lines, "value").drop("value")


def parsed(lines: DataFrame, column: str) -> DataFrame:
    """The columns of lines and those of the request in each line that keeps the ingest rules."""
    raw = F.from_json(F.col(column), T.MapType(T.StringType(), T.StringType()))
    number = lambda name, kind: F.when(F.col("__m")[name].rlike(r"\A[0-9]+\z"), F.col("__m")[name]).try_cast(kind)
    value = lambda name: F.col("__m")[name]
    fields = {
        "status": number("status", "int"), "method": value("method"), "uri": value("uri"), "ip": value("ip"), "port": number("port", "int"),
        "time": F.coalesce(number("time", "long"), F.lit(0).cast("long")), "body": body_bytes(value("body")), "headers": value("headers"),
        "host": value("host"), "proto": value("proto"), "location": value("location"), "tls_fingerprint": value("tls_fingerprint"),
    }
    read = lines.withColumn("__m", raw).where(jsontext.single_object(F.col(column)).isNotNull() & (value("time").isNull() | number("time", "long").isNotNull()))
    return valid_rows(read.withColumns(fields).drop("__m"))


def body_bytes(body):
    """A JSON list of bytes, else the bytes of the text."""
    listed = F.transform(F.from_json(body, "array<int>"), lambda x: F.lpad(F.hex(x), 2, "0"))
    return F.when(body.rlike(r"\A\[([0-9]{1,3}(,[0-9]{1,3})*)?\]\z"), F.unhex(F.array_join(listed, ""))).otherwise(F.encode(body, "UTF-8"))


def stored_rows(valid: DataFrame) -> DataFrame:
    """The columns of a stored row but position, and the other columns of valid, from valid rows of request_entries."""
    others = [c for c in valid.columns if c not in schema.COLUMNS and c not in ("ip_hex", "host_name", "tls_fingerprint")]
    proto = F.element_at(F.create_map(*(F.lit(x) for kv in schema.PROTOCOL_NUMBERS.items() for x in kv)), F.col("proto"))
    return valid.select(
        "status",
        "method",
        "uri",
        F.lit(None).cast("string").alias("ua"),
        F.lit(None).cast("string").alias("referer"),
        F.unhex("ip_hex").alias("ip"),
        net.ip4_of_hex(F.col("ip_hex")).alias("ip4"),
        "port",
        "time",
        "body",
        text.split_headers(F.col("headers")).alias("headers"),
        "host",
        proto.alias("proto"),
        "location",
        F.coalesce(wide.u128_le(F.col("tls_fingerprint")), F.unhex(F.lit("0" * 32))).alias("tls_fp"),
        *others,
    )


def label_file(spark: SparkSession, path: str) -> DataFrame:
    """label_pos, position, label of a file with one JSON object from positions to labels, in the order of the file."""
    whole = spark.read.option("wholetext", True).text(path)
    pairs = F.from_json("value", "map<string,boolean>")
    return whole.select(F.posexplode(F.map_entries(pairs)).alias("label_pos", "e")).select(
        "label_pos", F.col("e.key").try_cast("long").alias("position"), F.col("e.value").alias("label")
    )

"""Queries over request_entries: problems 2 to 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlore.functions import net
from hitlore.operators import events, frequent, sessions, sketch, skew, trailing
from hitlore.session import cut
from hitlore.sources import requests as R

#: Parameters of the queries.
MIN_TYPE_REQUESTS, SHARE_P3, SHARE_P6, SHARE_P7 = 5, 0.02, 0.15, 0.05
#: A relative standard error of at most 0.8 percent; intervals of five standard errors.
REGISTERS_P6, Z_P6 = sketch.registers_for(0.008), 5.0


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.valid_rows(R.load(spark, sf_dir, "request_entries"))


def event_type() -> F.Column:
    """A route together with the status class. The class comes first, so the route may hold any character."""
    return F.concat_ws(" ", F.floor(F.col("status") / 100).cast("string"), net.route(F.col("uri")))


# 2 ------------------------------------------------------------------------------------------------------------------
def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table of all addresses: total is the bytes of body."""
    # One number, not a struct: such an aggregation hashes instead of sorting. A status has 16 bits.
    packed = F.coalesce(F.octet_length("body"), F.lit(0)).cast("long") * 65536 + F.col("status")
    event = F.col("event")
    rows = R.requests(valid(spark, sf_dir), carry={"event": packed}).withColumns({"status": event % 65536, "bytes": F.shiftright(event, 16)})
    typed = rows.select(
        F.col("ip_hex").alias("entity"),
        F.concat_ws(" ", F.floor(F.col("status") / 100).cast("string"), net.route(F.col("uri"))).alias("event_type"),
        F.when(F.col("time") != 0, F.col("time")).alias("time"),
        F.col("bytes").alias("amount"),
    )
    return events.feature_table(typed, valid(spark, sf_dir).select(F.col("ip_hex").alias("entity")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split(F.col("event_type"), " ", 2)
    return events.unfold(p2_table(spark, sf_dir)).where(F.col("n") >= MIN_TYPE_REQUESTS).select(
        F.col("entity").alias("ip_hex"), parts[1].alias("route"), parts[0].cast("int").alias("status_class")
    )


def p2_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table, unfolded to one row per address and event type."""
    parts = F.split(F.col("event_type"), " ", 2)
    return events.unfold(p2_table(spark, sf_dir)).select(
        F.col("entity").alias("ip_hex"), parts[1].alias("route"), parts[0].cast("int").alias("status_class"), "n", "last", "total"
    )


# 3 ------------------------------------------------------------------------------------------------------------------
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid(spark, sf_dir)
    return frequent.heavy_items(rows, {"uri": F.col("uri"), "ip": F.col("ip_hex")}, SHARE_P3).select("field", "item")


def p3_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most frequent uris, addresses and host names with their counts."""
    rows = valid(spark, sf_dir)
    return frequent.most_frequent(rows, {"uri": F.col("uri"), "ip": F.col("ip_hex"), "host": F.col("host_name")}, 20)


# 4 ------------------------------------------------------------------------------------------------------------------
def daily_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.requests(valid(spark, sf_dir).where(net.day_number(F.col("time")).isNotNull()))
    return rows.groupBy(F.col("ip_hex").alias("entity"), net.day_number(F.col("time")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def p4_days(spark: SparkSession, sf_dir: str, *, active: bool = False) -> DataFrame:
    totals = trailing.trailing_totals(daily_requests(spark, sf_dir), active=active)
    return totals.select(
        F.col("entity").alias("ip_hex"),
        F.date_format(net.date_of_day(F.col("day")), "yyyy-MM-dd").alias("day"),
        "total_7",
        "mean_7",
        "total_30",
        "mean_30",
    )


def p4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_days(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days without a request in the last 30 can't be found, so they aren't made."""
    return p4_days(spark, sf_dir, active=True).where((F.col("total_7") == 0) & (F.col("total_30") >= 10)).select("ip_hex", "day")


# 5 ------------------------------------------------------------------------------------------------------------------
def p5_visits(spark: SparkSession, sf_dir: str, *, items: bool = True) -> DataFrame:
    """All visits. Copies are one request: they agree in address and time, so they meet where the visits are built."""
    rows = valid(spark, sf_dir).where(F.col("time") != 0).select(*R.REQUEST_KEY)
    own = rows.repartition("ip_hex", "time").distinct().select(F.col("ip_hex").alias("entity"), "time", F.col("uri").alias("item"))
    found = sessions.of_placed(own, gap=1800, items=items)
    return found.withColumnsRenamed({"entity": "ip_hex", "start": "start_time", "end": "end_time"})


def p5_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_visits(spark, sf_dir).withColumnRenamed("items", "uris")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_visits(spark, sf_dir, items=False).where(F.col("n") >= 3).select("ip_hex", "start_time", "end_time")


# 6 ------------------------------------------------------------------------------------------------------------------
def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day (number), host, item: an address that made a request on a host on a day. Copies change no set of addresses."""
    rows = valid(spark, sf_dir).select(net.day_number(F.col("time")).alias("day"), F.col("host_name").alias("host"), F.col("ip_hex").alias("item"))
    return rows.where(F.col("day").isNotNull())


def p6_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers per day and host, written once; all coarser groups are merged from them."""
    return cut(sketch.merge_sketches(sketch.partial_sketches(seen(spark, sf_dir), ["day", "host"], REGISTERS_P6), ["day", "host"], REGISTERS_P6))


LEVELS_P6 = (("day_host", ("day", "host")), ("day", ("day",)), ("host", ("host",)), ("all", ()))


def _day_text() -> F.Column:
    return F.date_format(net.date_of_day(F.col("day").cast("int")), "yyyy-MM-dd")


def p6_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """level, day, host, estimate, low, high: distinct addresses per day and host, per day, per host and in all."""
    cells = p6_cells(spark, sf_dir)
    out = None
    for level, by in LEVELS_P6:
        named = sketch.estimates(cells if len(by) == 2 else sketch.merge_sketches(cells, by, REGISTERS_P6), Z_P6)
        for c in ("day", "host"):
            if c not in by:
                named = named.withColumn(c, F.lit(None).cast("string"))
        named = named.select(F.lit(level).alias("level"), _day_text().alias("day"), "host", "estimate", "low", "high")
        out = named if out is None else out.unionByName(named)
    return out


def p6_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """level, day, host, n, inside: the exact number of distinct addresses of each group of p6_distinct, and whether it lies
    between the bounds of the estimate. This query measures the intervals; no other one counts exactly."""
    rows = seen(spark, sf_dir).withColumn("day", _day_text())
    exact = None
    for level, by in LEVELS_P6:
        own = rows.select(*(F.col(c) if c in by else F.lit(None).cast("string").alias(c) for c in ("day", "host")), "item").distinct()
        own = own.groupBy("day", "host").agg(F.count(F.lit(1)).alias("n")).select(F.lit(level).alias("level"), "day", "host", "n")
        exact = own if exact is None else exact.unionByName(own)
    d, e = p6_distinct(spark, sf_dir).alias("d"), exact.alias("e")
    same = (F.col("d.level") == F.col("e.level")) & F.col("d.day").eqNullSafe(F.col("e.day")) & F.col("d.host").eqNullSafe(F.col("e.host"))
    inside = F.col("e.n").between(F.col("d.low"), F.col("d.high"))
    return e.join(d, same, "left").select("e.level", "e.day", "e.host", "e.n", F.coalesce(inside, F.lit(False)).alias("inside"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of pairs and days from registers, each rounded to the whole number that a count is."""
    cells = p6_cells(spark, sf_dir)
    pairs = sketch.estimates(cells).select("day", "host", F.round("estimate").alias("n"))
    days = sketch.estimates(sketch.merge_sketches(cells, ["day"], REGISTERS_P6)).select("day", F.round("estimate").alias("of"))
    return pairs.join(days, "day").where(F.col("n") * 100 >= F.col("of") * int(SHARE_P6 * 100)).select(_day_text().alias("day"), "host")


# 7 ------------------------------------------------------------------------------------------------------------------
def p7_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field, item, n, bytes, errors, first_time, last_time, error_run of every address and host name."""
    keys = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(c).alias("item")) for f, c in (("ip", "ip_hex"), ("host", "host_name")))))
    rows = valid(spark, sf_dir).select(
        keys.alias("key"),
        F.col("entry_id").alias("seq"),
        F.when(F.col("time") != 0, F.col("time")).alias("time"),
        F.octet_length("body").alias("amount"),
        (F.col("status") >= 400).alias("error"),
    )
    return skew.per_key(rows).select(
        "key.field", "key.item", "n", F.col("total").alias("bytes"), "errors", "first_time", "last_time", "error_run"
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = p7_results(spark, sf_dir)
    of = results.groupBy("field").agg(F.sum("n").alias("of"))
    return results.join(of, "field").where(F.col("n") >= SHARE_P7 * F.col("of")).select("field", "item")


QUERIES = {f.__name__: f for f in (p2_found, p2_features, p3_found, p3_top, p4_found, p4_totals, p5_found, p5_sessions, p6_found, p6_distinct, p6_bounds, p7_found, p7_results)}

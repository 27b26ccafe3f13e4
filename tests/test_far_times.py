"""One row with a time no calendar has, one with an early and one with a late year, beside ordinary rows."""

import pytest

from hitlore.functions import net
from hitlore.operators import trailing
from hitlore.plans import requests_queries as Q
from pyspark.sql import functions as F

COLUMNS = (
    "entry_id long, status int, method string, uri string, ip string, port int, time long, body binary, headers string, host string, proto string, "
    "location string, tls_fingerprint string, received timestamp"
)
NOON = 1757000000


def entry(i, time, ip="10.0.0.1", host="a.example"):
    return (i, 200, "GET", f"/p/x?{i}", ip, 1000 + i, time, b"xy", None, host, "Https", None, None, None)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of tables with far times and one without."""
    root = tmp_path_factory.mktemp("far")
    usual = [entry(i, NOON + 60 * i, "10.0.0.1" if i % 2 else "10.0.0.2") for i in range(40)]
    far = [entry(100, 2**62), entry(101, -(2**62)), entry(102, 253402300800), entry(103, None), entry(104, 2**63 - 1, "10.0.0.3")]
    for name, rows in (("far", usual + far), ("usual", usual)):
        spark.createDataFrame(rows, COLUMNS).write.parquet(str(root / name / "request_entries.parquet"))
    return {name: str(root / name) for name in ("far", "usual")}


def rows_of(query, spark, path):
    df = query(spark, path)
    return {tuple(r) for r in df.select(sorted(df.columns)).collect()}


@pytest.mark.parametrize("name", ["p4_found", "p4_totals", "p6_found", "p6_bounds"])
def test_a_time_without_a_day_changes_no_day(spark, tables, name):
    far, usual = (rows_of(Q.QUERIES[name], spark, tables[x]) for x in ("far", "usual"))
    assert far == usual and (usual or name == "p4_found")


def test_other_queries_take_far_times(spark, tables):
    far = tables["far"]
    assert {r.last for r in Q.p2_features(spark, far).collect()} >= {2**63 - 1, 2**62}
    assert len(rows_of(Q.p2_found, spark, far)) > 0 and len(rows_of(Q.p3_top, spark, far)) > 0 and len(rows_of(Q.p3_found, spark, far)) > 0
    visits = rows_of(Q.p5_sessions, spark, far)
    assert sum(v[3] for v in visits) == 44  # all requests with a time
    assert (2**62, 2**62) in {(r.start_time, r.end_time) for r in Q.p5_sessions(spark, far).collect()}
    results = {(r.field, r.item): r for r in Q.p7_results(spark, far).collect()}
    assert results["host", "a.example"].n == 45 and results["host", "a.example"].last_time == 2**63 - 1
    assert len(rows_of(Q.p7_found, spark, far)) >= 3 and len(rows_of(Q.p6_distinct, spark, far)) == 4


def test_days(spark):
    times = [0, None, NOON, 2**62, -(2**62), net.LAST_TIME, net.LAST_TIME + 1, net.FIRST_TIME, -1]
    got = spark.createDataFrame([(t,) for t in times], "t long").select(net.day_of(F.col("t")).alias("d"), net.day_number(F.col("t")).alias("n")).collect()
    assert [r.d for r in got] == [None, None, "2025-09-04", None, None, "9999-12-31", None, "0000-01-01", "1969-12-31"]
    assert got[2].n == NOON // 86400 and got[8].n == -1


def test_a_calendar_with_a_hole_of_years_is_short_when_only_active_days_are_asked_for(spark):
    daily = spark.createDataFrame([("a", 0, 5), ("a", 2_000_000, 7)], "entity string, day int, n long")
    got = {(r.day, r.total_7, r.total_30) for r in trailing.trailing_totals(daily, active=True).collect()}
    assert got == {(d, 5 if d < 7 else 0, 5) for d in range(30)} | {(2_000_000, 7, 7)}

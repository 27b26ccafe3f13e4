"""Addresses, hosts, routes, valid rows and requests."""

import ipaddress
from urllib.parse import unquote

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hitlore.functions import net, wide
from hitlore.sources import requests as R

ENTRY = "entry_id long, status int, method string, uri string, ip string, port int, time long, body binary, headers string, host string, proto string, location string, tls_fingerprint string"


def want_hex(text):
    try:
        if text is None or "%" in text:
            return None
        a = ipaddress.ip_address(text)
    except ValueError:
        return None
    return "0" * 20 + f"ffff{int(a):08x}" if a.version == 4 else f"{int(a):032x}"


def test_addresses(spark):
    fixed = """1.2.3.4 01.2.3.4 1.2.3 256.1.1.1 :: ::1 1:: 1::2 1:2:3:4:5:6:7:8 1:2:3:4:5:6:7:: ::2:3:4:5:6:7:8 1:2:3:4::5:6:7:8 1:2:3::4:5:6:7
    ::ffff:1.2.3.4 1:2:3:4:5:6:1.2.3.4 1:2:3:4:5:6:7:1.2.3.4 ::1.2.3.4 1.2.3.4:: 1::2::3 ::: 1:::2 :1:2:3:4:5:6:7 1:2:3:4:5:6:7: abcd:EF01::9 12345:: g::1
    - ::1.2.3 1:2:3:4:5:6::1.2.3.4 ::5:6:7:8:1.2.3.4 1::1.2.3.4 : 1: 0:0:0:0:0:ffff:10.0.108.4 fe80::1%eth0 1.2.3.4.5 ::ffff:1.2.3.400""".split()
    texts = [*fixed, "", " ::1", "1.2.3.4\n", "::1\n", None]
    made = []

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from(["", "0", "1", "ab", "ffff", ":", "::", "1.2.3.4", "."]), min_size=1, max_size=12))
    def gather(parts):
        made.append(":".join(parts) if len(parts) % 2 else "".join(parts))

    gather()
    rows = spark.createDataFrame([(t,) for t in [*texts, *made]], "ip string").select("ip", net.address_hex(F.col("ip")).alias("h")).collect()
    assert [(r.ip, r.h) for r in rows] == [(r.ip, want_hex(r.ip)) for r in rows]


def test_hosts_and_days(spark):
    cases = {"A.b.": "a.b", "a:443": "a", "a.:443": "a", "a..": "a.", "a": "a", "": "", "[::1]:80": "[::1]", None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "h string").select("h", net.host_name(F.col("h")).alias("n")).collect()
    assert {r.h: r.n for r in rows} == cases
    days = spark.createDataFrame([(0,), (1,), (86399,), (86400,), (None,)], "t long").select("t", net.day_of(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in days} == {0: None, 1: "1970-01-01", 86399: "1970-01-01", 86400: "1970-01-02", None: None}


def test_routes(spark):
    def want(uri):
        path = uri.split("#")[0].split("?")[0]
        if "://" in path:
            path = path.split("://", 1)[1]
            path = path[path.index("/") :] if "/" in path else ""
        return "/".join([s for s in unquote(path).lower().split("/") if s][:2])

    uris = ["/A/B/c?x", "//a//b", "http://h/x/y/z", "https://h", "/#a?b", "/a%2fb/c", "/a%zz/%C3%89t", "/a+b/%2B/", "", "/%", "x/y/z",
            "/p?u=http://e/f/g", "/api/a\nb/c", "/ÉTÉ/x", "/%41/%e2%82%ac"]
    rows = spark.createDataFrame([(u,) for u in uris], "u string").select("u", net.route(F.col("u")).alias("r")).collect()
    assert {r.u: r.r for r in rows} == {u: want(u) for u in uris}


def test_wide_numbers(spark):
    numbers = [0, 1, 255, 256, 2**63, 2**64, 2**127, 2**128 - 1, 10**38, 340282366920938463463374607431768211455]
    rows = [(str(n),) for n in numbers] + [(str(2**128),), ("x",), ("",), (None,), ("-1",), ("0" * 40,)]
    got = spark.createDataFrame(rows, "n string").select("n", wide.u128_le(F.col("n")).alias("b")).collect()
    for r in got[: len(numbers)]:
        assert bytes(r.b) == int(r.n).to_bytes(16, "little")
    assert all(r.b is None for r in got[len(numbers) :])


def entry(i, **k):
    base = dict(entry_id=i, status=200, method="GET", uri="/", ip="1.2.3.4", port=1, time=100, body=None, headers=None, host="h", proto="Http", location=None, tls_fingerprint=None)
    return tuple((base | k).values())


def test_valid_rows_and_requests(spark):
    bad = [dict(status=None), dict(status=70000), dict(status=-1), dict(method=None), dict(uri=None), dict(ip=None), dict(ip="x"), dict(port=None), dict(port=65536),
           dict(host=None), dict(proto=None), dict(proto="https"), dict(proto="Ftp")]
    good = [
        dict(), dict(ip="::ffff:1.2.3.4", status=404), dict(host="H.", body=b"x"), dict(time=None), dict(time=0), dict(uri="/\n"), dict(method="", uri="", host=""),
    ]
    df = spark.createDataFrame([entry(i, **k) for i, k in enumerate(bad + good)], ENTRY).withColumn("extra", F.lit(1)).withColumn("host_name", F.lit("clash"))
    valid = R.valid_rows(df)
    assert valid.count() == len(good)
    once = R.requests(valid, carry={"first_status": F.col("status")}).collect()
    assert len(once) == 4 and {r.first_status for r in once} == {200}
    assert R.requests(R.valid_rows(df.limit(0))).count() == 0

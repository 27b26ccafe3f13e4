"""The filter language: conformance, errors, JSON form, and evaluation against a plain evaluator."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hitlore.filterlang import FilterError, compile_filter, from_json, parse, to_json
from hitlore.filterlang.ast import Address, Combined, Field, Fingerprint, Header, Moment, Not, Number, Period, Protocol, Text
from hitlore.filterlang.columns import flag, java_regex

P80 = Field("port", Number(80, 81))
FP = "0123456789abcdef0123456789abcdef"
DAY = Field("time", Period(Moment(1722470400), Moment(1722556800)))

#: text, strict reading, lenient reading (None: the same); a string is an error kind.
CASES = [
    ("port 80", P80, None),
    ("port 80 & uri /api & port 100", Combined("and", (P80, Field("uri", Text("equals", "/api")), Field("port", Number(100, 101)))), None),
    ("uri /api/ *", Field("uri", Text("prefix", "/api/")), None),
    ('port 80 .. 100 & uri "/api/"*', Combined("and", (Field("port", Number(80, 100)), Field("uri", Text("prefix", "/api/")))), None),
    ("ip 1.2.3.4", Field("ip", Address(0x01020304, 0xFFFFFFFF)), None),
    ("ip 10.*.0.1", Field("ip", Address(0x0A000001, 0xFF00FFFF)), None),
    ("loc de", Field("location", Text("equals", "de")), None),
    (f"fp {FP}", Field("tls_fp", Fingerprint(FP)), None),
    ("uri api", Field("uri", Text("equals", "api")), None),
    ('uri "api"', Field("uri", Text("equals", "api")), None),
    ("uri /api?foo=bar+baz&arg", Field("uri", Text("equals", "/api?foo=bar+baz&arg")), None),
    ('uri r"[0-1a-e]+"', Field("uri", Text("regex", "[0-1a-e]+")), None),
    (r'uri "a\"b\\c"', Field("uri", Text("equals", 'a"b\\c')), None),
    ("status 200 .. 300", Field("status", Number(200, 300)), None),
    ("status 400..500", "syntax", Field("status", Number(400, 500))),
    ("status 200 ..", "syntax", Field("status", Number(200, None))),
    ("time 2024-08-01", "syntax", DAY),
    ("time 2024 - 08 - 01", DAY, None),
    ("time -15m ..", "syntax", Field("time", Period(Moment(-900, True), None))),
    ("time - 15 m ..", Field("time", Period(Moment(-900, True), None)), None),
    ("time - 5 h .. 1 h", "syntax", Field("time", Period(Moment(-18000, True), Moment(-3600, True)))),
    ("time - 5min ..", "syntax", Field("time", Period(Moment(-300, True), None))),
    ("time .. + 1 d", Field("time", Period(None, Moment(86400, True))), None),
    ("time 2024 - 08 - 01 9 : 00 .. 10 : 30 : 15", Field("time", Period(Moment(1722502800), Moment(1722508215))), None),
    ("time 2024-08-01 09:00..10:30", "syntax", Field("time", Period(Moment(1722502800), Moment(1722508200)))),
    ("ua foo", Field("headers", Header("ua", Text("equals", "foo"))), Field("headers", Header("user-agent", Text("equals", "foo")))),
    ('referer "x"', Field("headers", Header("referer", Text("equals", "x"))), None),
    ("X-Foo * bar *", Field("headers", Header("x-foo", Text("contains", "bar"))), None),
    ("(port 80)", "syntax", P80),
    ("!(port 80)", "syntax", Not(P80)),
    ("! port 80", Not(P80), None),
    ("port 80 & !port 80", "syntax", Combined("and", (P80, Not(P80)))),
    ("port 80 & port 80 | port 80", "syntax", "syntax"),
    ("port 80 & (!port 80)", Combined("and", (P80, Not(P80))), None),
    ("!(port 80 & port 80)", Not(Combined("and", (P80, P80))), None),
    ("port 80 | (port 80 & port 80)", Combined("or", (P80, Combined("and", (P80, P80)))), None),
    ("uri http", "syntax", Field("uri", Text("equals", "http"))),
    ("uri s", "syntax", Field("uri", Text("equals", "s"))),
    ("uri host", "syntax", Field("uri", Text("equals", "host"))),
    ("uri 1.2.3.4", "syntax", Field("uri", Text("equals", "1.2.3.4"))),
    ("uri 80", Field("uri", Text("equals", "80")), None),
    ("uri /a&b", Field("uri", Text("equals", "/a&b")), None),
    ("fp 12345678901234567890123456789012", "syntax", Field("tls_fp", Fingerprint("12345678901234567890123456789012"))),
    (r'uri "a\nb"', "syntax", "syntax"),
    ("", "syntax", "syntax"),
    ("port 70000", "integer", "integer"),
    ("ip 300.1.1.1", "ipv4", "ipv4"),
    ("fp 0a", "hex_length", "hex_length"),
    ("fp 00", "syntax", "syntax"),
    ("fp zz23456789abcdef0123456789abcdef", "hex", "hex"),
    ("time 2024 - 13 - 01", "date", "date"),
    ('uri r"("', "regex", "regex"),
    ('uri r"a(?=b)"', "regex", "regex"),
    ("port > 65535", "integer", Field("port", Number(65536, None))),
    ("port >= 10", Field("port", Number(10, 65535)), Field("port", Number(10, None))),
    ("port > 10", Field("port", Number(11, 65535)), Field("port", Number(11, None))),
    ("port < 10", Field("port", Number(0, 10)), None),
    ("port <= 10", Field("port", Number(0, 11)), None),
    ("proto https", Field("proto", Protocol(2)), None),
    ("proto ftp", "syntax", "syntax"),
    ("* foo", "syntax", "syntax"),
    ("status 200 foo", "syntax", "syntax"),
]


@pytest.mark.parametrize(("text", "strict", "lenient"), CASES)
def test_conformance(text, strict, lenient):
    for want, is_strict in ((strict, True), (strict if lenient is None else lenient, False)):
        if isinstance(want, str):
            with pytest.raises(FilterError) as e:
                parse(text, strict=is_strict)
            assert e.value.kind == want
        else:
            assert parse(text, strict=is_strict) == want


@pytest.mark.parametrize("f", [c[2] if c[2] is not None else c[1] for c in CASES if not isinstance(c[2] if c[2] is not None else c[1], str)])
def test_json_round_trip(f):
    assert from_json(to_json(f)) == f


def test_json_refuses():
    for bad in ({"Status": {"Equals": 70000}}, {"Nope": 1}, {"Uri": {"Regex": "("}}, {"Ip": {"bits": 0, "mask": 0}}, {"A": 1, "B": 2}, 7):
        with pytest.raises(FilterError):
            from_json(bad)
    assert from_json(None) is None and from_json({"Uri": {"Similar": ["ab", 2]}}) == Field("uri", Text("similar", "ab", 2))


def test_final_dollar_is_the_end():
    assert java_regex("a$") == r"(?U)a\z" and java_regex(r"a\$") == r"(?U)a\$" and java_regex(r"a\\$") == r"(?U)a\\\z"
    assert java_regex("(a$)|b[$]") == r"(?U)(a\z)|b[$]" and java_regex("a.b") == "(?Ud)a.b" and java_regex("(?m)a$") == "(?Ud)(?m)a$"


SCHEMA = """position long, status int, method string, uri string, ip4 long, port int, time long, headers array<struct<key:string,value:string>>,
host string, proto int, location string, tls_fp binary"""
WORDS = ["/api/x", "/api/ä", "a%b_c", "", "/static/a.css", "GET", "DE", "de"]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def text_matches(t, v):
    return v is not None and {
        "equals": lambda: v == t.value, "prefix": lambda: v.startswith(t.value), "suffix": lambda: v.endswith(t.value), "contains": lambda: t.value in v,
        "regex": lambda: re.search(t.value, v) is not None, "similar": lambda: levenshtein(v, t.value) <= t.within,
    }[t.kind]()


def matches(f, row, now):
    if isinstance(f, Not):
        return not matches(f.part, row, now)
    if isinstance(f, Combined):
        got = [matches(p, row, now) for p in f.parts]
        return all(got) if f.op == "and" else any(got) if f.op == "or" else sum(got) % 2 == 1
    t, v = f.test, row.get(f.name)
    if isinstance(t, Header):
        return any(k == t.name and text_matches(t.value, x) for k, x in v or [])
    if isinstance(t, Address):
        return row["ip4"] is not None and row["ip4"] & t.mask == t.bits
    if v is None:
        return False
    if isinstance(t, Number):
        return (t.low is None or v >= t.low) and (t.high is None or v < t.high)
    if isinstance(t, Text):
        return text_matches(t, v)
    if isinstance(t, Period):
        return (t.start is None or v >= t.start.at(now)) and (t.end is None or v < t.end.at(now))
    if isinstance(t, Protocol):
        return v in (0, t.number)
    return v.hex() == t.hex


def random_filter(rng, depth):
    if depth and rng.random() < 0.6:
        if rng.random() < 0.3:
            return Not(random_filter(rng, depth - 1))
        return Combined(rng.choice(["and", "or", "xor"]), tuple(random_filter(rng, depth - 1) for _ in range(rng.randrange(2, 4))))
    text = lambda: rng.choice([*(Text(k, rng.choice(WORDS)) for k in ("equals", "prefix", "suffix", "contains")), Text("similar", rng.choice(WORDS), rng.randrange(4)), Text("regex", rng.choice([r"^/\w+", "a.b", "[dD]e$", r"\d"]))])
    moment = lambda: rng.choice([None, Moment(rng.randrange(20)), Moment(rng.randrange(-9, 9), True)])
    low = rng.choice([None, 0, 200, 300])
    return rng.choice([
        Field("status", Number(low, rng.choice([None, 201, 400]))), Field("port", Number(80, 81)), Field("uri", text()), Field("method", text()), Field("host", text()),
        Field("location", text()), Field("ip", Address(0x0A000001, rng.choice([0xFFFFFFFF, 0xFF0000FF]) & 0xFFFFFFFF if rng.random() < 0.5 else 0xFFFFFFFF)),
        Field("time", Period(moment(), moment())), Field("proto", Protocol(rng.choice([1, 2]))), Field("tls_fp", Fingerprint(rng.choice(["00" * 16, FP]))),
        Field("headers", Header(rng.choice(["ua", "accept"]), text())),
    ])


def test_random_filters_against_a_plain_evaluator(spark):
    rng, now = random.Random(11), 10
    rows = []
    for i in range(120):
        pairs = rng.choice([[], None, [(rng.choice(["ua", "accept", "Ua"]), rng.choice(WORDS + [None])) for _ in range(3)]])
        rows.append({
            "position": i, "status": rng.choice([200, 404, 65535]), "method": rng.choice(WORDS), "uri": rng.choice(WORDS), "ip4": rng.choice([None, 0x0A000001, 0x0A020001]),
            "port": rng.choice([80, 81, None]), "time": rng.choice([0, 5, 15, None]), "headers": pairs, "host": rng.choice([*WORDS, None]), "proto": rng.randrange(3),
            "location": rng.choice([None, "DE", "de"]), "tls_fp": rng.choice([bytes(16), bytes.fromhex(FP), None]),
        })
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).cache()
    for at in range(0, 240, 40):
        filters = [random_filter(rng, 4) for _ in range(40)]
        got = df.select("position", *(flag(f, now=now).alias(f"f{i}") for i, f in enumerate(filters))).collect()
        for r in got:
            for i, f in enumerate(filters):
                assert r[f"f{i}"] == matches(f, rows[r.position], now), (f, rows[r.position])
    for f in filters[:12]:
        assert {r.position for r in df.where(compile_filter(f, now=now)).collect()} == {r["position"] for r in rows if matches(f, r, now)}


def test_plain_conditions_reach_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("int").alias("status"), F.lit("/a").alias("uri")).write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(compile_filter("status 3 .. 5 & uri /a *"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(status,3)" in plan and "StringStartsWith(uri,/a)" in plan

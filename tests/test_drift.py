"""Schema drift: changes between files, and one table from all of them."""

import json
import random

import numpy as np
import pytest

from hitlore.operators import drift, flooding

SCHEMA = "log_dir string, block_start long, row_no int, record string"
UA, URL, FP = "Mozilla/5.0 (X11) Firefox/12.0", "https://h.example/x?id=1", "0cf8c3ecae9f85c70fd4d7f22dfa374b"
HEADERS = "host:h.example\nuser-agent:libfetch/1.2\naccept:*/*"


def base(i):
    return {"status": 200, "method": "GET", "uri": f"/a/{i}", "ip": "10.1.2.3", "port": 4000 + i, "time": 1757000000 + i, "host": "h.example"}


def table(spark, files, *extra):
    rows = [(d, s, i, json.dumps(r) if isinstance(r, dict) else r) for (d, s), records in files.items() for i, r in enumerate(records)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


def found(df):
    return {tuple(r) for r in drift.changes(df).collect()}


def file(n=5, drop=(), **more):
    return [{k: v for k, v in (base(i) | more).items() if k not in drop} for i in range(n)]


def test_added_renamed_retyped_removed(spark):
    files = {
        ("d", 0): file(ua=UA, referer=URL),
        ("d", 10): file(agent=UA, http_referer=[URL], edge="edge-1"),
        ("d", 20): file(userAgent=UA.split(), fp_print=FP, rawHeaders=HEADERS, edge=7),
        ("d", 30): file(drop=("host", "time"), vhost="h.example", ts="1757000001", edge=7, fp_print=int(FP, 16), rawHeaders=[{"key": "host", "value": "h"}]),
        ("other", 5): file(ua=UA),
        ("other", 7): file(ua=UA),
    }
    assert found(table(spark, files)) == {
        ("d", 10, "ua", "renamed"), ("d", 10, "referer", "renamed"), ("d", 10, "referer", "retyped"), ("d", 10, "edge", "added"),
        ("d", 20, "ua", "renamed"), ("d", 20, "ua", "retyped"), ("d", 20, "referer", "removed"), ("d", 20, "tls_fp", "added"),
        ("d", 20, "headers", "added"), ("d", 20, "edge", "retyped"),
        ("d", 30, "ua", "removed"), ("d", 30, "host", "renamed"), ("d", 30, "time", "renamed"), ("d", 30, "time", "retyped"),
        ("d", 30, "tls_fp", "retyped"), ("d", 30, "headers", "retyped"),
    }


def test_broken_lines_nulls_and_repeats_change_nothing(spark):
    files = {("d", 0): file(), ("d", 1): [*file(), *file(), None, "", " ", "{", "not json", '{"ua": "x"} tail', '{"ua":1}{"ua":2}', "[1]", json.dumps(base(1) | {"ua": None})]}
    assert found(table(spark, files)) == set()
    assert found(table(spark, {("d", 0): ["{"], ("d", 1): file(drop=tuple(base(0))[1:])})) == {("d", 1, "status", "added")}
    assert found(table(spark, files).limit(0)) == set()
    assert drift.unify(table(spark, files).limit(0)).count() == 0


def test_renamed_field_without_a_place(spark):
    files = {("d", 0): file(req_id="12"), ("d", 1): file(request_id="13"), ("d", 2): file(latency_ms=5)}
    assert found(table(spark, files)) == {("d", 1, "request_id", "renamed"), ("d", 2, "request_id", "removed"), ("d", 2, "latency_ms", "added")}


def test_unify_reads_every_form(spark):
    number = int.from_bytes(bytes.fromhex(FP), "little")
    files = {
        ("d", 100): file(1, ua=UA, referer=URL, headers=HEADERS, tls_fp=FP, location="DE", proto=2, body="ab"),
        ("d", 200): file(1, agent=UA.split(" "), ref=[URL], hdrs=[{"key": "host", "value": "h.example"}, {"key": "accept", "value": "a:b"}], ja=list(bytes.fromhex(FP)), proto="Https", body=[97, 98]),
        ("d", 300): file(1, http_referer={"url": URL, "len": 3}, rawHeaders={"host": "h.example", "accept": "x"}, print_=number, geo={"cc": "DE"}),
        ("d", 400): [{"status": "404", "port": "77", "time": "1757000009", "method": "GET", "uri": "/x", "ip": "::1"}],
        ("d", 500): ["broken", None],
    }
    rows = {r.position: r for r in drift.unify(table(spark, files)).collect()}
    assert set(rows) == {100, 200, 300, 400}
    for p in (100, 200):
        r = rows[p]
        assert (r.ua, r.referer, bytes(r.tls_fp).hex(), r.proto, bytes(r.body)) == (UA, URL, FP, 2, b"ab")
    assert [tuple(h) for h in rows[100].headers] == [("host", "h.example"), ("user-agent", "libfetch/1.2"), ("accept", "*/*")]
    assert [tuple(h) for h in rows[200].headers] == [("host", "h.example"), ("accept", "a:b")]
    assert rows[300].referer == URL and rows[300].location == "DE" and bytes(rows[300].tls_fp).hex() == FP and len(rows[300].headers) == 2
    r = rows[400]
    assert (r.status, r.port, r.time, r.ip4, bytes(r.ip), r.host, r.proto, r.headers, bytes(r.tls_fp)) == (404, 77, 1757000009, None, b"\0" * 15 + b"\1", "", 0, [], b"\0" * 16)


def fields(**values):
    return [drift._field_of(n, drift._json_type(v), dict.fromkeys(drift.properties_of(v if isinstance(v, str) else json.dumps(v)), 1)) for n, v in values.items()]


def test_flooding_settles_and_selects_one_to_one(spark):
    target = drift.target_of(drift.profiles(table(spark, {}).limit(0)))
    names = [t.name for t in target]
    left = [fields(agent=UA, x=URL), fields(y=HEADERS)]
    score = flooding.flood(left, target)
    assert score.shape == (2, 2, len(target)) and 0 <= score.min() and score.max() <= 1
    assert flooding.select(score[0], names) == {0: "ua", 1: "referer"} and flooding.select(score[1][:1], names) == {0: "headers"}
    assert flooding.flood([[]], target).shape == (1, 0, len(target))
    assert flooding.select(flooding.flood(left, target, propagate=False)[0], names) == {}  # the names alone say nothing here


def test_properties_are_those_of_the_jvm(spark):
    values = {"a": UA, "b": HEADERS, "c": "", "d": "Größe Ä9", "e": 39 * "7", "f": 12.5, "g": {"url": "x", "n": [1]}, "h": [{"k": 1}], "i": True, "j": int(39 * "1"), "k": "\x01", "l": "a\x01b", "m": "\x00"}
    got: dict = {}
    for r in drift.profiles(table(spark, {("d", 0): [values]})).collect():
        got.setdefault(r.name, set()).add(r.property)
    for name, v in values.items():
        text = v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))
        nested = {"kurl", "kn"} if name == "g" else {"kk"} if name == "h" else set()
        assert got[name] == {*drift.properties_of(text), *nested}, name


def test_propagation_decides(spark):
    files = {("d", 0): file(ua=UA, referer=URL), ("d", 1): file(agent=UA, origin=URL)}
    assert found(table(spark, files)) == {("d", 1, "ua", "renamed"), ("d", 1, "referer", "renamed")}
    without = {tuple(r) for r in drift.changes(table(spark, files), propagate=False).collect()}
    assert without == {("d", 1, n, c) for n, c in (("ua", "removed"), ("referer", "removed"), ("agent", "added"), ("origin", "added"))}


def test_files_far_apart_and_extra_columns(spark):
    files = {("d", 10**9 * i): file(**({"ua": UA} if i % 2 else {"agent": UA})) for i in range(6)}
    df = table(spark, files).selectExpr("*", "'x' AS name", "1 AS type", "'y' AS keys").repartition(5)
    assert found(df) == {("d", 10**9 * i, "ua", "renamed") for i in range(1, 6)}


@pytest.mark.parametrize("seed", range(3))
def test_shuffled_names_are_found_by_content(spark, seed):
    rng = random.Random(seed)
    names = [f"field_{rng.randrange(10**6)}" for _ in range(4)]
    values = {"ua": UA, "referer": URL, "headers": HEADERS, "tls_fp": FP}
    files = {("d", 0): file(**values), ("d", 1): file(**dict(zip(names, values.values(), strict=True)))}
    assert found(table(spark, files)) == {("d", 1, n, "renamed") for n in values}

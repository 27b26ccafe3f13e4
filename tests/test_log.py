"""Sources, sinks, views, merge, recent past of addresses, features, forest and streams."""

import ipaddress
import json
import math
import os
import random
from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hitlore import sinks
from hitlore.api import Log
from hitlore.functions import text
from hitlore.operators import forest, ipstats, merge, reqfeatures, views
from hitlore.plans import log_queries
from hitlore.schema import STORED
from hitlore.sources import entries
from hitlore.streaming import ingest

SF = "/root/testdata/sf0.001"
SAMPLE = {"status": 200, "method": "GET", "uri": "/", "ip": "100.30.240.108", "port": 53712, "time": 1786123989, "host": "site.example", "proto": "Https", "location": "FR", "tls_fingerprint": 0}


def stored(position, **k):
    base = dict(position=position, status=200, method="GET", uri=f"/p{position}", ua=None, referer=None, ip=bytes(10) + b"\xff\xff\x0a\0\0\1", ip4=0x0A000001, port=1, time=position, body=None, headers=[], host="h", proto=2, location=None, tls_fp=bytes(16))
    return tuple((base | k).values())


def log(spark, rows):
    return spark.createDataFrame(rows, STORED)


def test_json_lines_round_trip(spark, tmp_path):
    good = [
        SAMPLE | {"headers": "host:site.example\nno colon\nx:a:b\nx:c", "body": [1, 2, 255], "tls_fingerprint": 2**128 - 1, "extra": 5},
        SAMPLE | {"ip": "::1", "uri": "/a\nb", "location": "DE", "time": 3},
        {k: v for k, v in SAMPLE.items() if k not in ("time", "location", "tls_fingerprint")} | {"body": "text"},
    ]
    bad = [SAMPLE | {"status": 70000}, SAMPLE | {"proto": "Ftp"}, {k: v for k, v in SAMPLE.items() if k != "host"}, SAMPLE | {"ip": "1.2.3"}]
    lines = [*map(json.dumps, good), *map(json.dumps, bad), "not json", "", "[1]", json.dumps(SAMPLE) + "x"]
    (tmp_path / "user.log").write_text("\n".join(lines))
    own = Log.from_json_lines(spark, str(tmp_path / "user.log"), block_rows=2)
    own.write(str(tmp_path / "blocks"))
    back = Log.open(spark, str(tmp_path / "blocks"), 2)
    rows = back.rows.orderBy("position").collect()
    assert [r.position for r in rows] == [0, 1, 2] and [r.block_start for r in rows] == [0, 0, 2]
    assert [tuple(h) for h in rows[0].headers] == [("host", "site.example"), ("x", "a:b"), ("x", "c")] and bytes(rows[0].body) == b"\x01\x02\xff"
    assert bytes(rows[0].tls_fp) == b"\xff" * 16 and rows[1].uri == "/a\nb" and rows[1].ip4 is None and rows[1].location == "DE" and rows[0].location == "FR"
    assert rows[2].time == 0 and rows[2].location is None and bytes(rows[2].tls_fp) == bytes(16) and bytes(rows[2].body) == b"text"
    assert [r.position for r in back.get(1).collect()] == [1] and back.sync(1).first().start == 2
    merged = Log.merged([back, back], 4).rows.orderBy("position").collect()
    assert [r.time for r in merged] == [0, 0, 3, 3, SAMPLE["time"], SAMPLE["time"]] and [r.block_start for r in merged] == [0, 0, 0, 0, 4, 4]


def test_older_blocks_get_defaults(spark, tmp_path):
    old = log(spark, [stored(0, ua="x")]).drop("headers", "host", "proto", "location", "tls_fp")
    sinks.write_blocks(old, str(tmp_path / "b"), block_rows=10)
    sinks.write_blocks(log(spark, [stored(10)]).withColumn("later", F.lit(1)), str(tmp_path / "b"), block_rows=10)
    rows = sinks.read_blocks(spark, str(tmp_path / "b")).orderBy("position").collect()
    assert (rows[0].ua, rows[0].headers, rows[0].host, rows[0].proto, rows[0].location, bytes(rows[0].tls_fp)) == ("x", [], "", 0, None, bytes(16))
    assert rows[1].proto == 2 and "later" not in rows[0]


def test_label_file(spark, tmp_path):
    (tmp_path / "labels.json").write_text('{"5": true, "3": false, "9": null}')
    assert [tuple(r) for r in entries.label_file(spark, str(tmp_path / "labels.json")).collect()] == [(0, 5, True), (1, 3, False), (2, 9, None)]


def test_display_forms(spark):
    addresses = ["::1", "::", "1::", "2001:db8::1", "1:0:0:2:0:0:0:3", "0:0:1::", "1:0:2:0:3:0:4:0", "1:2:3:4:5:6:7:8", "fe80::1:0:0:1", "1.2.3.4"]
    rows = []
    for a in addresses:
        ip = ipaddress.ip_address(a)
        rows.append((a, ip.packed if ip.version == 6 else bytes(10) + b"\xff\xff" + ip.packed, int(ip) if ip.version == 4 else None))
    got = spark.createDataFrame(rows, "a string, ip binary, ip4 long").select("a", text.format_ip(F.lower(F.hex("ip")), F.col("ip4")).alias("t")).collect()
    assert {r.a: r.t for r in got} == {a: str(ipaddress.ip_address(a)) for a in addresses}
    times = {0: "1970-01-01 00:00:00", 1786123989: "2026-08-07 17:33:09", 253402300800: "Invalid time 253402300800", None: None}
    got = spark.createDataFrame([(t,) for t in times], "t long").select("t", text.format_time(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == times
    row = spark.createDataFrame([(b"\x00\x01" + b"A" * 16,)], "b binary").select(text.hex_view("b").alias("d"), text.fingerprint_hex(F.col("b")).alias("f")).first()
    assert row.d.splitlines()[0].startswith("00000000  00 01 41") and row.d.splitlines()[1].startswith("00000010  41 41") and row.f.endswith("0100")


def test_fingerprints_are_reversed_by_bytes(spark):
    raw = bytes(range(120, 136)) * 2  # bytes that are no UTF-8
    assert spark.createDataFrame([(raw,)], "b binary").select(text.fingerprint_hex(F.col("b")).alias("f")).first().f == raw[::-1].hex()


def test_newer_blocks_are_refused(spark, tmp_path):
    sinks.write_blocks(log(spark, [stored(0)]), str(tmp_path / "b"), version=99)
    with pytest.raises(Exception, match="block of version 99"):
        sinks.read_blocks(spark, str(tmp_path / "b")).collect()


def test_seal_and_flush(spark, tmp_path):
    source, out, state, store = (str(tmp_path / x) for x in ("in", "out", "state", "store"))
    columns = "entry_id long, status int, method string, uri string, ip string, port int, time long, body binary, headers string, host string, proto string, location string, tls_fingerprint string"
    positions = lambda: sorted(r.position for r in sinks.read_blocks(spark, store).collect())
    assert ingest.seal(spark, out, store, block_rows=10, flush=True) == 0  # nothing yet
    for at, want in ((0, 20), (25, 50)):
        rows = [(i, 200, "GET", f"/{i}", "1.2.3.4", 1, i, None, "a:b", "h", "Http", None, "7") for i in range(at, at + 25)]
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest(ingest.stream(spark, source), out, state, block_rows=10).awaitTermination()
        ingest.seal(spark, out, store, block_rows=10)
        assert positions() == list(range(want))
    assert ingest.end_of(spark, out) == 50 and ingest.seal(spark, out, store, block_rows=10, flush=True) == 0
    got = ingest.to_table(ingest.attach(spark, out, block_rows=20, backlog=5).select("position"), "attached")
    assert sorted(r.position for r in got.collect()) == list(range(35, 50))


def test_lines_of_a_socket_until_it_is_stopped(spark, tmp_path):
    import socket
    import threading

    server = socket.create_server(("127.0.0.1", 0))
    sent = [json.dumps(SAMPLE | {"uri": f"/{i}"}) for i in range(25)] + ["broken", json.dumps(SAMPLE | {"time": 2**64}), json.dumps(SAMPLE | {"uri": "/last", "time": None})]

    def serve():
        connection, _ = server.accept()
        connection.sendall(("\n".join(sent) + "\n").encode())

    threading.Thread(target=serve, daemon=True).start()
    live, store = str(tmp_path / "live"), str(tmp_path / "store")
    rows = ingest.lines(spark, "socket", host="127.0.0.1", port=str(server.getsockname()[1]))
    query = ingest.ingest(rows, live, str(tmp_path / "state"), block_rows=10, once=False)
    for _ in range(300):
        if ingest.end_of(spark, live) == 26:
            break
        query.awaitTermination(0.1)
    assert ingest.stop(query, spark, live, store, block_rows=10) == 26 and not query.isActive
    got = sinks.read_blocks(spark, store).orderBy("position").collect()
    assert [r.position for r in got] == list(range(26)) and {r.block_start for r in got} == {0, 10, 20}
    assert {r.uri for r in got} == {*(f"/{i}" for i in range(25)), "/last"} and [r.time for r in got if r.uri == "/last"] == [0]


def test_headers_split_and_join(spark):
    raw = ["a:b\nc:d:e\nnone\n:x\ny:", "", None, "no"]
    got = spark.createDataFrame([(r,) for r in raw], "r string").select(text.split_headers(F.col("r")).alias("h")).collect()
    assert [[tuple(p) for p in r.h] for r in got] == [[("a", "b"), ("c", "d:e"), ("", "x"), ("y", "")], [], [], []]


def test_pages(spark):
    df = log(spark, [stored(p, status=404 if p % 7 == 0 else 200) for p in range(100) if p not in (13, 14)]).repartition(5)
    at = lambda d: [r.position for r in d.collect()]
    assert views.end(df) == 100 and views.end(df.limit(0)) == 0
    page = views.Page(df, 5, 12)
    assert at(page.render()) == [12, 15, 16]
    assert page.scroll_by(-50)[0].start == 0 and page.scroll_by(500) == (views.Page(df, 5, 95), True) and at(page.scroll_to_end().render()) == [95, 96, 97, 98, 99]
    assert at(views.between(df, 90, 200, descending=True)) == list(range(99, 89, -1))
    view = views.FilteredPage(df, "status 404", rows=3, start=10)
    assert at(view.render()) == [21, 28, 35] and at(view.next(2)) == [42, 49]
    moved, ended = view.scroll_by(2)
    assert at(moved.render()) == [35, 42, 49] and not ended
    assert view.scroll_by(50)[1] and at(view.scroll_by(50)[0].render()) == [84, 91, 98]
    back, ended = moved.scroll_by(-2)
    assert at(back.render()) == [21, 28, 35] and not ended and back.scroll_by(-9) == (views.FilteredPage(df, "status 404", 3, 0), True)
    assert at(view.scroll_to_end().render()) == [84, 91, 98] and at(views.FilteredPage(df.limit(0), None, 3).scroll_to_end().render()) == []
    assert at(view.set_filter(None).render()) == [10, 11, 12]
    assert [p for w in view.windows(8) for p in at(w)] == [21, 28, 35, 42, 49, 56, 63, 70, 77, 84, 91, 98]
    assert at(views.with_backlog(df, 30, 5)) == list(range(85, 100)) and tuple(views.sync(df, 30, 5).first()) == (90, 30, 0, 85)


def test_merge_is_ordered_and_stable(spark):
    a = log(spark, [stored(0, time=1, uri="a0"), stored(1, time=2, uri="a1"), stored(2, time=10, uri="a2"), stored(3, time=11, uri="a3")])
    b = log(spark, [stored(0, time=2, uri="b0"), stored(1, time=4, uri="b1"), stored(2, time=None, uri="b2")])
    got = merge.merge_logs([a, b], block_rows=3).orderBy("position").collect()
    assert [r.uri for r in got] == ["b2", "a0", "a1", "b0", "b1", "a2", "a3"] and [r.block_start for r in got] == [0, 0, 0, 3, 3, 3, 6]
    assert merge.merge_logs([a.limit(0)]).count() == 0


def plain_stats(rows, most):
    seen, out = {}, {}
    for position, ip, time, uri, agent in rows:
        q = seen.setdefault(ip, deque())
        q.append((time, uri, agent))
        while q[0][0] < max(time - 300, 0):
            q.popleft()
        while len(q) > most:
            q.popleft()
        static = sum(e[1].split("?")[0].endswith(".css") for e in q)
        out[position] = (sum(e[0] >= max(time - 60, 0) for e in q), len(q), len({e[1] for e in q}), len({e[2] for e in q}), static / len(q))
    return out


@pytest.mark.parametrize(("jitter", "most"), [(0, 1000), (0, 7), (200, 1000), (200, 7)])
def test_ip_stats_against_a_plain_queue(spark, jitter, most):
    rng, t, plain, rows = random.Random(5), 1000, [], []
    for p in range(500):
        t += rng.choice([0, 0, 0, 1, 5, 40, 400])
        time, ip = t + rng.randrange(-jitter, jitter + 1), rng.choice([b"\1" * 16] * 4 + [b"\2" * 16, b"\3" * 16])
        uri, agent = rng.choice(["/a", "/b.css?x", "/c"]), rng.choice(["x", "y", None])
        plain.append((p, ip, time, uri, agent or ""))
        rows.append(stored(p, ip=ip, time=time, uri=uri, headers=[("User-Agent", agent), ("user-agent", "later")] if agent else [("accept", "x")]))
    df = log(spark, rows).repartition(6)
    want = plain_stats(plain, most)
    assert {r.position: tuple(r)[2:] for r in ipstats.exact(df, most=most).collect()} == want
    if not jitter:
        assert {r.position: tuple(r)[2:] for r in ipstats.ordered(df, most=most, chunk=max(50, most)).collect()} == want
    assert ipstats.exact(df.limit(0)).count() == 0


@pytest.mark.parametrize(("jitter", "most", "seed"), [(0, 30, 1), (400, 30, 2), (4000, 40, 3), (100_000, 25, 4)])
def test_chunks_of_a_busy_address(spark, jitter, most, seed):
    """Old events behind young ones keep fronts apart over many chunks."""
    rng, t, plain, rows = random.Random(seed), 10**6, [], []
    for p in range(900):
        t += rng.choice([0, 1, 5, 30])
        time, ip = t + rng.randrange(-jitter, jitter + 1), rng.choice([b"\1" * 16] * 6 + [b"\2" * 16])
        plain.append((p, ip, time, f"/{p % 9}", ""))
        rows.append(stored(p, ip=ip, time=time, uri=f"/{p % 9}"))
    df = log(spark, rows).repartition(6)
    assert {r.position: tuple(r)[2:] for r in ipstats.exact(df, most=most, chunk=50).collect()} == plain_stats(plain, most)


def test_fronts_are_those_of_a_queue():
    rng = random.Random(8)
    for _ in range(60):
        most, first = rng.randrange(2, 9), rng.randrange(0, 12)
        first = min(first, most)
        times = [1000 + rng.randrange(0, 900) for _ in range(first + rng.randrange(1, 25))]
        pairs = ipstats.fronts(times, first, most)
        for start in range(max(first - most, 0), first) or [0]:
            front = start
            for i in range(first, len(times)):
                while times[front] < max(times[i] - 300, 0):
                    front += 1
                front = max(front, i - most + 1)
            assert next(after for before, after in pairs if before >= start) == front


def test_features_of_the_sample(spark):
    names = ["host", "connection", "user-agent", "accept", "accept-language", "sec-fetch-mode", "pragma", "cache-control", "accept-encoding"]
    values = {"host": "site.example", "accept-language": "*", "user-agent": "Mozilla/5.0 (compatible; ExampleBot/1.0; +https://example.invalid/bot.html)"}
    row = stored(0, uri="/", port=53712, time=1786123989, host="site.example", headers=[(n, values.get(n, "v")) for n in names])
    r = reqfeatures.features(log(spark, [row]), reqfeatures.Known(("bot",))).first()
    want = {
        "header_count": 9, "sec_fetch_header_count": 1, "sec_ch_ua_present": 0, "has_ua": 1, "ua_claims_browser": 0, "ua_known_bot_substring": 1, "accept_present": 1,
        "accept_language_present": 1, "accept_language_is_wildcard": 1, "accept_encoding_present": 1, "connection_present": 1, "missing_common_header_count": 0,
        "header_order_exact_match_known_browser": 0, "header_name_jaccard_nearest_profile": 0.6, "tls_known_bot_fp": 0, "tls_known_browser_fp": 0, "tls_ua_mismatch": 0,
        "host_header_mismatch": 0, "uri_length": 1, "uri_query_param_count": 0, "uri_path_depth": 1, "uri_suspicious_pattern": 0, "method_get": 1, "method_post": 0,
        "method_other": 0, "status_is_error": 0, "body_present": 0, "body_len_log1p": 0, "port_is_common": 0, "proto_is_https": 1,
        "hour_sin": math.sin(2 * math.pi * 17 / 24), "hour_cos": math.cos(2 * math.pi * 17 / 24), "ip_req_rate_1m": 1, "ip_req_rate_5m": 1, "ip_unique_uris_5m": 1,
        "ip_unique_uas_5m": 1, "ip_static_asset_ratio_5m": 0, "ua_len": len(values["user-agent"]),
    }
    assert set(want) == set(reqfeatures.NAMES) and len(reqfeatures.NAMES) == 38
    assert {k: pytest.approx(r[k]) for k in want} == want


def test_features_take_nulls(spark):
    row = stored(1, headers=None, method="post", uri="/É?a=1&&b&", body=b"xy", port=443, proto=0, status=500, tls_fp=None)
    r = reqfeatures.static_features(log(spark, [row])).first()
    assert (r.header_count, r.uri_length, r.uri_query_param_count, r.method_post, r.method_other, r.body_present, r.port_is_common, r.status_is_error) == (0, 11, 2, 1, 0, 1, 1, 1)


def test_forest_votes(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.random(), rng.random(), rng.random()) for i in range(300)]
    df = spark.createDataFrame([(i, a, b, c, a + 0.1 * c > 0.55) for i, a, b, c in rows], "position long, a double, b double, c double, label boolean")
    settings = forest.Settings(trees=15, depth=4)
    model = forest.fit(df, ["a", "b", "c"], settings)
    forest.save(model, str(tmp_path / "m"))
    trees = forest.load(str(tmp_path / "m")).trees
    scored = forest.scored(df, trees).collect()

    def vote(node, x):
        while trees.column[node] >= 0:
            node = (trees.left if x[trees.column[node]] <= trees.threshold[node] else trees.right)[node]
        return trees.vote[node]

    want = [sum(vote(root, (r.a, r.b, r.c)) for root in trees.roots) / 15 for r in scored[:40]]
    assert [r.score for r in scored[:40]] == pytest.approx(want) and len(trees.roots) == 15
    ends = [*trees.roots[1:], len(trees.column)]
    for root, end in zip(trees.roots, ends, strict=True):
        assert len(set(trees.column[root:end]) - {-1}) <= 2  # 60 % of three columns, of each tree its own
    assert {c for c in trees.column if c >= 0} == {0, 1, 2}
    assert sum((r.score > 0.5) == r.label for r in scored) > 280
    top = max(forest.importance(spark, model).collect(), key=lambda r: r.importance)
    assert top.feature == "a"


def test_a_split_is_the_best_there_is():
    rng = np.random.default_rng(3)
    x, y, w = np.round(rng.random((40, 3)), 1), (rng.random(40) > 0.4).astype(float), rng.integers(1, 4, 40).astype(float)
    coded = [np.unique(x[:, i], return_inverse=True) for i in range(3)]
    examples = forest._Examples([c[0] for c in coded], [c[1] for c in coded], y)
    gini = lambda rows: 2 * (w * y)[rows].sum() * (w * (1 - y))[rows].sum() / w[rows].sum()
    whole = gini(np.ones(40, bool))
    tries = [(whole - gini(x[:, c] <= t) - gini(x[:, c] > t), c, t) for c in range(3) for t in (np.unique(x[:, c])[1:] + np.unique(x[:, c])[:-1]) / 2]
    gain, column, threshold = forest._best_split(examples, np.arange(40), w, np.arange(3))
    assert gain == pytest.approx(max(t[0] for t in tries)) and gain == pytest.approx(next(t[0] for t in tries if t[1] == column and t[2] == pytest.approx(threshold)))
    assert forest._best_split(examples, np.flatnonzero(y == 1), w, np.arange(3)) is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_registered_verdicts_are_those_of_the_whole_forest(spark):
    _, model = log_queries._model(spark, SF)
    assert len(model.trees.roots) == forest.Settings().trees == 200


def test_labels_and_verdicts(spark):
    labels = spark.createDataFrame([(0, 1, True), (1, 1, False), (2, 1, True), (3, 99, True), (4, 2, None)], "label_pos int, position long, label boolean")
    got = forest.labelled(log(spark, [stored(1), stored(2)]).select("position", "uri"), labels).orderBy("label_pos").collect()
    assert [(r.label_pos, r.label) for r in got] == [(0, True), (1, False), (2, True)]
    s = spark.createDataFrame([(x,) for x in (0.0, 0.25, 0.5, 0.75, 1.0)], "s double").select(
        forest.verdict(F.col("s")).alias("v"), forest.verdict(F.col("s"), inverted=True).alias("i"), forest.verdict(F.col("s"), human_max=0.3, bot_min=0.5).alias("n")
    )
    assert [tuple(r) for r in s.collect()] == [("human", "bot", "human"), ("human", "bot", "human"), ("uncertain", "uncertain", "bot"), ("bot", "human", "bot"), ("bot", "human", "bot")]


def test_streams(spark, tmp_path):
    rng, source = random.Random(4), tmp_path / "in"
    rows = [stored(p, ip=bytes([rng.randrange(3)]) * 16, time=p * 20 + rng.randrange(200), status=404 if p % 3 == 0 else 200) for p in range(120)]
    for i in range(0, 120, 40):
        log(spark, rows[i : i + 40]).coalesce(1).write.mode("append").parquet(str(source))
    got = ingest.to_table(ingest.live_ip_stats(ingest.stream(spark, str(source), files_at_once=1)), "t")
    whole = {r.position: tuple(r) for r in ipstats.exact(log(spark, rows)).collect()}
    assert {r.position: tuple(r) for r in got.collect()} == whole
    out, state = str(tmp_path / "kept"), str(tmp_path / "state")
    ingest.follow(ingest.stream(spark, str(source)), "status 404 & time - 1 h ..", out, state, now=5000).awaitTermination()
    assert sorted(r.position for r in spark.read.parquet(out).collect()) == [p for p, r in enumerate(rows) if p % 3 == 0 and r[9] >= 1400]


def test_a_busy_address_of_a_stream_comes_in_pieces(monkeypatch):
    monkeypatch.setattr(ingest, "PIECE", 70, raising=False)

    class State:
        exists = hasTimedOut = False

        def update(self, value):
            self.value = value

    order = random.Random(6).sample(range(500), 500)
    frame = pd.DataFrame({"position": order, "ip": [b"x"] * 500, "time": [p * 7 for p in order], "u": [p % 11 for p in order], "a": 1, "s": [p % 2 == 0 for p in order]})
    state, memory = State(), ipstats.Recent(20)
    pieces = list(ingest._advance((b"x",), iter([frame[:200], frame[200:]]), state, 20, None))
    got = pd.concat(pieces)
    assert max(map(len, pieces)) == 70 and got["position"].tolist() == list(range(500))
    assert [tuple(r) for r in got[list(ipstats.NAMES)].itertuples(index=False)] == [memory.add(p * 7, p % 11, 1, p % 2 == 0) for p in range(500)]
    assert state.value == tuple(map(list, zip(*memory.events, strict=True)))


def test_ingest_goes_on_after_a_restart(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    columns = "entry_id long, status int, method string, uri string, ip string, port int, time long, body binary, headers string, host string, proto string, location string, tls_fingerprint string"
    entry = lambda i: (i, 200 if i % 5 else None, "GET", f"/{i}", "1.2.3.4", 1, i, None, "a:b", "h", "Http", None, "7")
    for at in (0, 30):
        spark.createDataFrame([entry(i) for i in range(at, at + 30)], columns).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest(ingest.stream(spark, source), out, state, block_rows=10).awaitTermination()
    rows = spark.read.option("basePath", out).parquet(out).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(48)) and [r.uri for r in rows] == [f"/{i}" for i in range(60) if i % 5]
    assert {r.block_start for r in rows} == {0, 10, 20, 30, 40}


def test_jobs(spark, tmp_path, capsys):
    from hitlore.__main__ import main

    rows = [stored(p, status=404 if p % 2 else 200, method="POST" if p % 2 else "GET", ip=bytes([p % 5]) * 16, time=1000 + p) for p in range(40)]
    for i in (0, 1):
        sinks.write_blocks(log(spark, rows[i * 20 : i * 20 + 20]), str(tmp_path / f"log{i}"), block_rows=20)
    main(["merge", "-o", str(tmp_path / "all"), "-b", "10", "-i", str(tmp_path / "log0"), str(tmp_path / "log1")])
    merged = Log.open(spark, str(tmp_path / "all"), 10)
    assert [r.uri for r in merged.rows.orderBy("position").collect()] == [f"/p{p}" for p in range(40)]
    (tmp_path / "labels.json").write_text(json.dumps({str(p): bool(p % 2) for p in range(0, 40, 3)}))
    for more in ([], ["--labelled-only"]):
        main(["train", "-l", str(tmp_path / "all"), "--labels", str(tmp_path / "labels.json"), "-m", str(tmp_path / "model"), "--trees", "5", *more])
    capsys.readouterr()
    main(["score", "-l", str(tmp_path / "all"), "-m", str(tmp_path / "model"), "--first", "10", "--beyond", "14"])
    shown = [line.split("|")[1:4] for line in capsys.readouterr().out.splitlines() if line.startswith("|1")]
    assert [int(x[0]) for x in shown] == [10, 11, 12, 13] and [x[2].strip() for x in shown] == ["human", "bot", "human", "bot"]


def test_training_on_labelled_rows_alone(spark):
    rows = [stored(p, time=1000 + p) for p in range(10)]
    labels = spark.createDataFrame([(0, 9, True), (1, 2, False)], "label_pos int, position long, label boolean")
    whole = {r.position: r.ip_req_rate_5m for r in forest.training_rows(log(spark, rows), labels).collect()}
    alone = {r.position: r.ip_req_rate_5m for r in forest.training_rows(log(spark, rows), labels, labelled_only=True).collect()}
    assert whole == {9: 10.0, 2: 3.0} and alone == {9: 1.0, 2: 2.0}


def test_places_are_deleted_at_the_end():
    """A session of its own, because deletion comes with the end of the JVM."""
    import subprocess
    import sys
    import tempfile
    from pathlib import Path

    root = tempfile.mkdtemp()
    code = f"""
from hitlore.session import local_session, place, bucketed
spark = local_session("1", "1g", **{{"spark.checkpoint.dir": "file://{root}", "spark.sql.shuffle.partitions": "2"}})
df = bucketed(spark.range(10).withColumnRenamed("id", "k"), "k")
assert df.join(df.withColumnRenamed("k", "j"), df.k == 3).count() == 10
import os
print("there", sum(x.startswith("hitlore-") for x in os.listdir("{root}")))
spark.stop()
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=str(Path(__file__).resolve().parent.parent), timeout=120)
    assert "there 1" in done.stdout, done.stderr[-2000:]
    assert not [x for x in os.listdir(root) if x.startswith("hitlore-")]

"""Operators against brute force on small tables: nulls, ties, repeated rows, empty tables, extra columns."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitlore.operators import events, frequent, positions, sessions, sketch, skew, trailing

random.seed(7)


def test_feature_table(spark):
    rows = [(random.choice("abcde" + "a" * 5), random.choice([None, "x", "y", "z", "", "w w"]), random.choice([None, 1, 5, 9]), random.choice([None, 2, 3])) for _ in range(400)]
    rows += [(None, "x", 1, 1)]
    df = spark.createDataFrame(rows, "entity string, event_type string, time long, amount long").withColumn("block", F.lit("clash"))
    entities = spark.createDataFrame([(e,) for e in "abcdd"] + [("lonely",), (None,)], "entity string").withColumn("block_0", F.lit(1))
    table = events.feature_table(df, entities, blocks=3)
    assert table.columns == ["entity", "block_0", "block_1", "block_2"]
    assert sorted(r.entity for r in table.select("entity").collect()) == ["a", "b", "c", "d", "lonely"]
    want = defaultdict(lambda: [0, None, 0])
    for e, t, time, amount in rows:
        if e in set("abcd"):
            w = want[e, t or ""]
            w[0] += 1
            w[1] = max((x for x in (w[1], time) if x is not None), default=None)
            w[2] += amount or 0
    assert {(r.entity, r.event_type): [r.n, r.last, r.total] for r in events.unfold(table).collect()} == dict(want)
    assert events.feature_table(df.limit(0), entities, blocks=2).count() == 5
    assert events.feature_table(df, entities.limit(0), blocks=2).count() == 0


def test_feature_blocks_move_no_rows(spark):
    df = spark.createDataFrame([("a", "x", 1, 1)], "entity string, event_type string, time long, amount long")
    plan = events.feature_table(df, df.select("entity"), blocks=4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2  # the entity table; the feature blocks keep their placement


def test_most_frequent(spark):
    values = ["a"] * 50 + ["b"] * 20 + ["c"] * 20 + [None] * 30 + [f"r{i}" for i in range(40)]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "v string, w int").repartition(5)
    got = [(r.field, r.item, r.n, r.of) for r in frequent.most_frequent(df, {"v": F.col("v"), "w": F.col("w")}, 3).collect()]
    assert sorted(got) == [("v", "a", 50, 130), ("v", "b", 20, 130), ("v", "c", 20, 130), ("w", "0", 54, 160), ("w", "1", 53, 160), ("w", "2", 53, 160)]
    assert {r.item for r in frequent.heavy_items(df, {"v": F.col("v")}, 0.15).collect()} == {"a", "b", "c"}
    assert frequent.most_frequent(df.limit(0), {"v": F.col("v")}, 3).count() == 0
    assert [r.item for r in frequent.most_frequent(df.where("v like 'r%'"), {"v": F.col("v")}, 2).orderBy("item").collect()] == ["r0", "r1"]


@pytest.mark.parametrize("periods", [(7, 30), (1, 3)])
def test_trailing_totals(spark, periods):
    rows = [(random.choice("aaab"), random.randrange(-40, 120), random.choice([None, 0, 1, 4])) for _ in range(60)]
    rows += [("single", 5, 2), ("null", None, 3), (None, 3, 3), ("twice", 9, 1), ("twice", 9, 2)]
    df = spark.createDataFrame(rows, "entity string, day int, n long").withColumn("bucket", F.lit("clash"))
    got = {(r.entity, r.day): tuple(r[f"total_{p}"] for p in periods) for r in trailing.trailing_totals(df, periods).collect()}
    daily = Counter()
    for e, d, n in rows:
        if e is not None and d is not None:
            daily[e, d] += n or 0
    want = {}
    for e in {e for e, _ in daily}:
        days = [d for x, d in daily if x == e]
        for d in range(min(days), max(days) + 1):
            want[e, d] = tuple(sum(daily[e, x] for x in range(d - p + 1, d + 1)) for p in periods)
    assert got == want
    assert trailing.trailing_totals(df.limit(0), periods).count() == 0


def brute_sessions(rows, gap):
    by = defaultdict(list)
    for e, t, i in rows:
        if e is not None and t is not None:
            by[e].append((t, i))
    out = []
    for e, xs in by.items():
        xs.sort(key=lambda x: x[0])
        run = [xs[0]]
        for x in xs[1:]:
            if x[0] - run[-1][0] > gap:
                out.append((e, run))
                run = []
            run.append(x)
        out.append((e, run))
    return {(e, r[0][0], r[-1][0], r[-1][0] - r[0][0], len(r), len({i for _, i in r if i is not None})) for e, r in out}


@pytest.mark.parametrize(("gap", "chunk"), [(10, 25), (10, 7), (30, 1000), (0, 5)])
def test_sessions(spark, gap, chunk):
    rows = [(random.choice("aaaab"), random.choice([None, *range(-50, 400)]), random.choice([None, "x", "y", "z"])) for _ in range(150)]
    rows += [(None, 1, "x"), ("tie", 5, "x"), ("tie", 5, "x"), ("tie", 5 + gap, "y"), ("tie", 5 + 2 * gap + 1, "y")]
    df = spark.createDataFrame(rows, "entity string, time long, item string").withColumn("chunk", F.lit("clash"))
    got = {tuple(r) for r in sessions.sessions(df, gap=gap, chunk=chunk).collect()}
    assert got == brute_sessions(rows, gap)
    assert sessions.sessions(df.limit(0), gap=gap, chunk=chunk).count() == 0


@pytest.mark.parametrize(("chunk_rows", "part_rows"), [(7, 20), (1, 1), (1000, 1000), (5, 3)])
def test_per_key(spark, chunk_rows, part_rows):
    rows = [(random.choice(["hot"] * 8 + ["a", "b", None]), s, random.choice([None, 5, 9, s]), random.choice([None, 1, 2]), random.choice([None, False, True, True])) for s in range(200)]
    rows += [("hot", None, 1, 1, True)]
    df = spark.createDataFrame(rows, "key string, seq long, time long, amount long, error boolean").withColumn("part", F.lit("clash"))
    want = {}
    for k in {"hot", "a", "b"}:
        own = sorted((r for r in rows if r[0] == k and r[1] is not None), key=lambda r: r[1])
        best = run = 0
        for r in own:
            run = run + 1 if r[4] else 0
            best = max(best, run)
        times = [r[2] for r in own if r[2] is not None]
        want[k] = (len(own), sum(r[3] or 0 for r in own), sum(bool(r[4]) for r in own), min(times, default=None), max(times, default=None), own[-1][1], best)
    got = {r.key: tuple(r)[1:] for r in skew.per_key(df, chunk_rows=chunk_rows, part_rows=part_rows).collect()}
    assert got == want
    assert skew.per_key(df.limit(0)).count() == 0


def test_sketches_estimate_and_merge(spark):
    sizes = {"a": 5000, "b": 700, "c": 3, "d": 64}
    rows = [(g, f"i{i % n}") for g, n in sizes.items() for i in range(n * 2)] + [("c", None), (None, "i1")]
    df = spark.createDataFrame(rows, "g string, item string").repartition(7).withColumn("h", F.lit("clash"))
    partial = sketch.partial_sketches(df, ["g"])
    got = {r.g: r for r in sketch.estimates(sketch.merge_sketches(partial, ["g"])).collect()}
    assert set(got) == {*sizes, None}
    for g, n in sizes.items():
        assert abs(got[g].estimate / n - 1) < 4 / math.sqrt(sketch.REGISTERS) and got[g].low <= n <= got[g].high
    assert round(got["c"].estimate) == 3 and round(got[None].estimate) == 1
    assert all(bytes(r.sketch)[:1] == b"R" for r in sketch.merge_sketches(partial, ["g"]).collect())  # registers for sets of any size
    whole = sketch.estimates(sketch.merge_sketches(partial, [])).first()
    assert whole.low <= 5000 <= whole.high  # the sets overlap: the largest holds the others
    assert sketch.distinct_counts(df.limit(0), ["g"]).count() == 0
    assert sketch.distinct_counts(df.limit(0), []).count() == 0


def test_sketch_forms_agree():
    hashes = np.unique(np.random.default_rng(1).integers(0, 2**63, 900).astype(np.uint64))
    whole = sketch.Sketch(512)
    whole.add(hashes)
    parts = [sketch.Sketch(512) for _ in range(30)]
    for i, p in enumerate(parts):
        p.add(hashes[i::30])
    merged = sketch.Sketch(512)
    for p in [*parts, whole]:
        merged.merge(p.part())
    assert merged.whole() == whole.whole()
    assert parts[0].part()[:1] == b"W" and whole.part()[:1] == b"R"


def test_estimates_are_unbiased_within_their_interval():
    rng, ratios, inside = np.random.default_rng(3), [], 0
    for _ in range(60):
        n = 3000
        own = sketch.Sketch(256)
        own.add(rng.integers(0, 2**63, n).astype(np.uint64))
        e, low, high = sketch.estimate_of(own.whole(), 2.0)
        ratios.append(e / n)
        inside += low <= n <= high
    assert abs(np.mean(ratios) - 1) < 0.03 and inside >= 50


def test_numbered(spark):
    df = spark.createDataFrame([(random.randrange(50), i) for i in range(300)], "t int, i int").repartition(6)
    got = positions.numbered(df, ["t", "i"], start=5).orderBy("position").collect()
    assert [r.position for r in got] == list(range(5, 305)) and [(r.t, r.i) for r in got] == sorted((r.t, r.i) for r in got)
    assert positions.numbered(df.limit(0), ["t", "i"]).count() == 0

"""What an address did in the five minutes before each of its requests, in the order of arrival.

An address remembers its events in a queue. Each event comes in at the back; then events leave at the front as long as the one
there is too old, and as long as there are too many. Times may come in any order, so an old event may stand behind a young one
and stay. What is remembered is therefore the rows from one place on, the front, and the front after a row depends on the rows
before it only through the front before it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlore.functions import text
from hitlore.operators.skew import numbered_within
from hitlore.session import cut

#: Seconds of the long and the short window, and the most events of an address that are remembered.
LONG, SHORT, MOST = 300, 60, 1000
#: Rows of an address that one task works on.
CHUNK = 50_000
NAMES = ("ip_req_rate_1m", "ip_req_rate_5m", "ip_unique_uris_5m", "ip_unique_uas_5m", "ip_static_asset_ratio_5m")
_OUT = "position long, ip binary, " + ", ".join(f"{n} double" for n in NAMES)


class Recent:
    """The remembered events of one address. Events leave only at the front, as they came in."""

    __slots__ = ("agents", "events", "most", "static", "times", "uris")

    def __init__(self, most: int = MOST):
        self.events: deque = deque()
        self.times: list[int] = []
        self.uris, self.agents, self.static, self.most = Counter(), Counter(), 0, most

    def _drop(self) -> None:
        time, uri, agent, static = self.events.popleft()
        del self.times[bisect_left(self.times, time)]
        for counts, key in ((self.uris, uri), (self.agents, agent)):
            counts[key] -= 1
            if not counts[key]:
                del counts[key]
        self.static -= static

    def remember(self, time: int, uri, agent, static: bool) -> None:
        """Take an event in; none leaves."""
        self.events.append((time, uri, agent, static))
        insort(self.times, time)
        self.uris[uri] += 1
        self.agents[agent] += 1
        self.static += static

    def add(self, time: int, uri, agent, static: bool) -> tuple[float, float, float, float, float]:
        self.remember(time, uri, agent, static)
        oldest = max(time - LONG, 0)
        while self.events[0][0] < oldest:
            self._drop()
        while len(self.events) > self.most:
            self._drop()
        n = len(self.events)
        recent = n - bisect_left(self.times, max(time - SHORT, 0))
        return float(recent), float(n), float(len(self.uris)), float(len(self.agents)), self.static / n


def fronts(times: list[int], first: int, most: int) -> list[tuple[int, int]]:
    """What a chunk of rows makes of the front: pairs of the front before its first row and the one after its last, by the highest
    of the fronts before that share one after.

    times are those of up to `most` rows before the chunk and of its own rows, which begin at place `first`; fronts are places in
    times. Fronts never fall back, so those that have met go on as one.
    """
    starts = list(range(max(first - most, 0), first)) or [0]
    now = list(starts)
    for i in range(first, len(times)):
        oldest, lowest = max(times[i] - LONG, 0), i - most + 1
        moved = []
        for f in now:
            while times[f] < oldest:
                f += 1
            moved.append(max(f, lowest))
        if len(moved) > 1 and moved[0] == moved[-1]:
            starts, moved = starts[-1:], moved[-1:]
        elif len(moved) > 1:
            last = [k for k in range(len(moved)) if k + 1 == len(moved) or moved[k] != moved[k + 1]]
            starts, moved = [starts[k] for k in last], [moved[k] for k in last]
        now = moved
    return list(zip(starts, now, strict=True))


def _prepared(log: DataFrame) -> DataFrame:
    agent = F.coalesce(text.header_value(F.col("headers"), "user-agent", first=True), F.lit(""))
    rows = log.where(F.col("position").isNotNull() & F.col("ip").isNotNull())
    time = F.coalesce("time", F.lit(0).cast("long")).alias("time")
    return rows.select("position", "ip", time, F.col("uri").alias("u"), agent.alias("a"), text.is_static(F.col("uri")).alias("s"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterable[tuple]]]:
    """Rows of batches that are sorted by ip and chunk, which are their first columns: the key and the rows of one batch."""
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        at = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i][:2] != rows[at][:2]:
                yield rows[at][:2], rows[at:i]
                at = i


def exact(log: DataFrame, *, most: int = MOST, chunk: int = CHUNK) -> DataFrame:
    """position, ip and the five numbers, for times in any order.

    Rows of an address are numbered by exact offsets, and a chunk of them is worked on in one task together with the `most` rows
    before it, all that its fronts can reach. First every chunk tells which front it makes of each front before it; these are
    put together along the chunks of an address, which gives each chunk its front; then the chunks are gone through, each by
    itself. So a busy address is spread over as many tasks as it has chunks. A first chunk needs none of that. A chunk has at
    least `most` rows.

    Defined cases: rows with NULL position or ip are left out; a NULL time counts as 0; missing headers are no agent; an empty
    table gives no rows.
    """
    chunk = max(chunk, most)
    numbered = numbered_within(_prepared(log), "ip", "position")
    own = F.floor(F.col("row_no") / chunk)
    near_end = F.col("row_no") % chunk >= max(chunk - most, 0)
    shared = numbered.withColumn("chunk", F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))))
    # What comes before the last chunk of an address alone makes no chunk.
    row = ["ip", "chunk", "row_no", "position", "time", "u", "a", "s"]
    placed = cut(shared.select(*row).repartition("ip", "chunk").sortWithinPartitions("ip", "chunk", "row_no"))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, times, first, base = None, [], 0, 0

        def told() -> pa.RecordBatch:
            pairs = fronts(times, first, most)
            values = (key[0], key[1], [base + a for a, _ in pairs], [base + b for _, b in pairs])
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["ip", "chunk", "before", "after"])

        for own_key, rows in _groups(batches):
            if own_key != key:
                if key is not None and first < len(times):
                    yield told()
                key, times, first, base = own_key, [], 0, rows[0][2]
            times += [r[3] for r in rows]
            first += sum(r[2] < key[1] * chunk for r in rows)
        if key is not None and first < len(times):
            yield told()

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ip, front = None, 0
        for batch in batches:
            out = []
            for own_ip, _, before, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own_ip != ip:
                    ip, front = own_ip, before[0]
                out.append(front)
                front = after[min(bisect_left(before, front), len(before) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["ip", "chunk", "front"])

    def go_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, memory = None, None
        for own_key, rows in _groups(batches):
            if own_key != key:
                key, memory = own_key, Recent(most)
            done = []
            for _, c, row_no, position, time, u, a, s, front in rows:
                if row_no >= c * chunk:
                    done.append((position, *memory.add(time, u, a, s)))
                elif row_no >= front:
                    memory.remember(time, u, a, s)
            columns = [pa.array([d[0] for d in done], pa.int64()), pa.array([key[0]] * len(done), pa.binary()), *(pa.array([d[i] for d in done], pa.float64()) for i in range(1, 6))]
            yield pa.RecordBatch.from_arrays(columns, names=["position", "ip", *NAMES])

    firsts = placed.where("chunk = 0").select(*row, F.lit(0).cast("long").alias("front")).mapInArrow(go_through, _OUT)
    if placed.where("chunk > 0").isEmpty():
        return firsts
    # Every chunk of a busy address tells, the first too: it gives the front of the second.
    told = placed.select("ip", "chunk", "row_no", "time").join(_several(placed), "ip", "left_semi")
    maps = told.repartition("ip", "chunk").sortWithinPartitions("ip", "chunk", "row_no").mapInArrow(tell, "ip binary, chunk long, before array<long>, after array<long>")
    known = maps.repartition("ip").sortWithinPartitions("ip", "chunk").mapInArrow(put_together, "ip binary, chunk long, front long")
    later = placed.where("chunk > 0").join(known, ["ip", "chunk"]).select(*row, "front").repartition("ip", "chunk").sortWithinPartitions("ip", "chunk", "row_no")
    return firsts.unionByName(later.mapInArrow(go_through, _OUT))


def _several(placed: DataFrame) -> DataFrame:
    """The addresses with rows of a second chunk."""
    return placed.where("chunk > 0").select("ip").distinct()


def ordered(log: DataFrame, *, most: int = MOST, chunk: int = CHUNK) -> DataFrame:
    """exact under its older name for logs whose times never go back within an address; nothing is gained by knowing that."""
    return exact(log, most=most, chunk=chunk)

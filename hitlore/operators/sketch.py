"""Distinct counts by sketches of minimum exponential values; partial sketches of any parts of the rows can be merged.

A sketch has m registers. Register j holds the minimum, over the items of the set, of an exponentially distributed hash
value of the item. The minimum of n such values is exponential with rate n, so the sum of the registers follows a gamma
distribution with shape m and rate n: (m - 1) / sum is an unbiased estimate of n with relative standard error
1 / sqrt(m - 2), and quantiles of the gamma distribution give a confidence interval. Two sketches are merged by taking the
minimum of each register, whatever the sets have in common.

The values of an item come in ascending order: they are the arrivals of a Poisson process of rate m, each of which falls on a
random register, so the first arrival at a register is exponential with rate 1. An item is done with as soon as its next
arrival is above the largest register, and a full sketch costs an item next to nothing.

Every count is read from registers, for sets of any size. A part of the rows that holds fewer items than a sketch has bytes
hands on the hashes of its items instead of the registers they give; they become registers when the parts are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Relative standard error of about 1.1 percent.
REGISTERS = 8192
#: Groups a task keeps before it gives its partial sketches away.
GROUPS_AT_ONCE = 20_000
#: Arrivals that are drawn at once.
AT_ONCE = 1 << 16
#: Items that come first into an empty sketch.
FIRST_BLOCK = 64
#: Registers are stored as steps of their binary logarithm: so many a doubling, counted from 2^-OCTAVES.
STEPS, OCTAVES = 512, 96
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def registers_for(error: float) -> int:
    """The registers that give a relative standard error of at most `error`, a power of two."""
    return 1 << max(4, math.ceil(math.log2(1 / error**2 + 2)))


def _mixed(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * _MIX[1]
        z = (z ^ (z >> np.uint64(27))) * _MIX[2]
        return z ^ (z >> np.uint64(31))


def fold(registers: np.ndarray, hashes: np.ndarray) -> None:
    """Lower the registers by the items of these hashes. The number of registers is a power of two.

    An item's arrivals are drawn by the splitmix64 generator seeded by its hash: low bits name the register, high bits give
    the time since the arrival before. Items come in blocks that double, because the largest register falls as they come; the
    items of the first block fill the registers together.
    """
    m = len(registers)
    done, size = 0, FIRST_BLOCK
    while done < len(hashes):
        live = hashes[done : done + size]
        done += len(live)
        size = min(done, 4096)
        time, drawn, top = np.zeros(len(live)), 0, registers.max()
        while len(live):
            want = int(m * top * 1.1) + 4 if np.isfinite(top) else AT_ONCE
            want = max(4, min(want, AT_ONCE // len(live)))
            with np.errstate(over="ignore"):
                z = _mixed(live[:, None] + np.arange(drawn + 1, drawn + want + 1, dtype=np.uint64)[None, :] * _MIX[0])
            waits = np.log(((z >> np.uint64(16)).astype(np.float64) + 0.5) * 2.0**-48)
            at = time[:, None] - np.cumsum(waits, axis=1) / m
            where = (z & np.uint64(m - 1)).astype(np.int64)
            low = at <= top
            np.minimum.at(registers, where[low], at[low])
            drawn, time, top = drawn + want, at[:, -1], registers.max()
            ahead = time < top
            live, time = live[ahead], time[ahead]


def _stored(registers: np.ndarray) -> bytes:
    """Registers rounded to steps of their logarithm. Rounding keeps their order, so it may come before or after merging."""
    steps = np.floor((np.log2(registers) + OCTAVES) * STEPS)
    return np.clip(steps, 0, 65535).astype(np.uint16).tobytes()


def _loaded(raw: bytes) -> np.ndarray:
    return np.exp2((np.frombuffer(raw, np.uint16) + 0.5) / STEPS - OCTAVES)


class Sketch:
    """A sketch being filled: registers, and hashes that wait to be folded in as long as they are the smaller part."""

    __slots__ = ("hashes", "m", "registers", "waiting")

    def __init__(self, m: int):
        self.m, self.hashes, self.waiting, self.registers = m, [], 0, None

    def _fold(self) -> None:
        if self.registers is None:
            self.registers = np.full(self.m, np.inf)
        if self.hashes:
            fold(self.registers, np.unique(np.concatenate(self.hashes)))
        self.hashes, self.waiting = [], 0

    def add(self, hashes: np.ndarray) -> None:
        """hashes: distinct item hashes."""
        self.hashes.append(hashes)
        self.waiting += len(hashes)
        if 8 * self.waiting > 2 * self.m:
            if self.registers is None:
                self.hashes = [np.unique(np.concatenate(self.hashes))]
                self.waiting = len(self.hashes[0])
            if 8 * self.waiting > 2 * self.m:
                self._fold()

    def merge(self, raw: bytes) -> None:
        if raw[:1] == b"W":
            self.add(np.frombuffer(raw, np.uint64, offset=1))
            return
        if self.registers is None:
            self.registers = np.full(self.m, np.inf)
        np.minimum(self.registers, _loaded(raw[1:]), out=self.registers)

    def part(self) -> bytes:
        """What a part of the rows hands on."""
        if self.registers is None:
            return b"W" + np.unique(np.concatenate(self.hashes)).tobytes()
        return self.whole()

    def whole(self) -> bytes:
        """The registers."""
        self._fold()
        return b"R" + _stored(self.registers)


def estimate_of(raw: bytes, z: float) -> tuple[float, float, float]:
    """Estimate and the bounds of its confidence interval at z standard deviations, from registers."""
    registers = _loaded(raw[1:])
    m, total = len(registers), float(registers.sum())
    # Gamma quantiles by the Wilson-Hilferty cube: shape m, unit scale.
    side = [m * (1 - 1 / (9 * m) + s * z / (3 * math.sqrt(m))) ** 3 for s in (-1, 1)]
    return (m - 1) / total, side[0] / total, side[1] / total


def _group_ids(table: pa.Table, names: Sequence[str]) -> tuple[np.ndarray, list[tuple]]:
    """A dense number for the key of each row, and the keys. NULL is a key of its own."""
    ids, keys = np.zeros(table.num_rows, np.int64), None
    columns = []
    for name in names:
        coded = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        columns.append((codes, coded.dictionary.to_pylist()))
        ids = ids * len(columns[-1][1]) + codes
    _, first, ids = np.unique(ids, return_index=True, return_inverse=True)
    keys = [tuple(values[codes[i]] for codes, values in columns) for i in first]
    return ids, keys


def _batch(schema: pa.Schema, keys: list[tuple], sketches: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k in keys], schema.field(i).type) for i in range(len(schema) - 1)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(sketches, pa.binary())], schema=schema)


def _given(groups: dict[tuple, Sketch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    keys = list(groups)
    for at in range(0, len(keys), 2000):
        some = keys[at : at + 2000]
        yield _batch(schema, some, [groups[k].part() for k in some])
    groups.clear()


def _arrow(names: Sequence[str]) -> pa.Schema:
    return pa.schema([*((n, pa.string()) for n in names), ("sketch", pa.binary())])


def partial_sketches(rows: DataFrame, by: Sequence[str], m: int = REGISTERS) -> DataFrame:
    """`by` columns (text) and sketch: partial sketches, one for each group of a task. rows has `by` and the text column item.

    Nothing is exchanged before this: a task reads its rows and leaves sketches, so a group that fills a third of all rows
    costs each task one sketch. A task keeps at most GROUPS_AT_ONCE sketches; beyond that it gives them away and goes on,
    which makes more partial results and the same total.
    """
    names, schema = list(by), _arrow(by)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, Sketch] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            ids, keys = _group_ids(table, names)
            hashes = table.column("h").to_numpy().view(np.uint64)
            order = np.lexsort((hashes, ids))
            ids, hashes = ids[order], hashes[order]
            fresh = np.ones(len(ids), bool)
            fresh[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])
            ids, hashes = ids[fresh], hashes[fresh]
            edges = np.searchsorted(ids, np.arange(len(keys) + 1))
            for i, key in enumerate(keys):
                groups.setdefault(key, Sketch(m)).add(hashes[edges[i] : edges[i + 1]])
            if len(groups) > GROUPS_AT_ONCE:
                yield from _given(groups, schema)
        yield from _given(groups, schema)

    item = F.xxhash64(F.col("item").cast("string"))
    read = rows.where(F.col("item").isNotNull()).select(*(F.col(n).cast("string").alias(n) for n in names), item.alias("h"))
    return read.mapInArrow(fill, ", ".join([*(f"`{n}` string" for n in names), "sketch binary"]))


def _merged(placed: DataFrame, names: Sequence[str], m: int, *, whole: bool) -> DataFrame:
    """One sketch for each group of rows that follow each other in a partition. A partition without rows gives none."""
    schema = _arrow(names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sketch, keys, done = None, None, [], []
        read = lambda: done.append(sketch.whole() if whole else sketch.part())
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
            for row, raw in zip(zip(*columns) if names else iter(lambda: (), None), batch.column(batch.schema.get_field_index("sketch")).to_pylist()):
                if sketch is None or row != key:
                    if sketch is not None:
                        keys.append(key)
                        read()
                    key, sketch = row, Sketch(m)
                sketch.merge(raw)
            if len(keys) >= 1000:
                yield _batch(schema, keys, done)
                keys, done = [], []
        if sketch is not None:
            keys.append(key)
            read()
        if keys:
            yield _batch(schema, keys, done)

    return placed.mapInArrow(merge, ", ".join([*(f"`{n}` string" for n in names), "sketch binary"]))


def merge_sketches(partial: DataFrame, by: Sequence[str], m: int = REGISTERS, *, width: int = 64) -> DataFrame:
    """One sketch (registers) per group of `by` from partial sketches; `by` may be fewer columns than they were made for.

    A group is merged in two steps: its parts are spread over `width` places by a hash of the part and merged there, then the
    at most `width` results of a group are merged. So a group of any number of parts is no task's whole work.
    """
    names = list(by)
    # Registers cost time, not bytes: a number of partitions that is given is not made fewer for being small.
    places = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = partial.select(*names, "sketch").withColumn("__place", F.pmod(F.xxhash64("sketch"), F.lit(width)).cast("string"))
    first = spread.repartition(places, *names, "__place").sortWithinPartitions(*names, "__place")
    parts = _merged(first, [*names, "__place"], m, whole=False).drop("__place")
    second = parts.repartition(places, *names).sortWithinPartitions(*names) if names else parts.coalesce(1)
    return _merged(second, names, m, whole=True)


def estimates(sketches: DataFrame, z: float = 4.0) -> DataFrame:
    """The columns of sketches but sketch, and estimate, low, high."""
    names = [c for c in sketches.columns if c != "sketch"]
    schema = pa.schema([*((n, pa.string()) for n in names), ("estimate", pa.float64()), ("low", pa.float64()), ("high", pa.float64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [estimate_of(raw, z) for raw in batch.column(batch.schema.get_field_index("sketch")).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([v[i] for v in values], pa.float64()) for i in range(3))], schema=schema)

    return sketches.mapInArrow(read, ", ".join([*(f"`{n}` string" for n in names), "estimate double", "low double", "high double"]))


def distinct_counts(rows: DataFrame, by: Sequence[str], *, m: int = REGISTERS, z: float = 4.0) -> DataFrame:
    """`by`, estimate, low, high: distinct items of each group, with a confidence interval at z standard deviations.

    Defined cases: a NULL item is no item; NULL in a group column is a group; no columns in `by` make one group of all
    rows, and no row if there are none; further columns are ignored; an empty table gives no rows.
    """
    return estimates(merge_sketches(partial_sketches(rows, by, m), by, m), z)

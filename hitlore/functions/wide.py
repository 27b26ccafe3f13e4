"""128-bit numbers as text and bytes, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BASE = 10**13


def u128_le(decimal: Column) -> Column:
    """The 16 little-endian bytes of a decimal number below 2^128; NULL for anything else.

    The number is three digits of base 10^13; eight divisions by 2^16 give its limbs, lowest first.
    """
    ok = decimal.rlike(r"\A[0-9]{1,39}\z")
    padded = F.lpad(F.when(ok, decimal), 39, "0")
    digit = lambda i: F.substring(padded, 13 * i + 1, 13).try_cast("long")
    start = F.struct(digit(0).alias("a"), digit(1).alias("b"), digit(2).alias("c"), F.lit("").alias("out"))

    def step(s: Column, _: Column) -> Column:
        t1 = (s["a"] % 65536) * F.lit(_BASE) + s["b"]
        t2 = (t1 % 65536) * F.lit(_BASE) + s["c"]
        limb = t2 % 65536
        byte = lambda x: F.lpad(F.hex(x), 2, "0")
        return F.struct(
            F.shiftright(s["a"], 16).alias("a"),
            F.shiftright(t1, 16).alias("b"),
            F.shiftright(t2, 16).alias("c"),
            F.concat(s["out"], byte(limb.bitwiseAND(255)), byte(F.shiftright(limb, 8))).alias("out"),
        )

    def finish(s: Column) -> Column:
        return F.when((s["a"] == 0) & (s["b"] == 0) & (s["c"] == 0), F.unhex(s["out"]))

    return F.when(ok, F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step, finish))

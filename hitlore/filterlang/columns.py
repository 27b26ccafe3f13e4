"""Filters to boolean Catalyst expressions that are never NULL: what is missing does not match, and `!` turns that round."""

from __future__ import annotations

import re
import time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitlore.filterlang.ast import Address, Combined, Field, Fingerprint, Header, Not, Number, Period, Protocol, Text
from hitlore.filterlang.parser import parse


def java_regex(pattern: str) -> str:
    """The pattern for Java: Unicode classes, a dot that stops at \\n alone, and a $ that is the end and not before a last line break.

    With (?m) a $ is the end of a line and stays.
    """
    if "m" in "".join(re.findall(r"\(\?([a-zA-Z]+)[):-]", pattern)):
        return "(?Ud)" + pattern
    out, inside, at, dots = [], 0, 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        inside += (c == "[") - (c == "]" and inside > 0)
        dots |= c == "." and not inside
        out.append(r"\z" if c == "$" and not inside else c)
        at += 1
    return ("(?Ud)" if dots else "(?U)") + "".join(out)


def text_test(c: Column, t: Text) -> Column:
    if t.kind == "equals":
        return c == F.lit(t.value)
    if t.kind == "prefix":
        return c.startswith(t.value)
    if t.kind == "suffix":
        return c.endswith(t.value)
    if t.kind == "contains":
        return c.contains(t.value)
    if t.kind == "regex":
        return c.rlike(java_regex(t.value))
    return F.levenshtein(c, F.lit(t.value), t.within) >= 0


def _number(c: Column, t: Number) -> Column:
    if t.low is not None and t.high == t.low + 1:
        return c == t.low
    bounds = ([] if not t.low else [c >= t.low]) + ([] if t.high is None else [c < t.high])
    return reduce(lambda a, b: a & b, bounds) if bounds else c.isNotNull()


def _field(f: Field, now: int) -> Column:
    t, c = f.test, F.col(f.name)
    if isinstance(t, Number):
        return _number(c, t)
    if isinstance(t, Text):
        return text_test(c, t)
    if isinstance(t, Address):
        ip4 = F.col("ip4")
        return ip4 == t.bits if t.mask == 0xFFFFFFFF else (ip4.bitwiseAND(F.lit(t.mask).cast("long")) == F.lit(t.bits).cast("long"))
    if isinstance(t, Period):
        bounds = ([] if t.start is None else [c >= F.lit(t.start.at(now)).cast("long")]) + ([] if t.end is None else [c < F.lit(t.end.at(now)).cast("long")])
        return reduce(lambda a, b: a & b, bounds) if bounds else c.isNotNull()
    if isinstance(t, Protocol):
        return c.isin(0, t.number)
    if isinstance(t, Fingerprint):
        return c == F.lit(bytes.fromhex(t.hex))
    if isinstance(t, Header):
        return F.exists(c, lambda h: F.coalesce((h["key"] == t.name) & text_test(h["value"], t.value), F.lit(False)))
    raise TypeError(f)


def compile_filter(f, *, now: int | None = None) -> Column:
    """The expression of a filter (text, AST or None) over the columns of the access log; it is never NULL.

    now is the moment that relative times refer to, by default that of the call. A comparison asks for a value first, so it is
    false where there is none, and both halves of it reach the scan.
    """
    now = int(time.time()) if now is None else now
    if f is None:
        return F.lit(True)
    return _exact(parse(f) if isinstance(f, str) else f, now)


def _exact(f, now: int) -> Column:
    if isinstance(f, Field):
        value = F.col("ip4") if isinstance(f.test, Address) else F.col("headers" if isinstance(f.test, Header) else f.name)
        return value.isNotNull() & _field(f, now)
    if isinstance(f, Not):
        return ~_exact(f.part, now)
    parts = [_exact(p, now) for p in f.parts]
    if f.op == "xor":
        return reduce(lambda a, b: a != b, parts)
    return reduce((lambda a, b: a & b) if f.op == "and" else (lambda a, b: a | b), parts)


def flag(f, *, now: int | None = None) -> Column:
    """compile_filter under its older name for projections."""
    return compile_filter(f, now=now)


def where(log: DataFrame, f, *, now: int | None = None) -> DataFrame:
    """The rows of the access log that a filter keeps."""
    return log.where(compile_filter(f, now=now))

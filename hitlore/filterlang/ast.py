"""Filters as values."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from hitlore.filterlang.errors import FilterError

U16 = 65535


@dataclass(frozen=True)
class Number:
    """low <= value < high; None for no bound. An exact value is (n, n + 1)."""

    low: int | None
    high: int | None

    @classmethod
    def exactly(cls, n: int) -> Number:
        return cls(n, n + 1)


@dataclass(frozen=True)
class Text:
    """kind is equals, prefix, suffix, contains, regex or similar; within is the edit distance of similar."""

    kind: str
    value: str
    within: int = 0


@dataclass(frozen=True)
class Address:
    """An IPv4 address of which only the bits of mask count."""

    bits: int
    mask: int


@dataclass(frozen=True)
class Moment:
    """Seconds since 1970, or seconds from now."""

    seconds: int
    relative: bool = False

    def at(self, now: int) -> int:
        return now + self.seconds if self.relative else self.seconds


@dataclass(frozen=True)
class Period:
    """start <= time < end."""

    start: Moment | None
    end: Moment | None


@dataclass(frozen=True)
class Protocol:
    """1 is http, 2 https; rows of unknown protocol match either."""

    number: int


@dataclass(frozen=True)
class Fingerprint:
    """16 bytes in stored order, as hex."""

    hex: str


@dataclass(frozen=True)
class Header:
    name: str
    value: Text


@dataclass(frozen=True)
class Field:
    """name is status, port, method, uri, host, location, ip, time, proto, tls_fp or headers."""

    name: str
    test: Number | Text | Address | Period | Protocol | Fingerprint | Header


@dataclass(frozen=True)
class Not:
    part: Any


@dataclass(frozen=True)
class Combined:
    """op is and, or or xor (an odd number of parts)."""

    op: str
    parts: tuple


_TEXT = {"Equals": "equals", "Prefix": "prefix", "Suffix": "suffix", "Contains": "contains", "Regex": "regex"}
_TEXT_FIELDS = {"Method": "method", "Uri": "uri", "Host": "host", "Location": "location"}
_NUMBER_FIELDS = {"Status": "status", "Port": "port"}
_V4_HIGH = 0xFFFF << 32


def _one(value: Any) -> tuple[str, Any]:
    if not isinstance(value, dict) or len(value) != 1:
        raise FilterError("syntax", f"one variant expected, found {value!r}")
    return next(iter(value.items()))


def _integer(value: Any, most: int = U16) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or not 0 <= value <= most:
        raise FilterError("integer", f"integer from 0 to {most} expected, found {value!r}")
    return value


def _text(value: Any) -> Text:
    kind, x = _one(value)
    if kind == "Similar":
        return Text("similar", str(x[0]), _integer(x[1], 2**31 - 1))
    if kind not in _TEXT or not isinstance(x, str):
        raise FilterError("syntax", f"unknown text filter {value!r}")
    if kind == "Regex":
        check_regex(x)
    return Text(_TEXT[kind], x)


def _moment(value: Any) -> Moment | None:
    if value is None:
        return None
    kind, x = _one(value)
    if kind not in ("Relative", "Absolute") or not isinstance(x, int):
        raise FilterError("syntax", f"unknown moment {value!r}")
    return Moment(x, kind == "Relative")


def from_json(value: Any):
    """A filter from its JSON form: one variant per object, such as {"Uri": {"Prefix": "/api"}} or {"And": [...]}.

    Range is [low, high), null for no upper bound; an address is {"bits": n, "mask": n} over 128 bits, v4-mapped; None is no filter.
    """
    if value is None:
        return None
    kind, x = _one(value)
    if kind == "Not":
        return Not(from_json(x))
    if kind in ("And", "Or", "Xor"):
        return Combined(kind.lower(), tuple(from_json(p) for p in x))
    if kind in _NUMBER_FIELDS:
        form, n = _one(x)
        test = Number.exactly(_integer(n)) if form == "Equals" else Number(_integer(n[0], U16 + 1), None if n[1] is None else _integer(n[1], U16 + 1))
        return Field(_NUMBER_FIELDS[kind], test)
    if kind in _TEXT_FIELDS:
        return Field(_TEXT_FIELDS[kind], _text(x))
    if kind == "Ip":
        if x["mask"] >> 32 != (1 << 96) - 1 or x["bits"] >> 32 != _V4_HIGH >> 32:
            raise FilterError("ipv4", "only v4-mapped addresses can be filtered")
        return Field("ip", Address(x["bits"] & 0xFFFFFFFF, x["mask"] & 0xFFFFFFFF))
    if kind == "Time":
        return Field("time", Period(_moment(x.get("start")), _moment(x.get("end"))))
    if kind == "Proto":
        return Field("proto", Protocol({"Http": 1, "Https": 2}[x]))
    if kind == "Header":
        return Field("headers", Header(x["header"], _text(x["filter"])))
    if kind == "Fingerprint":
        return Field("tls_fp", Fingerprint(bytes(x).hex()))
    raise FilterError("syntax", f"unknown filter {kind}")


def to_json(f) -> Any:
    """The JSON form of a filter."""
    if f is None:
        return None
    if isinstance(f, Not):
        return {"Not": to_json(f.part)}
    if isinstance(f, Combined):
        return {f.op.capitalize(): [to_json(p) for p in f.parts]}
    t = f.test
    text = lambda x: {"Similar": [x.value, x.within]} if x.kind == "similar" else {x.kind.capitalize(): x.value}
    if isinstance(t, Number):
        exact = t.low is not None and t.high == t.low + 1
        return {f.name.capitalize(): {"Equals": t.low} if exact else {"Range": [t.low or 0, t.high]}}
    if isinstance(t, Text):
        return {f.name.capitalize(): text(t)}
    if isinstance(t, Address):
        return {"Ip": {"bits": _V4_HIGH | t.bits, "mask": ((1 << 96) - 1) << 32 | t.mask}}
    if isinstance(t, Period):
        moment = lambda m: m and {"Relative" if m.relative else "Absolute": m.seconds}
        return {"Time": {"start": moment(t.start), "end": moment(t.end)}}
    if isinstance(t, Protocol):
        return {"Proto": "Http" if t.number == 1 else "Https"}
    if isinstance(t, Header):
        return {"Header": {"header": t.name, "filter": text(t.value)}}
    return {"Fingerprint": list(bytes.fromhex(t.hex))}


_UNSUPPORTED = re.compile(r"\(\?(?:[=!>]|<[=!])|(?<!\\)(?:\\\\)*\\[1-9]|[*+?}]\+")


def check_regex(pattern: str) -> None:
    """Refuse what a linear-time engine refuses, and what is no pattern at all."""
    if _UNSUPPORTED.search(pattern):
        raise FilterError("regex", f"look-around, back-references and possessive repeats are not supported: {pattern!r}")
    try:
        import regex as engine
    except ImportError:
        engine = re
    try:
        engine.compile(re.sub(r"\\z", r"\\Z", pattern))
    except Exception as e:
        raise FilterError("regex", f"bad pattern {pattern!r}: {e}") from e

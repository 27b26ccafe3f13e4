"""Scalar functions over log rows: headers, display forms, and tests of uris and agents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PAIR = "struct<key:string,value:string>"

# What an agent that claims to be a browser contains, what a scanner asks for, what a static file ends with.
BROWSER_PARTS = ("chrome", "firefox", "safari", "edg/", "edge")
SUSPICIOUS_PARTS = ("wp-login", "wp-admin", ".env", "/.git", "phpmyadmin", "xmlrpc.php", "/etc/passwd", "..%2f")
STATIC_ENDS = (".css", ".js", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".woff", ".ico")


def ascii_lower(c: Column) -> Column:
    """Only A-Z become lower case."""
    return F.translate(c, _UPPER, _LOWER)


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def contains_any(c: Column, parts: Sequence[str]) -> Column:
    """Whether any of the parts stands in c, in the same case; no parts, no match."""
    return any_of([c.contains(p) for p in parts])


def claims_browser(agent: Column) -> Column:
    return contains_any(ascii_lower(agent), BROWSER_PARTS)


def is_suspicious(uri: Column) -> Column:
    return contains_any(ascii_lower(uri), SUSPICIOUS_PARTS)


def is_static(uri: Column) -> Column:
    path = ascii_lower(F.substring_index(uri, "?", 1))
    return any_of([path.endswith(e) for e in STATIC_ENDS])


def split_headers(raw: Column) -> Column:
    """`key:value` lines as an array of pairs: split at the first colon, lines without one dropped, nothing trimmed. NULL is empty."""
    lines = F.filter(F.split(F.coalesce(raw, F.lit("")), "\n"), lambda x: x.contains(":"))
    pair = lambda x: F.struct(F.substring_index(x, ":", 1).alias("key"), F.substring(x, F.instr(x, ":") + 1, F.length(x)).alias("value"))
    return F.transform(lines, pair)


def join_headers(headers: Column) -> Column:
    return F.array_join(F.transform(headers, lambda h: F.concat(h["key"], F.lit(":"), h["value"])), "\n")


def header_value(headers: Column, name: str, *, first: bool = False) -> Column:
    """The last (or first) value of a header whose name is compared without ASCII case; NULL if there is none."""
    found = F.filter(headers, lambda h: ascii_lower(h["key"]) == name)
    return F.get(found, F.lit(0) if first else F.size(found) - 1)["value"]


def format_time(time: Column) -> Column:
    """YYYY-MM-DD HH:MM:SS in UTC, `Invalid time n` beyond the year 9999."""
    day = F.date_format(F.date_from_unix_date(F.floor(time / 86400).cast("int")), "yyyy-MM-dd")
    clock = F.concat_ws(":", *(F.lpad(x.cast("string"), 2, "0") for x in (F.floor(F.pmod(time, F.lit(86400)) / 3600), F.floor(F.pmod(time, F.lit(3600)) / 60), F.pmod(time, F.lit(60)))))
    return F.when(time.between(-62167219200, 253402300799), F.concat_ws(" ", day, clock)).otherwise(F.concat(F.lit("Invalid time "), time.cast("string")))


def format_ip(ip_hex: Column, ip4: Column) -> Column:
    """A dotted quad for a v4-mapped address, else the shortest IPv6 text: the first longest run of at least two zero groups is '::'."""
    quad = F.concat_ws(".", *(F.shiftright(ip4, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))
    groups = F.array(*(F.regexp_replace(F.substring(ip_hex, 4 * i + 1, 4), r"\A0{1,3}", "") for i in range(8)))
    text = F.array_join(groups, ":")
    short = text
    for n in range(2, 9):
        run = r"(?:\A|:)0(?::0){%d}(?::|\z)" % (n - 1)
        short = F.when(text.rlike(run), F.regexp_replace(text, rf"(?s)\A(.*?){run}(.*)\z", "$1::$2")).otherwise(short)
    return F.when(ip4.isNotNull(), quad).otherwise(short)


def fingerprint_hex(tls_fp: Column) -> Column:
    """The number a fingerprint is, as 32 hex digits: its bytes from last to first."""
    return F.lower(F.array_join(F.reverse(F.regexp_extract_all(F.hex(tls_fp), F.lit(".."), F.lit(0))), ""))


def hex_view(data: Column | str) -> Column:
    """A hex dump of 16 bytes a row: offset, bytes, printable characters; NULL for NULL, one empty row for no bytes."""
    data = F.col(data) if isinstance(data, str) else data

    def row(i: Column) -> Column:
        part = F.substring(data, i * 16 + 1, F.lit(16))
        spaced = F.trim(F.regexp_replace(F.hex(part), "(..)", "$1 "))
        shown = F.regexp_replace(F.decode(part, "ISO-8859-1"), "[^ -~]", ".")
        return F.concat(F.lpad(F.hex(i * 16), 8, "0"), F.lit("  "), F.rpad(spaced, 47, " "), F.lit("  "), shown)

    rows = F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length(data) / 16), F.lit(1)).cast("int") - 1)
    return F.when(data.isNotNull(), F.array_join(F.transform(rows, row), "\n"))

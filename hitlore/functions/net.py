"""Addresses, host names, routes: the parts of a request that have several spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"
_V4_PREFIX = "0" * 20 + "ffff"


def _let(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _quad_hex(quad: Column) -> Column:
    """8 hex digits of a dotted quad that is known to be well formed."""
    number = F.lit(0).cast("long")
    for i in range(1, 5):
        number = number * 256 + F.substring_index(F.substring_index(quad, ".", i), ".", -1).try_cast("long")
    return F.lpad(F.lower(F.hex(number)), 8, "0")


def _v6_hex(ip: Column) -> Column:
    def unquad(text: Column) -> Column:
        """A dotted quad at the end becomes two groups; one anywhere else leaves a dot, which is refused below."""
        tail = F.substring_index(text, ":", -1)
        head = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
        as_groups = _let(_quad_hex(tail), lambda h: F.concat(head, F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4)))
        return F.when(tail.rlike(rf"\A{_QUAD}\z"), as_groups).otherwise(text)

    def fill(text: Column) -> Column:
        """'::' becomes the groups of zeros it stands for: eight groups have seven colons."""
        colons = F.length(text) - F.length(F.replace(text, F.lit(":")))
        at_edge = F.startswith(text, F.lit("::")).cast("int") + F.endswith(text, F.lit("::")).cast("int")
        zeros = F.repeat(F.lit("0:"), F.lit(8) - colons + at_edge)
        filled = F.regexp_replace(text, "::", F.concat(F.lit(":"), zeros))
        trimmed = F.regexp_replace(filled, r"\A:|:\z", "")
        doubled = F.locate("::", text) > 0
        wrong = (F.lit(8) - colons + at_edge < 1) | text.contains(":::") | text.rlike("::.*::")
        return F.when(~doubled, text).when(~wrong, trimmed)

    def pad(text: Column) -> Column:
        zeroed = F.replace(F.concat(F.lit(":"), F.lower(text)), F.lit(":"), F.lit(":000"))
        return F.when(
            text.rlike(r"\A([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\z"), F.regexp_replace(zeroed, ":0{0,3}([0-9a-f]{4})(?![0-9a-f])", "$1")
        )

    whole = F.when(ip.contains("."), _let(ip, unquad)).otherwise(ip)
    return _let(_let(whole, fill), pad)


def once(value: Column) -> Column:
    """value, computed where it is written: Catalyst copies no nondeterministic expression into filters or later projections."""
    return F.concat(value, F.repeat(F.lit(""), F.spark_partition_id()))


def address_hex(ip: Column) -> Column:
    """32 lower-case hex digits of an IPv4 or IPv6 address, IPv4 as v4-mapped; NULL unless well formed.

    Rules: octets 0-255 without leading zeros; at most eight groups of one to four hex digits; at most one '::', which
    stands for at least one group; a dotted quad may be the last two groups; no zone, no brackets, no blanks.
    """
    return F.when(ip.rlike(rf"\A{_QUAD}\z"), F.concat(F.lit(_V4_PREFIX), _quad_hex(ip))).when(ip.contains(":"), _v6_hex(ip))


def ip4_of_hex(ip_hex: Column) -> Column:
    """The IPv4 number of a v4-mapped address, else NULL."""
    return F.when(F.substring(ip_hex, 1, 24) == _V4_PREFIX, F.conv(F.substring(ip_hex, 25, 8), 16, 10).cast("long"))


def host_name(host: Column) -> Column:
    """host in lower case without port and without one final dot."""
    lower = F.lower(host)
    return F.when(lower.rlike(r"(\.|:[0-9]*)\z"), F.regexp_replace(lower, r"\.?(:[0-9]*)?\z", "")).otherwise(lower)


def path_of(uri: Column) -> Column:
    """The path a uri addresses: no scheme, host, query or fragment; percent escapes decoded; letters in lower case.

    An escape that is not one stays as it is; a plus sign is a plus sign.
    """
    cut = F.substring_index(F.substring_index(uri, "#", 1), "?", 1)
    path = F.when(cut.contains("://"), F.regexp_replace(cut, r"\A[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")).otherwise(cut)
    safe = F.regexp_replace(F.replace(path, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.lower(F.when(path.contains("%"), F.coalesce(F.try_url_decode(safe), path)).otherwise(path))


def route(uri: Column) -> Column:
    """The first two segments of the path, joined by '/'; empty segments are ignored."""
    return F.array_join(F.slice(F.array_remove(F.split(path_of(uri), "/"), ""), 1, 2), "/")


#: Epoch seconds of the years 0000 to 9999: only such a time has a day.
FIRST_TIME, LAST_TIME = -62167219200, 253402300799


def day_of(time: Column) -> Column:
    """UTC calendar day as YYYY-MM-DD, whatever the session's zone; NULL for NULL, 0 and a time outside the years 0000 to 9999."""
    return F.date_format(date_of_day(day_number(time)), "yyyy-MM-dd")


def day_number(time: Column) -> Column:
    """Days since 1970-01-01 of epoch seconds; NULL for NULL, 0 and a time outside the years 0000 to 9999."""
    return F.when((time != 0) & time.between(FIRST_TIME, LAST_TIME), F.floor(time / F.lit(86400)).cast("int"))


def date_of_day(day: Column) -> Column:
    """The DATE of a day number."""
    return F.date_from_unix_date(day)

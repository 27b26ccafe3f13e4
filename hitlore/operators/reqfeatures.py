"""38 numbers that describe a request and what its address did before."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitlore.functions import text
from hitlore.operators import ipstats

#: The header order of three common browsers.
PROFILES = {
    "chrome_desktop": (
        "host", "connection", "sec-ch-ua", "sec-ch-ua-mobile", "sec-ch-ua-platform", "upgrade-insecure-requests", "user-agent",
        "accept", "sec-fetch-site", "sec-fetch-mode", "sec-fetch-user", "sec-fetch-dest", "accept-encoding", "accept-language",
    ),
    "firefox_desktop": (
        "host", "user-agent", "accept", "accept-language", "accept-encoding", "connection", "upgrade-insecure-requests",
        "sec-fetch-dest", "sec-fetch-mode", "sec-fetch-site", "sec-fetch-user",
    ),
    "safari_desktop": ("host", "accept", "sec-fetch-site", "accept-encoding", "accept-language", "user-agent", "connection"),
}
#: Headers that most browsers send.
COMMON = ("accept", "accept-language", "accept-encoding", "user-agent", "connection")
#: The names of the numbers a row gives, in their order.
STATIC_NAMES = (
    "header_count", "sec_fetch_header_count", "sec_ch_ua_present", "has_ua", "ua_len", "ua_claims_browser", "ua_known_bot_substring",
    "accept_present", "accept_language_present", "accept_language_is_wildcard", "accept_encoding_present", "connection_present",
    "missing_common_header_count", "header_order_exact_match_known_browser", "header_name_jaccard_nearest_profile", "tls_known_bot_fp",
    "tls_known_browser_fp", "tls_ua_mismatch", "host_header_mismatch", "uri_length", "uri_query_param_count", "uri_path_depth",
    "uri_suspicious_pattern", "method_get", "method_post", "method_other", "status_is_error", "body_present", "body_len_log1p",
    "port_is_common", "proto_is_https", "hour_sin", "hour_cos",
)
NAMES = STATIC_NAMES + ipstats.NAMES


@dataclass(frozen=True)
class Known:
    """Parts of agents of known bots (in the case given), and fingerprints (hex, stored order) of known bots and browsers."""

    bot_parts: Sequence[str] = ()
    bot_fingerprints: Sequence[str] = ()
    browser_fingerprints: Sequence[str] = ()


def static_columns(known: Known = Known()) -> dict[str, Column]:
    """The 33 numbers that depend on a row alone. Names of headers are compared without ASCII case; of repeated ones the last counts."""
    headers = F.coalesce(F.col("headers"), F.array().cast(f"array<{text.PAIR}>"))
    names = F.transform(headers, lambda h: text.ascii_lower(h["key"]))
    has = lambda n: F.array_contains(names, n)
    value = lambda n: text.header_value(headers, n)
    agent = F.coalesce(value("user-agent"), F.lit(""))
    near = []
    for profile in PROFILES.values():
        own = F.array(*map(F.lit, profile))
        near.append(F.size(F.array_intersect(names, own)) / F.greatest(F.size(F.array_union(names, own)), F.lit(1)))
    exact = reduce(lambda a, b: a | b, [names == F.array(*map(F.lit, p)) for p in PROFILES.values()])
    among = lambda prints: F.lower(F.hex("tls_fp")).isin(*prints) if prints else F.lit(False)
    browser = among(known.browser_fingerprints)
    uri, method = F.col("uri"), text.ascii_lower(F.col("method"))
    query = F.when(uri.contains("?"), F.substring(uri, F.instr(uri, "?") + 1, F.length(uri))).otherwise("")
    hour = F.floor(F.pmod(F.col("time"), F.lit(86400)) / 3600) / 24 * F.lit(2 * math.pi)
    body = F.coalesce(F.octet_length("body"), F.lit(0))
    columns = (
        F.size(headers), F.size(F.filter(names, lambda n: n.startswith("sec-fetch-"))), has("sec-ch-ua"), agent != "", F.octet_length(agent),
        text.claims_browser(agent), text.contains_any(agent, known.bot_parts), has("accept"), has("accept-language"),
        F.coalesce(value("accept-language") == "*", F.lit(False)), has("accept-encoding"), has("connection"),
        reduce(lambda a, b: a + b, [(~has(n)).cast("int") for n in COMMON]), exact, F.greatest(*near), among(known.bot_fingerprints), browser,
        text.claims_browser(agent) & ~browser & (F.col("proto") == 2), F.coalesce(value("host") != F.col("host"), F.lit(False)), F.octet_length(uri),
        F.size(F.filter(F.split(query, "&"), lambda x: x != "")), F.length(uri) - F.length(F.replace(uri, F.lit("/"))), text.is_suspicious(uri),
        method == "get", method == "post", ~method.isin("get", "post"), F.col("status") >= 400, body > 0, F.log1p(body.cast("double")),
        F.col("port").isin(80, 443), F.col("proto") == 2, F.sin(hour), F.cos(hour),
    )
    return {name: c.cast("double") for name, c in zip(STATIC_NAMES, columns, strict=True)}


def static_features(log: DataFrame, known: Known = Known()) -> DataFrame:
    return log.select("position", *(c.alias(n) for n, c in static_columns(known).items()))


def features(log: DataFrame, known: Known = Known(), *, ordered: bool = False) -> DataFrame:
    """position and all 38 numbers. ordered says that times never go back within an address."""
    recent = (ipstats.ordered if ordered else ipstats.exact)(log).drop("ip")
    return static_features(log, known).join(recent, "position")

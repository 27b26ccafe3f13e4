"""SQL twins of the queries over access_log, written from the semantics of the filter language and of the log."""

from __future__ import annotations

from hitlore.functions.text import BROWSER_PARTS, STATIC_ENDS, SUSPICIOUS_PARTS
from hitlore.operators.reqfeatures import COMMON, PROFILES, STATIC_NAMES
from hitlore.plans.log_queries import KNOWN, NOW
from hitlore.plans.requests_sql import VALID

_SHOWN = "position, status, method, uri"


def _t(y: int, mo: int, d: int, h: int = 0, mi: int = 0) -> str:
    return f"CAST(epoch(TIMESTAMP '{y:04d}-{mo:02d}-{d:02d} {h:02d}:{mi:02d}:00') AS BIGINT)"


def _header(name: str, test: str) -> str:
    return f"len(list_filter(headers, lambda h: h.key = '{name}' AND {test})) > 0"


_LOC = "coalesce(location = '{0}', false)"

#: Conditions by query name; each is true or false, never NULL.
CONDITIONS = {
    "f_status_eq": "status = 404",
    "f_status_range": "status >= 400 AND status < 500",
    "f_port_gt": "port > 60000",
    "f_port_ge": "port >= 50000",
    "f_port_lt": "port < 5000",
    "f_port_le": "port <= 4999",
    "f_method": "method = 'POST'",
    "f_uri_prefix": "starts_with(uri, '/api/')",
    "f_uri_suffix": "ends_with(uri, '.php')",
    "f_uri_contains": "contains(uri, 'login')",
    "f_uri_regex": r"regexp_matches(uri, '^/[a-z]+/[a-z]+/\d+/(été|größe|[a-m]+)$')",
    "f_uri_similar": "levenshtein(uri, '/assets/app.css') <= 4",
    "f_host": "host = 'www.mirabel.example'",
    "f_loc": _LOC.format("FR"),
    "f_not_loc": f"NOT {_LOC.format('FR')}",
    "f_ip_exact": f"coalesce(ip4 = {(192 << 24) + (2 << 8) + 17}, false)",
    "f_ip_wild": "coalesce(ip4 // 16777216 = 10 AND ip4 % 256 = 7, false)",
    "f_time_day": f"time >= {_t(2025, 9, 2)} AND time < {_t(2025, 9, 3)}",
    "f_time_same_day": f"time >= {_t(2025, 9, 3, 9)} AND time < {_t(2025, 9, 3, 17, 30)}",
    "f_time_between": f"time >= {_t(2025, 9, 2, 12)} AND time < {_t(2025, 9, 4)}",
    "f_time_after": f"time >= {_t(2025, 9, 6)}",
    "f_time_before": f"time < {_t(2025, 9, 2, 6, 30)}",
    "f_time_relative": f"time >= {NOW} - 172800 AND time < {NOW} - 43200",
    "f_proto": "proto IN (0, 1)",
    "f_fp": "lower(hex(tls_fp)) = '3deb4706a75ce695aef805edd917674a'",
    "f_header": _header("accept-language", "h.value = 'en'"),
    "f_header_part": _header("user-agent", "contains(h.value, 'Firefox')"),
    "f_and": "status = 200 AND method = 'GET' AND starts_with(uri, '/assets/')",
    "f_or": "status IN (500, 404) OR method = 'PUT'",
    "f_xor3": f"(CAST(status = 200 AS INTEGER) + CAST(method = 'GET' AS INTEGER) + CAST({_LOC.format('FR')} AS INTEGER)) % 2 = 1",
    "f_not": "NOT (status = 200 AND method = 'GET')",
    "f_nested": f"status IN (404, 403) AND NOT ({_LOC.format('IN')} <> (proto IN (0, 2))) AND contains(uri, '/')",
    "f_json_ast": "status >= 200 AND status < 300 AND NOT starts_with(uri, '/api/') AND " + _header("connection", "h.value = 'keep-alive'"),
    "f_none": "true",
    "t_live_filter": "status >= 400 AND status < 500 AND contains(uri, '/')",
}
_PAGE = "status >= 400 AND status < 600 AND contains(uri, '/')"
_HIGH = "CASE WHEN ip4 IS NULL THEN lower(hex(ip)) END"


def _lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _any(x: str, parts, test: str = "contains") -> str:
    return "(" + " OR ".join(f"{test}({x}, '{p}')" for p in parts) + ")" if parts else "false"


#: h: headers with ASCII-lower keys; names; the last value of a header.
_LOG = f"""
h0 AS (SELECT *, list_transform(headers, lambda x: {{'key': {_lower("x.key")}, 'value': x.value}}) AS h FROM access_log),
h1 AS (SELECT *, list_transform(h, lambda x: x.key) AS names, coalesce(list_filter(h, lambda x: x.key = 'user-agent')[-1].value, '') AS agent,
  list_filter(h, lambda x: x.key = 'accept-language')[-1].value AS al, list_filter(h, lambda x: x.key = 'host')[-1].value AS hh FROM h0)
"""


def _features() -> str:
    has = lambda n: f"list_contains(names, '{n}')"
    profiles = ["[" + ", ".join(f"'{h}'" for h in p) + "]" for p in PROFILES.values()]
    near = ", ".join(f"len(list_intersect(names, {p})) / greatest(len(list_distinct(list_concat(names, {p}))), 1)" for p in profiles)
    prints = lambda x: "lower(hex(tls_fp)) IN (" + ", ".join(f"'{p}'" for p in x) + ")"
    browser, claims = prints(KNOWN.browser_fingerprints), _any(_lower("agent"), BROWSER_PARTS)
    bytes_of = lambda x: f"octet_length(encode({x}))"
    values = [
        "len(headers)", "len(list_filter(names, lambda n: starts_with(n, 'sec-fetch-')))", has("sec-ch-ua"), "agent <> ''", bytes_of("agent"), claims,
        _any("agent", KNOWN.bot_parts), has("accept"), has("accept-language"), "coalesce(al = '*', false)", has("accept-encoding"), has("connection"),
        " + ".join(f"CAST(NOT {has(n)} AS INTEGER)" for n in COMMON), " OR ".join(f"names = {p}" for p in profiles), f"greatest({near})",
        prints(KNOWN.bot_fingerprints), browser, f"{claims} AND NOT {browser} AND proto = 2", "coalesce(hh <> host, false)", bytes_of("uri"),
        "CASE WHEN contains(uri, '?') THEN len(list_filter(string_split(substr(uri, strpos(uri, '?') + 1), '&'), lambda x: x <> '')) ELSE 0 END",
        "length(uri) - length(replace(uri, '/', ''))", _any(_lower("uri"), SUSPICIOUS_PARTS), "upper(method) = 'GET'", "upper(method) = 'POST'",
        "upper(method) NOT IN ('GET', 'POST')", "status >= 400", "coalesce(octet_length(body), 0) > 0", "ln(coalesce(octet_length(body), 0) + 1)",
        "port IN (80, 443)", "proto = 2", "sin(2 * pi() * ((time // 3600) % 24) / 24)", "cos(2 * pi() * ((time // 3600) % 24) / 24)",
    ]
    return ", ".join(f"round(CAST({v} AS DOUBLE), 9) + 0.0 AS {n}" for v, n in zip(values, STATIC_NAMES, strict=True))


#: The log made of events, as far as the recent past of addresses needs it.
_EVENTS = f"""
e AS (SELECT event_id AS position, 1704067200 + event_id // 4 AS time,
  CASE WHEN event_type = 'view' AND event_id % 3 = 0 THEN '/static/app' || (event_id % 7) || '.css?v=' || (event_id % 4)
    WHEN event_type = 'error' AND event_id % 5 = 0 THEN '/wp-login.php'
    ELSE '/api/' || event_type || '/' || (user_id % 10) || '?k=' || (event_id % 100) || '&&z' END AS uri,
  CASE WHEN user_id % 25 = 0 THEN 'v6-' || user_id ELSE 'v4-' || (user_id % 4) || '-' || (user_id % 256) END AS ip,
  CASE user_id % 5 WHEN 0 THEN 'v' WHEN 1 THEN 'Mozilla/5.0 Firefox/120.0' WHEN 2 THEN 'curl/8.0' WHEN 3 THEN 'ExampleBot/1.0 (bot)' ELSE '' END AS agent
  FROM events),
w AS (SELECT position, time, list({{'t': time, 'u': uri, 'a': agent, 's': {_any("split_part(uri, '?', 1)", STATIC_ENDS, "ends_with")}}})
  OVER (PARTITION BY ip ORDER BY position ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS l FROM e),
r AS (SELECT position, time, list_filter(l, lambda x: x.t >= time - 300) AS l FROM w)
"""

_ADDRESS = "array_to_string(list_transform(range(8), lambda i: regexp_replace(substr(lower(hex(ip)), 4 * i + 1, 4), '^0{1,3}', '')), ':')"


def _short(x: str) -> str:
    """IPv6 text with its first longest run of zero groups as '::'."""
    runs = [(n, "(^|:)0" + ":0" * (n - 1) + "($|:)") for n in range(8, 1, -1)]
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{r}') THEN regexp_replace({x}, '{r}', '::')" for _, r in runs) + f" ELSE {x} END"


def _dump() -> str:
    pairs = "list_transform(range(greatest(least(16, octet_length(body) - 16 * i), 0)), lambda j: substr(hex(body), CAST(32 * i + 2 * j + 1 AS BIGINT), 2))"
    shown = f"array_to_string(list_transform({pairs}, lambda x: CASE WHEN CAST('0x' || x AS INTEGER) BETWEEN 32 AND 126 THEN chr(CAST('0x' || x AS INTEGER)) ELSE '.' END), '')"
    row = f"printf('%08X', 16 * i) || '  ' || rpad(array_to_string({pairs}, ' '), 47, ' ') || '  ' || {shown}"
    return f"array_to_string(list_transform(range(greatest(CAST(ceil(octet_length(body) / 16) AS BIGINT), 1)), lambda i: {row}), chr(10))"


#: The recent past of addresses for times in any order, as a walk over the rows of each address: `f` is the first event that is remembered.
#: An event leaves when it is at the front and too old, or when more than 1000 are remembered.
_WALK = f"""
o AS (SELECT position, ip, coalesce(time, 0) AS t, uri AS u, coalesce(list_filter(headers, lambda x: {_lower("x.key")} = 'user-agent')[1].value, '') AS a,
  {_any(_lower("split_part(uri, '?', 1)"), STATIC_ENDS, "ends_with")} AS s, row_number() OVER (PARTITION BY ip ORDER BY position) AS i
  FROM access_log WHERE ip IS NOT NULL AND position IS NOT NULL),
walk AS (
  SELECT ip, i, i AS f FROM o WHERE i = 1
  UNION ALL
  SELECT n.ip, n.i, (SELECT min(p.i) FROM o p WHERE p.ip = n.ip AND p.i >= greatest(w.f, n.i - 999) AND p.i <= n.i AND p.t >= greatest(n.t - 300, 0)) AS f
  FROM walk w JOIN o n ON n.ip = w.ip AND n.i = w.i + 1),
past AS (
  SELECT n.position, CAST(count(*) FILTER (p.t >= greatest(n.t - 60, 0)) AS DOUBLE) AS ip_req_rate_1m, CAST(count(*) AS DOUBLE) AS ip_req_rate_5m,
    CAST(count(DISTINCT p.u) AS DOUBLE) AS ip_unique_uris_5m, CAST(count(DISTINCT p.a) AS DOUBLE) AS ip_unique_uas_5m,
    round(count(*) FILTER (p.s) / count(*), 9) AS ip_static_asset_ratio_5m
  FROM walk w JOIN o n ON n.ip = w.ip AND n.i = w.i JOIN o p ON p.ip = w.ip AND p.i BETWEEN w.f AND w.i GROUP BY n.position)
"""

SQL = {name: f"SELECT {_SHOWN} FROM access_log WHERE {c}" for name, c in CONDITIONS.items()} | {
    "s_stored": f"""WITH {VALID} SELECT v.entry_id, v.status, v.ip_hex,
        CASE WHEN starts_with(v.ip_hex, '00000000000000000000ffff') THEN CAST('0x' || substr(v.ip_hex, 25, 8) AS BIGINT) END AS ip4,
        CAST(CASE e.proto WHEN 'Unknown' THEN 0 WHEN 'Http' THEN 1 ELSE 2 END AS INTEGER) AS proto,
        array_to_string(list_reverse(regexp_extract_all(CASE WHEN regexp_full_match(coalesce(e.tls_fingerprint, '0'), '[0-9]+')
          THEN printf('%016x%016x', CAST(CAST(coalesce(e.tls_fingerprint, '0') AS UHUGEINT) // 18446744073709551616 AS UBIGINT),
            CAST(CAST(coalesce(e.tls_fingerprint, '0') AS UHUGEINT) % 18446744073709551616 AS UBIGINT)) END, '..')), '') AS tls_fp,
        CAST(len(list_filter(string_split(coalesce(e.headers, ''), chr(10)), lambda x: contains(x, ':'))) AS INTEGER) AS headers,
        array_to_string(list_filter(string_split(coalesce(e.headers, ''), chr(10)), lambda x: contains(x, ':')), chr(10)) AS joined, v.t AS time
        FROM valid v JOIN request_entries e ON e.entry_id = v.entry_id""",
    "s_blocks": 'SELECT block_start, count(*) AS n, min(position) AS "first", max(position) AS "last" FROM access_log GROUP BY block_start',
    "s_json_lines": f"""WITH {VALID} SELECT v.status, v.method, v.uri, v.ip_hex, v.port, v.t AS time, e.host,
        CAST(CASE e.proto WHEN 'Unknown' THEN 0 WHEN 'Http' THEN 1 ELSE 2 END AS INTEGER) AS proto, e.location, lower(hex(e.body)) AS body_hex
        FROM valid v JOIN request_entries e ON e.entry_id = v.entry_id WHERE v.entry_id % 97 <> 0""",
    "s_labels": """SELECT CAST(row_number() OVER (ORDER BY min(label_pos)) - 1 AS INTEGER) AS label_pos, position, arg_min(label, label_pos) AS label
        FROM position_labels WHERE label IS NOT NULL AND position IS NOT NULL GROUP BY position""",
    "k_seal": f"""WITH {VALID} SELECT p // 1000 * 1000 AS block_start, count(*) AS n, CASE WHEN count(*) = 1000 THEN 'sealed' ELSE 'flushed' END AS how
        FROM (SELECT row_number() OVER (ORDER BY entry_id) - 1 AS p FROM valid) GROUP BY 1""",
    "k_merge_blocks": """SELECT p - p % 1000 AS block_start, count(*) AS n, min(t) AS "from", max(t) AS "to", count(DISTINCT p) AS positions FROM (
        SELECT row_number() OVER (ORDER BY coalesce(time, 0), status < 300, position) - 1 AS p, coalesce(time, 0) AS t FROM access_log) GROUP BY 1""",
    "p_display": f"""SELECT position, status, method, uri, ua, referer, CASE WHEN ip4 IS NOT NULL
          THEN concat_ws('.', ip4 // 16777216, ip4 // 65536 % 256, ip4 // 256 % 256, ip4 % 256) ELSE {_short(_ADDRESS)} END AS ip, port,
        strftime(make_timestamp(time * 1000000), '%Y-%m-%d %H:%M:%S') AS time, hex(body) AS body,
        array_to_string(list_transform(headers, lambda h: h.key || ':' || h.value), chr(10)) AS headers, host, proto, location,
        lower(array_to_string(list_transform(range(16), lambda i: substr(hex(tls_fp), 31 - 2 * i, 2)), '')) AS tls_fp FROM access_log""",
    "p_hex_view": f"SELECT position, {_dump()} AS dump FROM access_log WHERE body IS NOT NULL",
    "p_headers_split": """SELECT entry_id, CAST(i - 1 AS INTEGER) AS at, substr(l[i], 1, strpos(l[i], ':') - 1) AS key, substr(l[i], strpos(l[i], ':') + 1) AS "value"
        FROM (SELECT entry_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT entry_id,
          list_filter(string_split(coalesce(headers, ''), chr(10)), lambda x: contains(x, ':')) AS l FROM request_entries))""",
    "p_flags": f"""WITH {_LOG} SELECT position, {_any(_lower("agent"), BROWSER_PARTS)} AS claims_browser, {_any(_lower("uri"), SUSPICIOUS_PARTS)} AS suspicious,
        {_any(_lower("split_part(uri, '?', 1)"), STATIC_ENDS, "ends_with")} AS "static", {_any("agent", KNOWN.bot_parts)} AS known_bot FROM h1""",
    "l_point": f"SELECT {_SHOWN} FROM access_log WHERE position = 1234",
    "l_page": f"SELECT {_SHOWN} FROM access_log WHERE position >= 100 AND position < 120",
    "l_reverse": f"SELECT {_SHOWN} FROM access_log WHERE position >= 100 AND position < 250 ORDER BY position DESC",
    "l_end": 'SELECT max(position) + 1 AS "end" FROM access_log',
    "l_filtered_page": f"SELECT {_SHOWN} FROM access_log WHERE {_PAGE} AND position >= 500 ORDER BY position LIMIT 20",
    "l_next": f"SELECT {_SHOWN} FROM access_log WHERE {_PAGE} AND position >= 500 ORDER BY position LIMIT 7 OFFSET 20",
    "l_prev": f"""SELECT {_SHOWN} FROM access_log WHERE {_PAGE} AND position >= coalesce((SELECT position FROM access_log WHERE {_PAGE} AND position < 500
        ORDER BY position DESC LIMIT 1 OFFSET 6), 0) ORDER BY position LIMIT 20""",
    "l_tail": f"SELECT {_SHOWN} FROM (SELECT * FROM access_log WHERE {_PAGE} ORDER BY position DESC LIMIT 20)",
    "l_moves": """SELECT * FROM (WITH e AS (SELECT greatest(max(position) + 1 - 20, 0) AS l FROM access_log) SELECT 'by_30' AS move, least(130, l) AS start, 130 >= l AS ended FROM e
        UNION ALL SELECT 'by_-500', CAST(0 AS BIGINT), 0 >= l FROM e UNION ALL SELECT 'by_huge', l, true FROM e UNION ALL SELECT 'to_7', least(7, l), 7 >= l FROM e UNION ALL SELECT 'to_end', l, true FROM e)""",
    "l_set_filter": f"SELECT {_SHOWN} FROM access_log WHERE method = 'POST' AND NOT (status = 200) AND position >= 500 ORDER BY position LIMIT 20",
    "r_commands": """SELECT CAST(no AS BIGINT) AS no, reply, n FROM (SELECT 0 AS no, 'Attached' AS reply, (SELECT count(*) FROM access_log WHERE position >=
          (SELECT greatest((max(position) + 1) // 1000 * 1000 - 300, 0) FROM access_log)) AS n
        UNION ALL SELECT 1, 'Rows', (SELECT count(*) FROM access_log WHERE position >= 1000 AND position < 1500)
        UNION ALL SELECT 2, 'Detached', 0 UNION ALL SELECT 3, 'Error', 0 UNION ALL SELECT 4, 'Error', 0 UNION ALL SELECT 5, 'Error', 0)""",
    "r_range": f"SELECT {_SHOWN} FROM access_log WHERE position >= 1000 AND position < 1500",
    "r_backlog": f"SELECT {_SHOWN} FROM access_log WHERE position >= (SELECT greatest((max(position) + 1) // 1000 * 1000 - 300, 0) FROM access_log)",
    "r_sync": """SELECT CAST((max(position) + 1) // 1000 * 1000 AS BIGINT) AS start, CAST(1000 AS BIGINT) AS block_size, CAST(0 AS BIGINT) AS first_block,
        CAST(greatest((max(position) + 1) // 1000 * 1000 - 300, 0) AS BIGINT) AS first_backlog FROM access_log""",
    "m_merge": """SELECT row_number() OVER (ORDER BY coalesce(time, 0), status < 300, position) - 1 AS position, coalesce(time, 0) AS time, status, uri FROM access_log""",
    "m_blocks": """SELECT p - p % 1000 AS block_start, count(*) AS n, min(t) AS "from", max(t) AS "to" FROM (
        SELECT row_number() OVER (ORDER BY coalesce(time, 0), status < 300, position) - 1 AS p, coalesce(time, 0) AS t FROM access_log) GROUP BY 1""",
    "w_ip_stats": f"""WITH {_EVENTS} SELECT position, CAST(len(list_filter(l, lambda x: x.t >= time - 60)) AS DOUBLE) AS ip_req_rate_1m,
        CAST(len(l) AS DOUBLE) AS ip_req_rate_5m, CAST(len(list_distinct(list_transform(l, lambda x: x.u))) AS DOUBLE) AS ip_unique_uris_5m,
        CAST(len(list_distinct(list_transform(l, lambda x: x.a))) AS DOUBLE) AS ip_unique_uas_5m,
        round(len(list_filter(l, lambda x: x.s)) / len(l), 9) AS ip_static_asset_ratio_5m FROM r""",
    "w_ip_stats_any_order": f"WITH RECURSIVE {_WALK} SELECT * FROM past",
    "t_ip_stats": f"WITH RECURSIVE {_WALK} SELECT * FROM past",
    "x_features_all": f"WITH RECURSIVE {_LOG}, {_WALK}, st AS (SELECT position, {_features()} FROM h1) SELECT * FROM st JOIN past USING (position)",
    "x_features_static": f"WITH {_LOG} SELECT position, {_features()} FROM h1",
    "a_label_join": """SELECT l.label_pos, l.position, l.label, a.status, a.uri FROM position_labels l JOIN access_log a ON a.position = l.position
        WHERE l.label IS NOT NULL""",
    "a_votes": f"""WITH {_LOG}, st AS (SELECT position, {_features()} FROM h1)
        SELECT position, round((CASE WHEN uri_length <= 20 THEN CASE WHEN status_is_error <= 0.5 THEN 0 ELSE 1 END ELSE 1 END
          + CASE WHEN header_count <= 3 THEN 1 ELSE CASE WHEN method_get <= 0.5 THEN 1 ELSE 0 END END
          + CASE WHEN has_ua <= 0.5 THEN 1 ELSE CASE WHEN ua_len <= 30 THEN 1 ELSE 0 END END) / 3, 9) AS score FROM st""",
    "a_verdict": """SELECT position, CASE WHEN s >= 0.75 THEN 'bot' WHEN s <= 0.25 THEN 'human' ELSE 'uncertain' END AS verdict,
        CASE WHEN s >= 0.7 THEN 'bot' WHEN s <= 0.3 THEN 'human' ELSE 'uncertain' END AS narrow,
        CASE WHEN s >= 0.75 THEN 'human' WHEN s <= 0.25 THEN 'bot' ELSE 'uncertain' END AS inverted
        FROM (SELECT position, CAST(position * 37 % 101 AS DOUBLE) / 100 AS s FROM access_log)""",
    "t_positions": f"""WITH {VALID} SELECT row_number() OVER (ORDER BY entry_id) - 1 AS position,
        (row_number() OVER (ORDER BY entry_id) - 1) // 10000 * 10000 AS block_start, status, uri, ip_hex FROM valid""",
    "t_resume": f"""WITH {VALID} SELECT row_number() OVER (ORDER BY entry_id) - 1 AS position,
        (row_number() OVER (ORDER BY entry_id) - 1) // 1000 * 1000 AS block_start, uri, ip_hex FROM valid""",
    "t_attach": f"""WITH {VALID}, p AS (SELECT row_number() OVER (ORDER BY entry_id) - 1 AS position, uri FROM valid)
        SELECT * FROM p WHERE position >= (SELECT greatest(count(*) // 1000 * 1000 - 300, 0) FROM p)""",
}

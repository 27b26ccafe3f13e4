"""SQL twins of the queries over request_entries, written from the definitions of TESTDATA.md."""

from __future__ import annotations

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = "\\.".join([_OCTET] * 4)


def _quad_number(x: str) -> str:
    return "(" + " + ".join(f"CAST(split_part({x}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4)) + ")"


#: valid: the valid rows with ip_hex, host_name and t (time, NULL as 0). request: one row per request.
VALID = f"""
v0 AS (
  SELECT *, split_part(ip, ':', -1) AS tail FROM request_entries
  WHERE status BETWEEN 0 AND 65535 AND port BETWEEN 0 AND 65535 AND method IS NOT NULL AND uri IS NOT NULL
    AND host IS NOT NULL AND ip IS NOT NULL AND proto IN ('Unknown', 'Http', 'Https')),
v1 AS (
  SELECT *, regexp_full_match(ip, '{_QUAD}') AS is4,
    CASE WHEN contains(ip, ':') AND regexp_full_match(tail, '{_QUAD}')
      THEN substr(ip, 1, length(ip) - length(tail)) || printf('%x:%x', {_quad_number("tail")} // 65536, {_quad_number("tail")} % 65536)
      ELSE ip END AS whole FROM v0),
v2 AS (
  SELECT *, len(string_split(whole, '::')) AS sides,
    CASE WHEN split_part(whole, '::', 1) = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(split_part(whole, '::', 1), ':') END AS l,
    CASE WHEN split_part(whole, '::', 2) = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(split_part(whole, '::', 2), ':') END AS r FROM v1),
v3 AS (
  SELECT *, CASE WHEN sides = 1 THEN l
    WHEN sides = 2 AND len(l) + len(r) <= 7 THEN list_concat(list_concat(l, list_transform(range(8 - len(l) - len(r)), lambda x: '0')), r) END AS g FROM v2),
v4 AS (
  SELECT *, CASE WHEN is4 THEN repeat('0', 20) || 'ffff' || printf('%08x', {_quad_number("ip")})
    WHEN contains(ip, ':') AND len(g) = 8 AND len(list_filter(g, lambda x: NOT regexp_full_match(x, '[0-9a-fA-F]{{1,4}}'))) = 0
    THEN lower(array_to_string(list_transform(g, lambda x: lpad(x, 4, '0')), '')) END AS ip_hex FROM v3),
valid AS (
  SELECT entry_id, status, method, uri, port, body, ip_hex, regexp_replace(regexp_replace(lower(host), ':[0-9]*$', ''), '\\.$', '') AS host_name,
    coalesce(time, 0) AS t FROM v4 WHERE ip_hex IS NOT NULL),
request AS (
  SELECT ip_hex, port, t, method, host_name, uri, min_by(status, entry_id) AS status,
    min_by(coalesce(octet_length(body), 0), entry_id) AS bytes
  FROM valid GROUP BY ALL),
typed AS (
  SELECT *, array_to_string(list_filter(string_split(lower(coalesce(TRY(url_decode(regexp_replace(split_part(split_part(uri, '#', 1), '?', 1), '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/]*', ''))),
      regexp_replace(split_part(split_part(uri, '#', 1), '?', 1), '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/]*', ''))), '/'), lambda x: x <> '')[1:2], '/') AS route,
    CAST(status // 100 AS INTEGER) AS status_class FROM request)
"""

_DAY = "strftime(make_timestamp(t * 1000000), '%Y-%m-%d')"

_DAILY = f"""{VALID},
daily AS (SELECT ip_hex, CAST(t // 86400 AS INTEGER) AS d, count(*) AS n FROM request WHERE t <> 0 GROUP BY ALL),
span AS (SELECT ip_hex, min(d) AS a, max(d) AS b FROM daily GROUP BY ALL),
calendar AS (SELECT ip_hex, unnest(range(a, b + 1)) AS d FROM span),
totals AS (
  SELECT c.ip_hex, c.d, CAST(coalesce(sum(x.n) FILTER (x.d > c.d - 7), 0) AS BIGINT) AS total_7, CAST(coalesce(sum(x.n), 0) AS BIGINT) AS total_30
  FROM calendar c LEFT JOIN daily x ON x.ip_hex = c.ip_hex AND x.d BETWEEN c.d - 29 AND c.d GROUP BY ALL)
"""

_VISITS = f"""{VALID},
marked AS (
  SELECT ip_hex, t, uri, coalesce(t - lag(t) OVER (PARTITION BY ip_hex ORDER BY t), 999999) > 1800 AS begins FROM request WHERE t <> 0),
numbered AS (
  SELECT *, sum(CAST(begins AS INTEGER)) OVER (PARTITION BY ip_hex ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM marked),
visit AS (
  SELECT ip_hex, min(t) AS start_time, max(t) AS end_time, max(t) - min(t) AS duration, count(*) AS n, count(DISTINCT uri) AS uris
  FROM numbered GROUP BY ip_hex, k)
"""

_TOP = f"""{VALID},
item AS (
  SELECT 'uri' AS field, uri AS item FROM valid UNION ALL SELECT 'ip', ip_hex FROM valid UNION ALL SELECT 'host', host_name FROM valid),
counted AS (SELECT field, item, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY field) AS BIGINT) AS "of" FROM item GROUP BY field, item)
"""

_KEYS = f"""{VALID},
keyed AS (
  SELECT 'ip' AS field, ip_hex AS item, * FROM valid UNION ALL SELECT 'host', host_name, * FROM valid),
runs AS (
  SELECT *, row_number() OVER (PARTITION BY field, item ORDER BY entry_id)
    - row_number() OVER (PARTITION BY field, item, status >= 400 ORDER BY entry_id) AS island FROM keyed),
lengths AS (
  SELECT field, item, max(CASE WHEN bad THEN n ELSE 0 END) AS error_run
  FROM (SELECT field, item, status >= 400 AS bad, island, count(*) AS n FROM runs GROUP BY ALL) GROUP BY ALL)
"""

SQL = {
    "p2_found": f"WITH {VALID} SELECT ip_hex, route, status_class FROM typed GROUP BY ALL HAVING count(*) >= 5",
    "p2_features": f"""WITH {VALID} SELECT ip_hex, route, status_class, count(*) AS n, max(CASE WHEN t <> 0 THEN t END) AS "last",
        CAST(sum(bytes) AS BIGINT) AS total FROM typed GROUP BY ip_hex, route, status_class""",
    "p3_found": f"""WITH {_TOP} SELECT field, item FROM counted WHERE field <> 'host' AND n >= 0.02 * "of" """,
    "p3_top": f"""WITH {_TOP} SELECT field, item, n, "of" FROM counted QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, item) <= 20""",
    "p4_found": f"WITH {_DAILY} SELECT ip_hex, strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y-%m-%d') AS day FROM totals WHERE total_7 = 0 AND total_30 >= 10",
    "p4_totals": f"""WITH {_DAILY} SELECT ip_hex, strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y-%m-%d') AS day, total_7, total_7 / 7 AS mean_7,
        total_30, total_30 / 30 AS mean_30 FROM totals""",
    "p5_found": f"WITH {_VISITS} SELECT ip_hex, start_time, end_time FROM visit WHERE n >= 3",
    "p5_sessions": f"WITH {_VISITS} SELECT ip_hex, start_time, end_time, duration, n, uris FROM visit",
    "p6_found": f"""WITH {VALID}, pair AS (SELECT {_DAY} AS day, host_name AS host, count(DISTINCT ip_hex) AS n FROM valid WHERE t <> 0 GROUP BY ALL),
        daily AS (SELECT {_DAY} AS day, count(DISTINCT ip_hex) AS n FROM valid WHERE t <> 0 GROUP BY ALL)
        SELECT p.day, p.host FROM pair p JOIN daily d ON d.day = p.day WHERE p.n * 100 >= d.n * 15""",
    "p6_bounds": f"""WITH {VALID}, cell AS (SELECT DISTINCT {_DAY} AS day, host_name AS host, ip_hex FROM valid WHERE t <> 0)
        SELECT CASE WHEN GROUPING(day) = 0 AND GROUPING(host) = 0 THEN 'day_host' WHEN GROUPING(day) = 0 THEN 'day' WHEN GROUPING(host) = 0 THEN 'host'
        ELSE 'all' END AS level, day, host, count(DISTINCT ip_hex) AS n, TRUE AS inside FROM cell GROUP BY CUBE (day, host)""",
    "p7_found": f"""WITH {_TOP} SELECT field, item FROM counted WHERE field <> 'uri' AND n >= 0.05 * "of" """,
    "p7_results": f"""WITH {_KEYS} SELECT k.field, k.item, count(*) AS n, CAST(sum(coalesce(octet_length(body), 0)) AS BIGINT) AS bytes,
        CAST(sum(CASE WHEN status >= 400 THEN 1 ELSE 0 END) AS BIGINT) AS errors, min(CASE WHEN t <> 0 THEN t END) AS first_time,
        max(CASE WHEN t <> 0 THEN t END) AS last_time, CAST(max(l.error_run) AS BIGINT) AS error_run
        FROM keyed k JOIN lengths l ON l.field = k.field AND l.item = k.item GROUP BY k.field, k.item""",
}

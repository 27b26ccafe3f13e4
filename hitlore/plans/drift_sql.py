"""SQL twins of the queries over block_rows. They know the names that fields go by in the test tables; the queries do not."""

from __future__ import annotations

#: Names by content in the test tables.
NAMES = {
    "ua": ("ua", "agent", "userAgent", "user_agent"),
    "referer": ("referer", "referrer", "ref", "http_referer"),
    "headers": ("headers", "rawHeaders", "hdrs", "header_lines"),
    "tls_fp": ("tls_fp", "ja_print", "tls_fingerprint", "tlsFp"),
    "location": ("location", "geo", "country"),
    "time": ("time", "ts"),
    "host": ("host", "vhost"),
}
_KEY = "CASE " + " ".join(f"WHEN name IN ({', '.join(repr(n) for n in names)}) THEN '{key}'" for key, names in NAMES.items()) + " ELSE name END"

#: rec: the well-formed records. In a valid record no key stands twice.
_RECORDS = """
rec AS (
  SELECT log_dir, block_start, row_no, record FROM block_rows
  WHERE json_valid(record) AND json_type(record) = 'OBJECT' AND len(json_keys(record)) = len(list_distinct(json_keys(record))))
"""

_FIELDS = f"""{_RECORDS},
kv AS (SELECT log_dir, block_start, record, unnest(json_keys(record)) AS name FROM rec),
typed AS (
  SELECT log_dir, block_start, name, CASE json_type(record, '$."' || name || '"') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean'
    WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind FROM kv),
counted AS (SELECT log_dir, block_start, name, kind, count(*) AS n FROM typed WHERE kind IS NOT NULL GROUP BY ALL),
field AS (
  SELECT log_dir, block_start, name, {_KEY} AS key, kind FROM counted
  QUALIFY row_number() OVER (PARTITION BY log_dir, block_start, name ORDER BY n DESC, kind) = 1),
file AS (SELECT log_dir, block_start, lag(block_start) OVER (PARTITION BY log_dir ORDER BY block_start) AS before FROM (SELECT DISTINCT log_dir, block_start FROM block_rows)),
known AS (
  SELECT f.log_dir, f.block_start, k.key, a.name AS name_a, b.name AS name_b, a.kind AS kind_a, b.kind AS kind_b
  FROM file f JOIN (SELECT DISTINCT log_dir, key FROM field) k ON k.log_dir = f.log_dir
  LEFT JOIN field a ON a.log_dir = f.log_dir AND a.block_start = f.before AND a.key = k.key
  LEFT JOIN field b ON b.log_dir = f.log_dir AND b.block_start = f.block_start AND b.key = k.key WHERE f.before IS NOT NULL)
"""




def _raw(key: str) -> str:
    """The value of a content as text, whatever it is called."""
    return "coalesce(" + ", ".join(f"""json_extract_string(record, '$."{n}"')""" for n in (*NAMES.get(key, (key,)), "no such name")) + ")"


def _whole(key: str, kind: str) -> str:
    return f"CASE WHEN regexp_full_match({_raw(key)}, '[0-9]+') THEN TRY_CAST({_raw(key)} AS {kind}) END"


def _listed(x: str) -> str:
    return f"CASE WHEN starts_with({x}, '[') THEN array_to_string(json_extract_string({x}, '$[*]'), ' ')"


_QUAD = "(" + " + ".join(f"CAST(split_part(ip_text, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4)) + ")"
_BYTES = "array_to_string(list_transform(json_extract_string({}, '$[*]'), lambda b: printf('%02x', CAST(b AS INTEGER))), '')"
_SWAPPED = "array_to_string([substr(wide, 31 - 2 * i, 2) FOR i IN range(16)], '')"
_PAIRS = "array_to_string(list_transform(range(CAST(json_array_length(h) AS BIGINT)), lambda i: (h -> i ->> 'key') || ':' || (h -> i ->> 'value')), chr(10))"
_OBJECT = """array_to_string(list_transform(json_keys(h), lambda k: k || ':' || json_extract_string(h, '$."' || k || '"')), chr(10))"""
_LINES = "array_to_string(list_filter(string_split(h, chr(10)), lambda x: contains(x, ':')), chr(10))"

#: IPv4 addresses only, which is what the test tables have here.
_TABLE = f"""{_RECORDS},
text AS (
  SELECT *, {_raw("ip")} AS ip_text, {_raw("tls_fp")} AS tls, {_raw("headers")} AS h, {_raw("ua")} AS agent, {_raw("referer")} AS link, {_raw("location")} AS place,
    {_raw("body")} AS content, {_raw("proto")} AS p FROM rec),
wide AS (
  SELECT *, lpad(lower(to_hex(CASE WHEN regexp_full_match(tls, '[0-9]+') THEN CAST(tls AS UHUGEINT) END)), 32, '0') AS wide FROM text)
"""

SQL = {
    "p1_table": f"""WITH {_TABLE}
        SELECT log_dir, block_start, row_no, block_start + row_no AS position, {_whole("status", "INTEGER")} AS status, {_raw("method")} AS method, {_raw("uri")} AS uri,
          {_listed("agent")} ELSE agent END AS ua, {_listed("link")} WHEN starts_with(link, '{{') THEN link ->> 'url' ELSE link END AS referer,
          repeat('0', 20) || 'ffff' || printf('%08x', {_QUAD}) AS ip_hex, {_QUAD} AS ip4, {_whole("port", "INTEGER")} AS port, {_whole("time", "BIGINT")} AS time,
          CASE WHEN regexp_full_match(content, '\\[[0-9,]*\\]') THEN {_BYTES.format("content")} ELSE lower(hex(encode(content))) END AS body_hex,
          coalesce(CASE WHEN starts_with(h, '[') THEN {_PAIRS} WHEN starts_with(h, '{{') THEN {_OBJECT} ELSE {_LINES} END, '') AS headers,
          coalesce({_raw("host")}, '') AS host, coalesce(CASE p WHEN 'Https' THEN 2 WHEN 'Http' THEN 1 WHEN 'Unknown' THEN 0 ELSE TRY_CAST(p AS INTEGER) END, 0) AS proto,
          CASE WHEN starts_with(place, '{{') THEN place ->> 'cc' ELSE place END AS location,
          coalesce(CASE WHEN regexp_full_match(tls, '[0-9a-fA-F]{{32}}') THEN lower(tls) WHEN wide IS NOT NULL THEN {_SWAPPED}
            WHEN starts_with(tls, '[') THEN {_BYTES.format("tls")} END, repeat('0', 32)) AS tls_fp_hex FROM wide""",
    "p1_found": f"""WITH {_FIELDS}
        SELECT log_dir, block_start, key AS field, 'added' AS change FROM known WHERE name_a IS NULL AND name_b IS NOT NULL
        UNION ALL SELECT log_dir, block_start, key, 'removed' FROM known WHERE name_a IS NOT NULL AND name_b IS NULL
        UNION ALL SELECT log_dir, block_start, key, 'renamed' FROM known WHERE name_a <> name_b
        UNION ALL SELECT log_dir, block_start, key, 'retyped' FROM known WHERE kind_a <> kind_b""",
}

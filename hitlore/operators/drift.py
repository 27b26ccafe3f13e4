"""Files whose fields are added, renamed, removed or change type: one consistent table, and a report of each change."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitlore.functions import jsontext, net, wide
from hitlore.operators.flooding import Field, flood, name_similarity, select
from hitlore.session import cut

_S, _N, _A, _O = "string", "number", "array", "object"

#: Signs, and signs with what may follow them (A a capital, a another letter, 9 a digit): the marks of a value are those that
#: stand in it, its first and last kind of character, and which of capitals, letters and digits it has. A value of at most SHORT
#: characters is a property itself, because such fields have few values.
SHORT = 2
SIGNS = " /:.-_;,()[]{}=?&\"\n+%@'"
FOLLOWED = tuple(sign + kind for sign in "/:.-_=; (" for kind in "9Aa/")
_CAPITALS, _LETTERS, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: What the parts of a signature are apart by; in a value it counts as a blank.
_APART = "\x01"
#: The character that stands for each of these marks in a signature.
_MARKS = {mark: chr(0x100 + i) for i, mark in enumerate((*SIGNS, *FOLLOWED))}

#: The fields of the stored row with a few values as they may come: what they have where no file bears their own names.
EXAMPLES: dict[str, list] = {
    "status": [200, 404, "301", "500"],
    "method": ["GET", "POST", "HEAD", "DELETE"],
    "uri": ["/", "/index.html", "/api/items/7?page=2", "/shop/list/4711"],
    "ua": [
        "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36", "curl/8.5.0",
        "ExampleBot/2.1 (+http://bot.example/about)", ["Mozilla/5.0", "(X11;", "Linux", "x86_64)", "Firefox/120.0"],
    ],
    "referer": ["https://www.example.org/", "https://shop.example.com/list?page=2", ["https://www.example.org/search?q=1"], {"url": "https://www.example.org/page?id=7"}],
    "ip": ["192.0.2.17", "10.1.200.3", "2001:db8::7"],
    "port": [443, 8080, 60001, "51234"],
    "time": [1700000000, 1712345678, "1725000000"],
    "body": ['{"n":5}', '{"n":12345}', "name=x&id=77", [123, 34, 110, 34, 58, 53, 125]],
    "headers": [
        "host:www.example.org\nuser-agent:curl/8.5.0\naccept:*/*", [{"key": "host", "value": "www.example.org"}, {"key": "accept", "value": "*/*"}],
        {"host": "www.example.org", "user-agent": "curl/8.5.0", "accept": "*/*"},
    ],
    "host": ["www.example.org", "api.example.com", "example.net"],
    "proto": [1, 2, "Https", "Http"],
    "location": ["DE", "FR", "US", {"cc": "DE"}],
    "tls_fp": [
        "3deb4706a75ce695aef805edd917674a", "0F67A4EBF0C9B1FE8A098E7333429D4A", 103249665291245201840084870758913850561,
        [56, 11, 1, 146, 92, 36, 209, 42, 157, 5, 218, 161, 193, 39, 180, 59],
    ],
}
#: Files whose graphs are flooded at once.
AT_ONCE = 64
#: Fields the stored row lacks have only each other to compare with, so for one to go on as another their names have to be this alike
#: as well.
CONTINUED = 0.6


def _step(length: int) -> int:
    """Lengths by steps of a third of a doubling."""
    return round(3 * math.log2(max(length, 1)))


def properties_of(text: str) -> list[str]:
    """The properties of one value's text, as the JVM makes them in `profiles`: m for marks, l for the length, v for short values."""
    text = text.replace(_APART, " ")
    shape = text.translate(str.maketrans(_CAPITALS + _LETTERS + _DIGITS, "A" * 26 + "a" * 26 + "9" * 10))
    kinds = "".join(k for k in "9Aa" if k in shape)
    own = [*(f"m{c}" for mark, c in _MARKS.items() if mark in shape), f"m={kinds}", f"m^{shape[:1]}", f"m${shape[-1:]}", f"l{_step(len(text))}"]
    return [*own, f"v{text}"] if 0 < len(text) <= SHORT else own


def _json_type(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    return {str: _S, int: _N, float: _N, list: _A, dict: _O}[type(value)]


def _field_of(name: str, kind: str, counts: Mapping[str, int]) -> Field:
    """A field from the counts of its properties; every value has one length."""
    of = max(sum(n for p, n in counts.items() if p[0] == "l"), 1)
    part = lambda letter: {p[1:]: n / of for p, n in counts.items() if p[0] == letter}
    return Field(name, {kind: 1.0}, part("m"), {int(p): x for p, x in part("l").items()}, dict.fromkeys(part("k"), 1.0), part("v"))


def _example_counts() -> dict[tuple[str, str], dict[str, int]]:
    out: dict[tuple[str, str], dict[str, int]] = {}
    for name, values in EXAMPLES.items():
        for v in values:
            own = out.setdefault((name, _json_type(v)), {})
            text = v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))
            inner = v if isinstance(v, dict) else v[0] if isinstance(v, list) and isinstance(v[0], dict) else {}
            for p in [*properties_of(text), *(f"k{k}" for k in inner)]:
                own[p] = own.get(p, 0) + 1
    return out


def _flags(form: Column, marks: Mapping[str, str]) -> Column:
    return F.concat(*(F.when(form.contains(m), F.lit(c)).otherwise("") for m, c in marks.items()))


def _marks_of(form: Column) -> Column:
    """The signature of a value: what follows a sign is only looked for where the sign stands."""
    out = []
    for sign in SIGNS:
        after = {m: _MARKS[m] for m in FOLLOWED if m[0] == sign}
        own = F.concat(F.lit(_MARKS[sign]), _flags(form, after)) if after else F.lit(_MARKS[sign])
        out.append(F.when(form.contains(sign), own).otherwise(""))
    return F.concat(*out)


def profiles(rows: DataFrame) -> DataFrame:
    """log_dir, block_start, name, type, property, n: for each file, field and JSON type the properties of the values and how many have
    them. A file without a present field has one row without name. Rows of a file lie together; they are written once.

    Each record is parsed once. Values become short signatures, which are counted on the map side.
    """
    known = rows.where(F.col("log_dir").isNotNull() & F.col("block_start").isNotNull())
    entry = F.explode_outer(F.map_entries(jsontext.single_object(F.col("record")))).alias("e")
    typed = known.select("log_dir", "block_start", entry).select(
        "log_dir", "block_start", F.col("e.key").alias("name"), F.col("e.value").alias("value"), F.schema_of_variant(F.col("e.value")).alias("shape")
    )
    kind = (
        F.when(F.col("shape") == "STRING", _S)
        .when(F.col("shape") == "BOOLEAN", "boolean")
        .when(F.col("shape").startswith("ARRAY"), _A)
        .when(F.col("shape").startswith("OBJECT"), _O)
        .when(F.col("shape") != "VOID", _N)
    )
    # A number that needs more than 38 digits is a double; its digits as they stand would be those of its exponent.
    long = (F.col("shape") == "DOUBLE") & (F.abs(F.try_variant_get("value", "$", "double")) >= 1e15)
    text = F.when(long, F.format_string("%.0f", F.try_variant_get("value", "$", "double"))).otherwise(F.try_variant_get("value", "$", "string"))
    inner = F.when(F.col("type") == _O, F.json_object_keys("text")).when(
        (F.col("type") == _A) & F.col("shape").contains("OBJECT"), F.json_object_keys(F.get_json_object("text", "$[0]"))
    )
    valued = typed.withColumns({"type": kind, "text": text}).withColumn("name", F.when(F.col("type").isNotNull(), F.col("name")))
    shaped = valued.withColumn("form", F.translate("text", _CAPITALS + _LETTERS + _DIGITS + _APART, "A" * 26 + "a" * 26 + "9" * 10 + " "))
    step = F.round(3 * F.log2(F.greatest(F.length("text"), F.lit(1)))).cast("int").cast("string")
    short = F.when(F.length("text") <= SHORT, F.translate("text", _APART, " ")).otherwise("")
    parts = (
        _marks_of(F.col("form")), _flags(F.col("form"), {k: k for k in "9Aa"}), F.substring("form", 1, 1), F.substring("form", -1, 1), step, short,
        F.coalesce(F.array_join(F.array_sort(inner), "\x00"), F.lit("")),
    )
    # One text to group by.
    signed = shaped.select("log_dir", "block_start", "name", "type", F.concat_ws(_APART, *parts).alias("signature"))
    counted = signed.groupBy(*signed.columns).agg(F.count(F.lit(1)).alias("n")).repartition("log_dir", "block_start")
    each = lambda letter, c: F.transform(F.filter(c, lambda x: x != ""), lambda x: F.concat(F.lit(letter), x))
    part = lambda i: F.col("parts")[i]
    listed = F.concat(
        each("m", F.split(part(0), "")),
        F.array(*(F.concat(F.lit(p), part(i)) for p, i in (("m=", 1), ("m^", 2), ("m$", 3), ("l", 4)))),
        each("k", F.split(part(6), "\x00")),
        each("v", F.array(part(5))),
    )
    counted = counted.withColumn("parts", F.split("signature", _APART))
    flat = counted.select("log_dir", "block_start", "name", "type", F.explode_outer(F.when(F.col("name").isNotNull(), listed)).alias("property"), "n")
    return cut(flat.groupBy("log_dir", "block_start", "name", "type", "property").agg(F.sum("n").alias("n")).sortWithinPartitions("log_dir", "block_start"))


def target_of(profile: DataFrame) -> list[Field]:
    """The graph of the stored row: each of its fields once for every JSON type it comes in.

    What its values have is read from the fields of all files that bear its name; EXAMPLES stand in where none does. The
    counts that are collected are as many as the stored row has fields, types and properties, whatever the number of rows.
    """
    counts = _example_counts()
    own = profile.where(F.col("name").isin(*EXAMPLES)).groupBy("name", "type", "property").agg(F.sum("n").alias("n"))
    found: dict[tuple[str, str], dict[str, int]] = {}
    for r in own.collect():
        found.setdefault((r.name, r.type), {})[r.property] = r.n
    return [_field_of(name, kind, own) for (name, kind), own in sorted((counts | found).items())]


_MATCHED = "log_dir string, block_start long, keys array<string>, names array<string>, types array<string>, others string"


def _present(counts: Mapping[tuple[str, str], Mapping[str, int]]) -> list[tuple[str, str, Mapping[str, int]]]:
    """(name, type, counts) of each field of a file: its type is that of most of its values, ties to the first in the alphabet."""
    size = lambda c: sum(n for p, n in c.items() if p[0] == "l")
    best: dict[str, tuple] = {}
    for (name, kind), own in sorted(counts.items(), key=lambda x: (x[0][0], -size(x[1]), x[0][1])):
        best.setdefault(name, (name, kind, own))
    return list(best.values())


def matched(profile: DataFrame, *, propagate: bool = True) -> DataFrame:
    """One row for each file: keys, names and types of its fields, and `others`, the properties of fields the stored row lacks, as JSON.

    A key is = and the name in the stored row, or ~ and the name in the file.
    """
    target = target_of(profile)
    names = [t.name for t in target]

    def given(files: list[tuple]) -> pa.RecordBatch:
        present = [_present(counts) for _, _, counts in files]
        score = flood([[_field_of(*f) for f in fields] for fields in present], target, propagate=propagate)
        columns: tuple[list, ...] = tuple([] for _ in range(6))
        for (log_dir, block, _), fields, own in zip(files, present, score, strict=True):
            chosen = select(own[: len(fields)], names)
            keys = [f"={chosen[i]}" if i in chosen else f"~{f[0]}" for i, f in enumerate(fields)]
            others = {f[0]: [f[1], f[2]] for i, f in enumerate(fields) if i not in chosen}
            for c, v in zip(columns, (log_dir, block, keys, [f[0] for f in fields], [f[1] for f in fields], json.dumps(others)), strict=True):
                c.append(v)
        kinds = (pa.string(), pa.int64(), *([pa.list_(pa.string())] * 3), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["log_dir", "block_start", "keys", "names", "types", "others"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: list[tuple] = []
        for batch in batches:
            for log_dir, block, name, kind, prop, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not files or files[-1][0] != log_dir or files[-1][1] != block:
                    if len(files) == AT_ONCE:
                        yield given(files)
                        files = []
                    files.append((log_dir, block, {}))
                if name is not None:
                    files[-1][2].setdefault((name, kind), {})[prop] = n
        if files:
            yield given(files)

    return profile.select("log_dir", "block_start", "name", "type", "property", "n").mapInArrow(match, _MATCHED)


def _continued(gone: Mapping[str, Sequence], come: Mapping[str, Sequence]) -> dict[str, str]:
    """Fields without a place in the stored row that go on under another name: later name to earlier name."""
    if not gone or not come:
        return {}
    before, after = ([_field_of(name, *own) for name, own in sorted(side.items())] for side in (gone, come))
    alike = np.array([[name_similarity(x.name, y.name) >= CONTINUED for y in before] for x in after])
    chosen = select(flood([after], before)[0] * alike, [f.name for f in before])
    return {after[i].name: name for i, name in chosen.items()}


def _changes(earlier: tuple, later: tuple) -> Iterator[tuple[str, str]]:
    """Each side: keys, names, types, others (JSON)."""
    a, b = ({key: (name, kind) for key, name, kind in zip(*side[:3], strict=True)} for side in (earlier, later))
    # A field that keeps its name goes on, where only one of the two files has its content placed.
    for key in [k for k, (name, _) in b.items() if k[0] == "=" and k not in a and f"~{name}" in a]:
        moved = b.pop(key)
        b[f"~{moved[0]}"] = moved
    for key in [k for k, (name, _) in a.items() if k[0] == "=" and k not in b and f"~{name}" in b]:
        b[key] = b.pop(f"~{a[key][0]}")
    others = [json.loads(side[3]) for side in (earlier, later)]
    gone = {k: v for k, v in others[0].items() if f"~{k}" in a and f"~{k}" not in b}
    come = {k: v for k, v in others[1].items() if f"~{k}" in b and f"~{k}" not in a}
    for new, old in _continued(gone, come).items():
        a[f"~{new}"] = a.pop(f"~{old}")
    for key in sorted(a.keys() | b.keys()):
        x, y = a.get(key), b.get(key)
        if x is None or y is None:
            yield key[1:], "added" if x is None else "removed"
            continue
        if x[0] != y[0]:
            yield key[1:], "renamed"
        if x[1] != y[1]:
            yield key[1:], "retyped"


def changes(rows: DataFrame, *, span: int = 10_000_000, propagate: bool = True) -> DataFrame:
    """log_dir, block_start, field, change: what changed in a file against the preceding file of its directory.

    rows has log_dir, block_start, row_no and record. A field is present if a well-formed record has it with a value other
    than null; its type is the JSON type of its values (of most of them, where they differ). `field` is the name in the
    stored row of the content, else the name in the file. `change` is added, removed, renamed or retyped.

    Method: similarity flooding between the schema graph of a file (names, types, nesting, what its values have) and that of
    the stored row; the correspondences found give each content its name in every file, and neighbouring files are compared
    by content. Fields the stored row lacks are flooded against each other. propagate=False leaves the flooding out, to see
    what it does.

    A file meets the one before it within `span` block starts of its directory; the last file of each span that has one goes
    to the next, so a directory of any size is no task's whole work.

    Defined cases: files without a well-formed record count as files without fields; the first file of a directory has no
    changes; repeated lines change nothing; broken, empty and null lines are left out; an empty table gives no rows; rows
    without log_dir or block_start are left out; further columns are ignored.
    """
    side = F.struct("keys", "names", "types", "others")
    # One row per file, read twice.
    files = cut(matched(profiles(rows), propagate=propagate).select("log_dir", "block_start", side.alias("own"))).withColumn("part", F.floor(F.col("block_start") / span))
    within = Window.partitionBy("log_dir", "part").orderBy("block_start")
    last = files.groupBy("log_dir", "part").agg(F.max_by("own", "block_start").alias("own"))
    carried = last.select("log_dir", "part", F.lag("own").over(Window.partitionBy("log_dir").orderBy("part")).alias("carried"))
    pairs = files.withColumn("before", F.lag("own").over(within)).join(carried, ["log_dir", "part"]).withColumn("before", F.coalesce("before", "carried"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = lambda x: tuple(x[n] for n in ("keys", "names", "types", "others"))
            out = [(d, b, *c) for d, b, x, y in zip(*(batch[n] for n in ("log_dir", "block_start", "before", "own")), strict=True) for c in _changes(read(x), read(y))]
            yield pd.DataFrame(out, columns=["log_dir", "block_start", "field", "change"])

    found = pairs.where(F.col("before").isNotNull()).select("log_dir", "block_start", "before", "own")
    return found.mapInPandas(compare, "log_dir string, block_start long, field string, change string")


def mappings(rows: DataFrame) -> DataFrame:
    """log_dir, block_start, source: for each file the map from names of the stored row to names in the file."""
    stored = F.filter(F.arrays_zip("keys", "names"), lambda x: x["keys"].startswith("="))
    pairs = F.transform(stored, lambda x: F.struct(F.substring(x["keys"], 2, 1_000).alias("key"), x["names"].alias("value")))
    return matched(profiles(rows)).select("log_dir", "block_start", F.map_from_entries(pairs).alias("source"))


def _number(text: Column, kind: str) -> Column:
    """NULL unless a whole number that the type holds."""
    return F.when(text.rlike(r"\A[0-9]+\z"), text).try_cast(kind)


def _headers(text: Column) -> Column:
    pair = "struct<key:string,value:string>"
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains(":"))
    from_lines = F.transform(
        lines, lambda x: F.struct(F.substring_index(x, ":", 1).alias("key"), F.substring(x, F.instr(x, ":") + 1, F.length(x)).alias("value"))
    )
    as_object = F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return F.when(text.startswith("["), F.from_json(text, f"array<{pair}>")).when(text.startswith("{"), as_object).otherwise(from_lines)


def _bytes(text: Column) -> Column:
    """A JSON array of bytes, else the text's own."""
    listed = F.transform(F.from_json(text, "array<int>"), lambda x: F.lpad(F.hex(x), 2, "0"))
    return F.when(text.rlike(r"\A\[([0-9]{1,3}(,[0-9]{1,3})*)?\]\z"), F.unhex(F.array_join(listed, ""))).otherwise(F.encode(text, "UTF-8"))


def _fingerprint(text: Column) -> Column:
    return (
        F.when(text.rlike(r"\A[0-9a-fA-F]{32}\z"), F.unhex(text))
        .when(text.rlike(r"\A[0-9]{1,39}\z"), wide.u128_le(text))
        .when(text.startswith("["), _bytes(text))
        .otherwise(F.unhex(F.lit("0" * 32)))
    )


def unify(rows: DataFrame) -> DataFrame:
    """All well-formed records as one table with the columns of the stored row, block_start, log_dir and row_no.

    Every file is read by its own correspondences. Casts: numbers from numbers or numeric strings; ua from a string or a
    list of its words; referer from a string, a list or an object with url; headers from `key:value` lines, a list of pairs
    or an object; location from a string or an object with cc; tls_fp from 32 hex digits (stored order), a number (little
    endian) or 16 bytes; body from text or a list of bytes; proto from a number or a name. A value that does not fit is
    NULL (a number too large for its column too), a missing proto 0, missing headers an empty list, a missing host '', a missing fingerprint zeros.
    position is block_start + row_no.
    """
    well_formed = rows.where(jsontext.is_single_object(F.col("record")))
    # One row per file: the smaller side by far.
    sources = mappings(rows).hint("shuffle_hash")
    read = well_formed.withColumn("values", F.from_json("record", "map<string,string>")).join(sources, ["log_dir", "block_start"])
    raw = lambda field: F.col("values")[F.col("source")[field]]
    listed = lambda x, sep: F.when(x.startswith("["), F.array_join(F.from_json(x, "array<string>"), sep))
    inner = lambda x, key: F.when(x.startswith("{"), F.get_json_object(x, f"$.{key}"))
    ip_hex = net.address_hex(raw("ip"))
    proto = F.when(raw("proto") == "Https", 2).when(raw("proto") == "Http", 1).when(raw("proto") == "Unknown", 0).otherwise(_number(raw("proto"), "int"))
    return read.select(
        "log_dir",
        "row_no",
        (F.col("block_start") + F.col("row_no")).alias("position"),
        _number(raw("status"), "int").alias("status"),
        raw("method").alias("method"),
        raw("uri").alias("uri"),
        F.coalesce(listed(raw("ua"), " "), raw("ua")).alias("ua"),
        F.coalesce(listed(raw("referer"), " "), inner(raw("referer"), "url"), raw("referer")).alias("referer"),
        F.unhex(ip_hex).alias("ip"),
        net.ip4_of_hex(ip_hex).alias("ip4"),
        _number(raw("port"), "int").alias("port"),
        _number(raw("time"), "long").alias("time"),
        _bytes(raw("body")).alias("body"),
        F.coalesce(_headers(raw("headers")), F.array().cast("array<struct<key:string,value:string>>")).alias("headers"),
        F.coalesce(raw("host"), F.lit("")).alias("host"),
        F.coalesce(proto, F.lit(0)).alias("proto"),
        F.coalesce(inner(raw("location"), "cc"), raw("location")).alias("location"),
        _fingerprint(raw("tls_fp")).alias("tls_fp"),
        "block_start",
    )

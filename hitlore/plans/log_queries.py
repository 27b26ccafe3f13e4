"""Queries over access_log: filters, projections, pages, replay, merge, features, verdicts and streams."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlore import api, sinks
from hitlore.filterlang import from_json, where
from hitlore.filterlang.ast import Field, Text
from hitlore.functions import text
from hitlore.operators import forest, ipstats, merge, reqfeatures, views
from hitlore.plans import fixtures
from hitlore.session import cut, place
from hitlore.sources import entries, requests
from hitlore.sources.requests import load
from hitlore.streaming import ingest

#: The moment relative times refer to in the queries: within the span of the data.
NOW = 1757000000

#: Filters by query name.
FILTERS = {
    "f_status_eq": "status 404",
    "f_status_range": "status 400 .. 500",
    "f_port_gt": "port > 60000",
    "f_port_ge": "port >= 50000",
    "f_port_lt": "port < 5000",
    "f_port_le": "port <= 4999",
    "f_method": "method POST",
    "f_uri_prefix": "uri /api/ *",
    "f_uri_suffix": "uri * .php",
    "f_uri_contains": "uri * login *",
    "f_uri_regex": r'uri r"^/[a-z]+/[a-z]+/\d+/(été|größe|[a-m]+)$"',
    "f_host": "host www.mirabel.example",
    "f_loc": "loc FR",
    "f_not_loc": "! loc FR",
    "f_ip_exact": "ip 192.0.2.17",
    "f_ip_wild": "ip 10.*.*.7",
    "f_time_day": "time 2025-09-02",
    "f_time_same_day": "time 2025-09-03 09:00 .. 17:30",
    "f_time_between": "time 2025-09-02 12:00:00 .. 2025-09-04",
    "f_time_after": "time 2025-09-06 ..",
    "f_time_before": "time .. 2025-09-02 06:30",
    "f_time_relative": "time -2d .. 12h",
    "f_proto": "proto http",
    "f_fp": "fp 3deb4706a75ce695aef805edd917674a",
    "f_header": "accept-language en",
    "f_header_part": "ua * Firefox *",
    "f_and": "status 200 & method GET & uri /assets/ *",
    "f_or": "status 500 | status 404 | method PUT",
    "f_xor3": "status 200 ^ method GET ^ loc FR",
    "f_not": "!(status 200 & method GET)",
    "f_nested": "(status 404 | status 403) & !(loc IN ^ proto https) & uri * / *",
}
SHOWN = ("position", "status", "method", "uri")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "access_log")


def filtered(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    return where(log(spark, sf_dir), f, now=NOW).select(*SHOWN)


def f_uri_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, Field("uri", Text("similar", "/assets/app.css", 4)))


def f_json_ast(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = {"And": [{"Status": {"Range": [200, 300]}}, {"Not": {"Uri": {"Prefix": "/api/"}}}, {"Header": {"header": "connection", "filter": {"Equals": "keep-alive"}}}]}
    return filtered(spark, sf_dir, from_json(form))


def f_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, None)


# Sources ----------------------------------------------------------------------------------------------------------------
def s_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_entries as stored rows, in plain columns."""
    rows = entries.stored_rows(requests.valid_rows(load(spark, sf_dir, "request_entries")))
    return rows.select(
        "entry_id", "status", F.lower(F.hex("ip")).alias("ip_hex"), "ip4", "proto", F.lower(F.hex("tls_fp")).alias("tls_fp"),
        F.size("headers").alias("headers"), text.join_headers(F.col("headers")).alias("joined"), "time",
    )


def s_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_entries written as JSON lines, every 97th of them broken, and read again."""
    bytes_ = F.transform(F.regexp_extract_all(F.hex("body"), F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))
    rows = load(spark, sf_dir, "request_entries").withColumn("body", bytes_)
    line = F.to_json(F.struct(*(c for c in rows.columns if c != "received")))
    path = place(spark, "json-lines")
    rows.select(F.when(F.col("entry_id") % 97 == 0, F.substring(line, 2, 1_000_000)).otherwise(line).alias("value")).write.text(path)
    read = entries.stored_rows(entries.json_lines(spark, path))
    return read.select("status", "method", "uri", F.lower(F.hex("ip")).alias("ip_hex"), "port", "time", "host", "proto", "location", F.lower(F.hex("body")).alias("body_hex"))


def s_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and span of positions of the blocks of a log that was written and read again."""
    path = place(spark, "blocks")
    sinks.write_blocks(log(spark, sf_dir), path)
    return sinks.read_blocks(spark, path).groupBy("block_start").agg(
        F.count(F.lit(1)).alias("n"), F.min("position").alias("first"), F.max("position").alias("last")
    )


def s_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first label of each position, written as a label file and read again."""
    labels = load(spark, sf_dir, "position_labels").where(F.col("label").isNotNull() & F.col("position").isNotNull())
    first = labels.groupBy("position").agg(F.min_by("label", "label_pos").alias("label"), F.min("label_pos").alias("label_pos"))
    # Labels are set by hand: a label file is one object.
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("label_pos", "position", "label"))), lambda x: F.concat(F.lit('"'), x["position"], F.lit('":'), x["label"]))
    path = place(spark, "labels")
    first.agg(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("value")).write.text(path)
    return entries.label_file(spark, path)


def _live(spark: SparkSession, sf_dir: str, parts: int = 1) -> str:
    """request_entries as a live log, arriving in `parts` pieces between which the stream is started again."""
    out, state, source = place(spark, "live"), place(spark, "live-state"), place(spark, "arriving")
    rows = load(spark, sf_dir, "request_entries")
    first, last = rows.agg(F.min("entry_id"), F.max("entry_id")).first()
    for i in range(parts):
        part = F.floor((F.col("entry_id") - first) * parts / (last - first + 1))
        rows.where(part == i).write.mode("append").parquet(source)
        ingest.ingest(ingest.stream(spark, source), out, state, block_rows=1000).awaitTermination()
    return out


def k_seal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a live log, and whether they were full and sealed or flushed."""
    out = _live(spark, sf_dir)
    stores = []
    for how, flush in (("sealed", False), ("flushed", True)):
        store = place(spark, how)
        ingest.seal(spark, out, store, block_rows=1000, flush=flush)
        stores.append(sinks.read_blocks(spark, store).groupBy("block_start").agg(F.count(F.lit(1)).alias("n")))
    return stores[1].join(stores[0].withColumnRenamed("n", "full"), "block_start", "left").select(
        "block_start", "n", F.when(F.col("full").isNotNull(), "sealed").otherwise("flushed").alias("how")
    )


def k_merge_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logs merged, stored in blocks of 1000 and opened again."""
    whole, path = log(spark, sf_dir), place(spark, "merged")
    api.Log.merged([api.Log(whole.where(F.col("status") >= 300)), api.Log(whole.where(F.col("status") < 300))], 1000).write(path)
    rows = api.Log.open(spark, path, 1000).rows
    return rows.groupBy("block_start").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("from"), F.max("time").alias("to"), F.countDistinct("position").alias("positions"))


# Projections --------------------------------------------------------------------------------------------------------------
def p_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip_hex = F.lower(F.hex("ip"))
    return log(spark, sf_dir).select(
        "position", "status", "method", "uri", "ua", "referer", text.format_ip(ip_hex, F.col("ip4")).alias("ip"), "port",
        text.format_time(F.col("time")).alias("time"), F.hex("body").alias("body"), text.join_headers(F.col("headers")).alias("headers"), "host",
        "proto", "location", text.fingerprint_hex(F.col("tls_fp")).alias("tls_fp"),
    )


def p_headers_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "request_entries").select("entry_id", F.posexplode(text.split_headers(F.col("headers"))).alias("at", "h"))
    return rows.select("entry_id", "at", F.col("h.key").alias("key"), F.col("h.value").alias("value"))


def p_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    agent = F.coalesce(text.header_value(F.col("headers"), "user-agent"), F.lit(""))
    return log(spark, sf_dir).select(
        "position", text.claims_browser(agent).alias("claims_browser"), text.is_suspicious(F.col("uri")).alias("suspicious"),
        text.is_static(F.col("uri")).alias("static"), text.contains_any(agent, KNOWN.bot_parts).alias("known_bot"),
    )


def p_hex_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).where(F.col("body").isNotNull()).select("position", text.hex_view("body").alias("dump"))


# Pages ----------------------------------------------------------------------------------------------------------------------
PAGE_FILTER = "status 400 .. 600 & uri * / *"


def _page(spark: SparkSession, sf_dir: str) -> views.FilteredPage:
    return views.FilteredPage(log(spark, sf_dir), PAGE_FILTER, rows=20, start=500, now=NOW)


def l_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.row_at(log(spark, sf_dir), 1234).select(*SHOWN)


def l_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.Page(log(spark, sf_dir), 20, 100).render().select(*SHOWN)


def l_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.between(log(spark, sf_dir), 100, 250, descending=True).select(*SHOWN)


def l_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(views.end(log(spark, sf_dir)),)], "end long")


def l_filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir).render().select(*SHOWN)


def l_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir).next(7).select(*SHOWN)


def l_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir).scroll_by(-7)[0].render().select(*SHOWN)


def l_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pages of 20 rows stand after moves, and whether the end was hit."""
    page = views.Page(log(spark, sf_dir), 20, 100)
    moves = {"by_30": page.scroll_by(30), "by_-500": page.scroll_by(-500), "by_huge": page.scroll_by(10**9), "to_7": page.scroll_to(7), "to_end": (page.scroll_to_end(), True)}
    return spark.createDataFrame([(k, p.start, ended) for k, (p, ended) in moves.items()], "move string, start long, ended boolean")


def l_set_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir).set_filter("method POST & !(status 200)").render().select(*SHOWN)


def l_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = _page(spark, sf_dir)
    return page.behind(20, views.end(page.log)).select(*SHOWN)


def r_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.between(log(spark, sf_dir), 1000, 1500).select(*SHOWN)


def r_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.with_backlog(log(spark, sf_dir), 1000, 300).select(*SHOWN)


def r_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sync(log(spark, sf_dir), 1000, 300)


def r_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of the replies to some commands, and how many rows they bring."""
    own = api.Log(log(spark, sf_dir), 1000)
    commands = [{"SubScribeWithBacklog": {"backlog": 300}}, {"FetchRange": {"start": 1000, "end": 1500}}, "Detach", {"FetchRange": {"start": 5}}, {"FetchRange": {"start": 9, "end": 3}}, "x"]
    replies = [own.answer(c) for c in commands]
    return spark.createDataFrame([(i, kind, rows.count() if isinstance(rows, DataFrame) else 0) for i, (kind, rows) in enumerate(replies)], "no long, reply string, n long")


# Merge -----------------------------------------------------------------------------------------------------------------------
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = log(spark, sf_dir)
    return merge.merge_logs([whole.where(F.col("status") >= 300), whole.where(F.col("status") < 300)], block_rows=1000)


def m_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("position", "time", "status", "uri")


def m_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).groupBy("block_start").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("from"), F.max("time").alias("to"))


# Features and verdicts -----------------------------------------------------------------------------------------------------------
KNOWN = reqfeatures.Known(("bot", "Bot", "curl/", "libfetch"), ("e249a4ed050000000000000000000000",), ("3deb4706a75ce695aef805edd917674a",))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("position", *(F.round(c, 9).alias(c) for c in df.columns if c != "position"))


def w_ip_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the log made of events, whose times follow the positions."""
    return _rounded(ipstats.ordered(fixtures.events_log(load(spark, sf_dir, "events"), dense=True)).drop("ip"))


def w_ip_stats_any_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ipstats.exact(log(spark, sf_dir)).drop("ip"))


def x_features_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reqfeatures.static_features(log(spark, sf_dir), KNOWN))


def x_features_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reqfeatures.features(log(spark, sf_dir), KNOWN))


def a_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).select("position", "status", "uri")
    return forest.labelled(rows, load(spark, sf_dir, "position_labels")).select("label_pos", "position", "label", "status", "uri")


def _model(spark: SparkSession, sf_dir: str):
    # Used for fitting and for scoring.
    all_features = cut(reqfeatures.features(log(spark, sf_dir), KNOWN))
    examples = forest.labelled(all_features, load(spark, sf_dir, "position_labels"))
    return all_features, forest.fit(examples)


def a_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_features, model = _model(spark, sf_dir)
    scored = forest.scored(all_features, model.trees)
    return scored.select("position", "score", forest.verdict(F.col("score")).alias("verdict"))


def a_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.importance(spark, _model(spark, sf_dir)[1])


def a_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of three given trees that vote for a bot, on features of the row."""
    grown = [
        ("uri_length", 20.0, ("status_is_error", 0.5, 0.0, 1.0), 1.0), ("header_count", 3.0, 1.0, ("method_get", 0.5, 1.0, 0.0)), ("has_ua", 0.5, 1.0, ("ua_len", 30.0, 1.0, 0.0)),
    ]
    trees = forest.Trees.grown(reqfeatures.STATIC_NAMES, grown)
    return forest.scored(reqfeatures.static_features(log(spark, sf_dir), KNOWN), trees).select("position", F.round("score", 9).alias("score"))


def a_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on a score that is a plain function of the position, by default bounds and by (0.3, 0.7)."""
    score = (F.col("position") * 37 % 101) / 100
    return log(spark, sf_dir).select(
        "position", forest.verdict(score).alias("verdict"), forest.verdict(score, human_max=0.3, bot_min=0.7).alias("narrow"),
        forest.verdict(score, inverted=True).alias("inverted"),
    )


# Streams --------------------------------------------------------------------------------------------------------------------------
def t_live_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, out = ingest.stream(spark, f"{sf_dir}/access_log.parquet"), place(spark, "filter")
    ingest.follow(rows, "status 400 .. 500 & uri * / *", out, place(spark, "filter-state"), now=NOW).awaitTermination()
    return spark.read.parquet(out).select(*SHOWN)


def t_ip_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.stream(spark, f"{sf_dir}/access_log.parquet")
    return _rounded(ingest.to_table(ingest.live_ip_stats(rows), "recent").drop("ip"))


def t_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = place(spark, "live")
    ingest.ingest(ingest.stream(spark, f"{sf_dir}/request_entries.parquet"), out, place(spark, "live-state")).awaitTermination()
    stored = ingest.live_rows(spark, out)
    return stored.select("position", "block_start", "status", "uri", F.lower(F.hex("ip")).alias("ip_hex"))


def t_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live log that was stopped twice and went on: positions are those of an unbroken run."""
    return ingest.live_rows(spark, _live(spark, sf_dir, 3)).select("position", "block_start", "uri", F.lower(F.hex("ip")).alias("ip_hex"))


def t_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a subscriber gets who attaches with a backlog of 300 rows."""
    return ingest.to_table(ingest.attach(spark, _live(spark, sf_dir), block_rows=1000, backlog=300).select("position", "uri"), "attached")


QUERIES = {name: partial(lambda spark, sf_dir, f: filtered(spark, sf_dir, f), f=f) for name, f in FILTERS.items()} | {
    f.__name__: f
    for f in (
        f_uri_similar, f_json_ast, f_none, s_stored, s_json_lines, s_blocks, s_labels, k_seal, k_merge_blocks, p_display, p_headers_split, p_flags, p_hex_view, l_point, l_page, l_reverse, l_end,
        l_filtered_page, l_next, l_prev, l_tail, l_moves, l_set_filter, r_range, r_backlog, r_sync, r_commands, m_merge, m_blocks, w_ip_stats, w_ip_stats_any_order,
        x_features_static, x_features_all, a_label_join, a_score, a_importance, a_votes, a_verdict, t_live_filter, t_ip_stats, t_positions,
        t_resume, t_attach,
    )
}

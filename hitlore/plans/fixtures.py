"""Logs made of other tables of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlore.functions import net, text
from hitlore.operators.reqfeatures import PROFILES


def events_log(events: DataFrame, *, dense: bool = False) -> DataFrame:
    """A stored log made from the driver's events table by fixed rules, with times in the order of positions.

    dense=True gives four rows a second, so that windows of minutes hold several rows of an address.
    """
    kind, user, n = F.col("event_type"), F.col("user_id"), F.col("event_id")
    status = F.when(kind == "error", F.when(n % 2 == 0, 404).otherwise(500)).when(kind == "signup", 201).when(kind == "purchase", 302).otherwise(200)
    posts = kind.isin("signup", "purchase")
    uri = (
        F.when((kind == "view") & (n % 3 == 0), F.concat(F.lit("/static/app"), n % 7, F.lit(".css?v="), n % 4))
        .when((kind == "error") & (n % 5 == 0), F.lit("/wp-login.php"))
        .otherwise(F.concat(F.lit("/api/"), kind, F.lit("/"), user % 10, F.lit("?k="), n % 100, F.lit("&&z")))
    )
    hexed = lambda x, w: F.lpad(F.lower(F.hex(x)), w, "0")
    ip_hex = F.when(user % 25 == 0, F.concat(F.lit("20010db800000000" + "0" * 10), hexed(user, 6))).otherwise(
        F.concat(F.lit("0" * 20 + "ffff0a00"), hexed(user % 4, 2), hexed(user % 256, 2))
    )
    chrome = "\n".join(f"{h}:v" for h in PROFILES["chrome_desktop"])
    raw = (
        F.when(user % 5 == 0, F.lit(chrome))
        .when(user % 5 == 1, F.lit("host:a.example.com\nuser-agent:Mozilla/5.0 Firefox/120.0\naccept:*/*"))
        .when(user % 5 == 2, F.lit("host:a.example.com\nuser-agent:curl/8.0\naccept:*/*"))
        .when(user % 5 == 3, F.lit("User-Agent:ExampleBot/1.0 (bot)\naccept-language:*"))
        .otherwise(F.lit("accept:a\nmalformed\naccept:b"))
    )
    fp = F.when(user % 9 == 0, F.lit("0" * 32)).otherwise(F.md5((user % 7).cast("string")))
    time = F.lit(1704067200) + F.floor(n / 4) if dense else F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return events.select(
        n.alias("position"),
        status.alias("status"),
        F.when(posts, "POST").when(n % 50 == 0, "HEAD").otherwise("GET").alias("method"),
        uri.alias("uri"),
        F.lit(None).cast("string").alias("ua"),
        F.lit(None).cast("string").alias("referer"),
        F.unhex(ip_hex).alias("ip"),
        net.ip4_of_hex(ip_hex).alias("ip4"),
        F.when(user % 11 == 0, F.lit(443)).otherwise(1024 + (n * 7919) % 60000).cast("int").alias("port"),
        time.cast("long").alias("time"),
        F.when(posts, F.encode("props", "UTF-8")).alias("body"),
        text.split_headers(raw).alias("headers"),
        F.element_at(F.array(*map(F.lit, ("a.example.com", "b.example.com", "shop.example.org"))), (user % 3 + 1).cast("int")).alias("host"),
        (n % 3).cast("int").alias("proto"),
        F.when(user % 4 == 1, "DE").when(user % 4 == 2, "FR").when(user % 4 == 3, "US").alias("location"),
        F.unhex(fp).alias("tls_fp"),
    )

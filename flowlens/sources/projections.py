"""Flow, alert, session and location tables made from the events table, for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions import classify

DOMAINS = ("www.youtube.com", "weixin.qq.com", "chat.openai.com", "cdn.example.org", "sys.miui.com", "courier.push.apple.com", "y.qq.com", "api.github.com", "evil-binance.com", "a.huawei.com", "wns.windows.com", "WWW.Bilibili.com")
MACS = ("aa:80:a0", "f0:18:98", "00:15:99", "e2:08:f4", "ea:0c:af", "12:34:56")
PORTS = (443, 443, 80, 8080, 53, 3306, 6379, 22)


def _pick(values, i: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))


def flows_from_events(events: DataFrame, classified: bool = True) -> DataFrame:
    """One flow for each event; see FIXTURES.md. classified: with the columns of the classifier."""
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("long")
    e = events.select("event_id", "user_id", "event_type", F.col("ts").alias("timestamp"), k.alias("k"), F.round(F.col("value") * 100).cast("long").alias("bu"))
    u, k = F.col("user_id"), F.col("k")
    kind = F.col("event_type")
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    s = lambda c: c.cast("string")
    two = lambda c: F.lpad(s(c), 2, "0")
    flows = e.select(
        "event_id",
        "timestamp",
        (micros * 1000).alias("first_seen"),
        (micros * 1000 + k * 400_000_000).alias("last_seen"),
        F.when(u % 10 == 9, text("203.0.113.", s(u % 250))).when(u % 10 == 8, text("10.0.", s(u % 7), ".", s(u % 250))).when(u % 10 == 7, text("172.20.0.", s(u % 250))).otherwise(text("192.168.", s(u % 3), ".", s(u % 250))).alias("src_ip"),
        text("198.51.100.", s(k)).alias("dst_ip"),
        (20_000 + F.col("event_id") % 40_000).cast("int").alias("src_port"),
        _pick(PORTS, k % 8).cast("int").alias("dst_port"),
        F.when(F.col("event_id") % 4 == 3, "UDP").otherwise("TCP").alias("protocol"),
        F.when(kind.isin("view", "click", "purchase"), _pick(DOMAINS, k % 12)).otherwise("").alias("sni"),
        F.when(kind.isin("error", "view"), _pick(DOMAINS, (k + 5) % 12)).otherwise("").alias("dns_domain"),
        (1 + k % 9).alias("packets_up"),
        (1 + k % 23).alias("packets_down"),
        F.col("bu").alias("bytes_up"),
        (F.col("bu") * (k % 7)).alias("bytes_down"),
        (k * 400).alias("duration_ms"),
        text(_pick(MACS, u % 6), ":00:", two((u / 100).cast("long") % 100), ":", two(u % 100)).alias("src_mac"),
        F.when(kind.isin("view", "click", "purchase"), F.sha2(s(u % 5), 256)).otherwise("").alias("ja3"),
        F.when(kind.isin("view", "click", "purchase"), text("771-", s(17 - u % 3), "-10-29")).otherwise("").alias("tls_signature_hash"),
        F.when(kind.isin("view", "click", "purchase"), (4865 + k % 3).cast("int")).otherwise(0).alias("server_cipher_suite"),
        F.when(kind.isin("view", "click", "purchase"), F.when(k % 2 == 0, "TLSv1.2").otherwise("TLSv1.1")).otherwise("").alias("tls_version"),
        F.lit("").alias("ja3s"),
        F.when(_pick(PORTS, k % 8).isin(80, 8080), _pick(DOMAINS, k % 12)).otherwise("").alias("http_host"),
    )
    if not classified:
        return flows
    app = classify.rules_engine(F.col("sni"), F.col("dns_domain"), F.col("dst_port"))
    flows = flows.withColumn("_app", app)
    return flows.select("*", *[F.col(f"_app.{c}").alias(c) for c in ("app_id", "app_name", "app_category", "confidence")], classify.manufacturer(F.col("sni"), F.col("dns_domain"), F.col("src_mac")).alias("device_manufacturer")).drop("_app")


def alerts_from_events(events: DataFrame) -> DataFrame:
    """An alert for each error event; its score is the number of its props."""
    rows = flows_from_events(events.where("event_type = 'error'"), classified=False)
    score = F.substring_index("dst_ip", ".", -1).cast("int")  # the destination ends with the same number
    return rows.select("event_id", "timestamp", "src_ip", "src_mac", score.alias("risk_score"), F.lit("error").alias("reason"), F.lit("").alias("details"), F.lit(0).alias("resolved"))


def sessions_from_events(events: DataFrame) -> DataFrame:
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("long")
    return events.where("event_type = 'click'").select("event_id", F.col("ts").alias("timestamp"), _pick(DOMAINS, k % 12).alias("host"), _pick(("GET", "POST", "PUT"), k % 3).alias("method"), F.concat(F.lit("/p/"), k.cast("string")).alias("path"), F.lit("text/html").alias("content_type"), k.alias("content_length"), F.lit("agent").alias("user_agent"), F.lit(0).alias("status_code"))


def geo(spark) -> DataFrame:
    """A location for each of the destination addresses but every tenth."""
    i = F.col("id")
    rows = spark.range(100).where(i % 10 != 0)
    return rows.select(F.concat(F.lit("198.51.100."), i.cast("string")).alias("ip"), F.concat(F.lit("Country "), (i % 5).cast("string")).alias("country"), F.concat(F.lit("City "), (i % 20).cast("string")).alias("city"), (i % 20 - 10).cast("double").alias("lat"), (i % 20 * 2).cast("double").alias("lon"))

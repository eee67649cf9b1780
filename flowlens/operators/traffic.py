"""Traffic queries over the flows table. Every function takes an explicit as_of and builds one lazy plan.

Sums over empty windows are 0, averages null. Top-k queries order by all grouping columns last, so ties are stable.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions import net
from flowlens.functions.net import is_private_narrow
from flowlens.timerange import window

CHAT = ("WeChat", "微信")


def volume() -> Column:
    return F.col("bytes_up") + F.col("bytes_down")


def total(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def named(column: str) -> Column:
    """A column for distinct counts that leave out ''."""
    return F.nullif(F.col(column), F.lit(""))


def stats(flows: DataFrame, as_of: datetime, since: str | None = None) -> DataFrame:
    """One row of totals. Elapsed time is that between the first and the last flow, a second at least."""
    secs = F.greatest(F.lit(1), F.unix_timestamp(F.max("timestamp").cast("timestamp")) - F.unix_timestamp(F.min("timestamp").cast("timestamp")))
    secs = F.coalesce(secs, F.lit(1))
    return window(flows, as_of, since, default="24h").agg(
        F.count("*").alias("total_flows"),
        total(volume()).alias("total_bytes"),
        F.count_distinct("app_id").alias("apps"),
        F.count_distinct(F.when(is_private_narrow(F.col("src_ip")), F.col("src_ip"))).alias("devices"),
        F.count_distinct(named("sni")).alias("snis"),
        F.count_distinct(named("dns_domain")).alias("domains"),
        F.count_if(F.col("protocol") == "TCP").alias("tcp_flows"),
        F.count_if(F.col("protocol") == "UDP").alias("udp_flows"),
        (total(volume()) / secs / 125_000).alias("throughput_mbps"),
        (F.count("*") / secs).alias("fps"),
    )


def search(flows: DataFrame, as_of: datetime, since: str | None = None, search_ip: str | None = None, search_domain: str | None = None, app_id: int | None = None) -> DataFrame:
    """Flows by parts of an address or a name (taken literally) and by application."""
    rows = window(flows, as_of, since)
    if search_ip:
        rows = rows.where(F.col("src_ip").contains(search_ip) | F.col("dst_ip").contains(search_ip))
    if search_domain:
        rows = rows.where(F.col("sni").contains(search_domain) | F.col("dns_domain").contains(search_domain))
    if app_id and app_id > 0:
        rows = rows.where(F.col("app_id") == app_id)
    return rows


def newest(rows: DataFrame, limit: int | None = None, key: str = "event_id") -> DataFrame:
    return rows.orderBy(F.desc("timestamp"), key).limit(min(100 if limit is None else limit, 1000))


def csv_export(rows: DataFrame, key: str = "event_id", limit: int = 10_000) -> DataFrame:
    """The export's columns, newest first; commas in names become semicolons, as nothing is quoted."""
    domain = F.when(F.col("sni") != "", F.col("sni")).otherwise(F.col("dns_domain"))
    return rows.orderBy(F.desc("timestamp"), key).limit(limit).select("timestamp", "src_ip", "dst_ip", F.col("app_name").alias("app"), F.replace(domain, F.lit(","), F.lit(";")).alias("domain"), volume().alias("bytes"), "protocol")


def apps(flows: DataFrame, as_of: datetime, since: str | None = None, top: int = 100) -> DataFrame:
    by = ["app_id", "app_name", "app_category"]
    rows = window(flows, as_of, since, default="24h").groupBy(by)
    return rows.agg(F.count("*").alias("flow_count"), F.sum(volume()).alias("total_bytes"), F.count_distinct("src_ip").alias("device_count")).orderBy(F.desc("total_bytes"), *by).limit(top)


def devices(flows: DataFrame, as_of: datetime, since: str | None = None, top: int = 100) -> DataFrame:
    rows = window(flows, as_of, since, default="24h").groupBy("src_ip")
    return rows.agg(
        F.count("*").alias("flow_count"), F.sum(volume()).alias("total_bytes"), F.count_distinct("app_id").alias("app_count"), F.max("timestamp").alias("last_seen"), F.max("src_mac").alias("mac"), F.count_distinct(named("sni")).alias("sni_count")
    ).orderBy(F.desc("total_bytes"), "src_ip").limit(top)


def top_names(flows: DataFrame, as_of: datetime, column: str, since: str | None = None, top: int = 100) -> DataFrame:
    """column: sni or dns_domain."""
    rows = window(flows, as_of, since, default="24h").where(F.col(column) != "").groupBy(column)
    return rows.agg(F.count("*").alias("hits"), F.count_distinct("src_ip").alias("devices")).orderBy(F.desc("hits"), column).limit(top)


def minute(column: str = "timestamp") -> Column:
    return F.date_trunc("minute", F.col(column)).cast("timestamp_ntz")


def trends(flows: DataFrame, as_of: datetime, since: str | None = None) -> DataFrame:
    """Flows and bytes of each minute that has any."""
    return window(flows, as_of, since, default="24h").groupBy(minute().alias("bucket")).agg(F.count("*").alias("flows"), F.sum(volume()).alias("bytes")).orderBy("bucket")


def summary_totals(flows: DataFrame, as_of: datetime, since: str | None = None) -> DataFrame:
    return window(flows, as_of, since, default="24h").agg(F.count("*").alias("flows"), total(volume()).alias("bytes"), F.count_distinct("src_ip").alias("devices"))


def summary_top_apps(flows: DataFrame, as_of: datetime, since: str | None = None, top: int = 5) -> DataFrame:
    rows = window(flows, as_of, since, default="24h").where(F.col("app_name") != "Unknown").groupBy("app_name")
    return rows.agg(F.sum(volume()).alias("b")).orderBy(F.desc("b"), "app_name").limit(top).select("app_name", F.round(F.col("b") / 1024 / 1024, 1).alias("mb"))


def summary_peak_hours(flows: DataFrame, as_of: datetime, since: str | None = None, top: int = 3) -> DataFrame:
    rows = window(flows, as_of, since, default="24h").groupBy(F.hour("timestamp").alias("h"))
    return rows.agg(F.count("*").alias("c")).orderBy(F.desc("c"), "h").limit(top)


def topology(flows: DataFrame, as_of: datetime, since: str = "1h", top: int = 200) -> DataFrame:
    """Edges from local devices to web servers, by application."""
    by = ["src_ip", "dst_ip", "app_name"]
    rows = window(flows, as_of, since).where(F.col("src_ip").startswith("192.168.") & F.col("dst_port").isin(80, 443, 8080))
    return rows.groupBy(by).agg(F.count("*").alias("w"), F.sum(volume()).alias("b")).orderBy(F.desc("b"), *by).limit(top)


def timeline_apps(flows: DataFrame, as_of: datetime, since: str = "1d") -> DataFrame:
    rows = window(flows, as_of, since).where((F.col("app_name") != "") & (F.col("app_name") != "Unknown"))
    return rows.groupBy(F.hour("timestamp").alias("h"), "app_name").agg(F.count("*").alias("c")).orderBy("h", F.desc("c"), "app_name")


def timeline_sites(flows: DataFrame, as_of: datetime, since: str = "1d", top: int = 500) -> DataFrame:
    rows = window(flows, as_of, since).where((F.col("sni") != "") | (F.col("dns_domain") != ""))
    return rows.groupBy(F.hour("timestamp").alias("h"), "sni", "dns_domain").agg(F.count("*").alias("c")).orderBy("h", F.desc("c"), "sni", "dns_domain").limit(top)


def top_per_group(rows: DataFrame, group: str, by: str, k: int, *ties: str) -> DataFrame:
    """The k rows of each group with the most of `by`."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(by), *ties))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def shares(rows: DataFrame, by: str, value: Column, name: str = "total") -> DataFrame:
    """Totals of a column's values and their percentages of the whole; the one-row total is broadcast."""
    each = rows.groupBy(by).agg(F.sum(value).alias(name))
    whole = each.agg(F.sum(name).alias("whole"))
    return each.crossJoin(F.broadcast(whole)).select(by, name, F.round(100 * F.col(name) / F.greatest(F.col("whole"), F.lit(1)), 2).alias("percent"))


def last_points(series: DataFrame, n: int = 24, by: str = "bucket") -> DataFrame:
    return series.orderBy(F.desc(by)).limit(n).orderBy(by)


def chat_flows(flows: DataFrame) -> DataFrame:
    return flows.where(F.col("app_name").isin(*CHAT))


def chat_summary(flows: DataFrame, as_of: datetime, since: str | None = None) -> DataFrame:
    """The chat application's totals and its whole percents of all traffic, in one pass over the flows."""
    is_chat = F.col("app_name").isin(*CHAT)
    mine = lambda c: F.when(is_chat, c)
    rows = window(flows, as_of, since, default="24h").agg(
        F.count_if(is_chat).alias("flows"), total(mine(volume())).alias("bytes"), F.bround(F.avg(mine(F.col("duration_ms")))).alias("avg_ms"), F.count_distinct(mine(F.col("src_ip"))).alias("devices"), F.count_distinct(mine(F.col("dst_ip"))).alias("servers"), F.count("*").alias("all_flows"), total(volume()).alias("all_bytes")
    )
    percent = lambda a, b: F.coalesce(F.floor(F.try_divide(100 * F.col(a), F.col(b))), F.lit(0)).cast("long")
    return rows.select("flows", "bytes", "avg_ms", "devices", "servers", percent("flows", "all_flows").alias("flow_percent"), percent("bytes", "all_bytes").alias("byte_percent"))


def chat_devices(flows: DataFrame, as_of: datetime, since: str | None = None, top: int = 10) -> DataFrame:
    rows = chat_flows(window(flows, as_of, since, default="24h")).where(F.col("src_ip").startswith("192.168.")).groupBy("src_ip")
    return rows.agg(F.max("device_manufacturer").alias("mfg"), F.count("*").alias("flows"), F.sum(volume()).alias("bytes"), F.bround(F.avg("duration_ms")).alias("avg_ms")).orderBy(F.desc("bytes"), "src_ip").limit(top)


def connection_type(duration_ms: Column) -> Column:
    return F.when(duration_ms < 100, "heartbeat").when(duration_ms < 1000, "short").when(duration_ms < 5000, "msg").when(duration_ms < 30_000, "file").otherwise("media")


def chat_types(flows: DataFrame, as_of: datetime, since: str | None = None) -> DataFrame:
    rows = chat_flows(window(flows, as_of, since, default="24h")).groupBy(connection_type(F.col("duration_ms")).alias("conn_type"))
    return rows.agg(F.count("*").alias("c"), F.bround(F.avg(volume())).alias("avg_bytes"), F.sum(volume()).alias("total_bytes")).orderBy(F.desc("c"), "conn_type")


def chat_hours(flows: DataFrame, as_of: datetime, since: str | None = None) -> DataFrame:
    rows = chat_flows(window(flows, as_of, since, default="24h")).groupBy(F.hour("timestamp").alias("h"))
    return rows.agg(F.count("*").alias("flows"), F.sum(volume()).alias("bytes"), F.count_distinct("src_ip").alias("devices")).orderBy("h")


def chat_domains(flows: DataFrame, as_of: datetime, since: str | None = None, top: int = 10) -> DataFrame:
    return top_names(chat_flows(flows), as_of, "dns_domain", since, top)


def newest_sessions(sessions: DataFrame, top: int = 100, key: str = "event_id") -> DataFrame:
    return sessions.orderBy(F.desc("timestamp"), key).limit(top)


def daily_rollup(flows: DataFrame) -> DataFrame:
    rows = flows.groupBy(F.to_date("timestamp").alias("date"), "app_id", "app_name", "app_category")
    return rows.agg(F.count("*").alias("flow_count"), F.sum(volume()).alias("total_bytes"), F.count_distinct("src_ip").alias("unique_devices"))


#: Of a sketch of 2^k registers the relative error has a standard deviation of about 1.04 / sqrt(2^k): 1.6 per cent.
SKETCH_BITS = 12


def rollup_part(flows: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """The daily rollup of one batch, in a form that adds up: sums, and a sketch of the devices."""
    rows = flows.groupBy(F.to_date("timestamp").alias("date"), "app_id", "app_name", "app_category")
    return rows.agg(F.count("*").alias("flow_count"), F.sum(volume()).alias("total_bytes"), F.hll_sketch_agg("src_ip", bits).alias("devices"))


def rollup_merged(parts: DataFrame) -> DataFrame:
    """The parts of several batches as one; it can be stored in their place."""
    rows = parts.groupBy("date", "app_id", "app_name", "app_category")
    return rows.agg(F.sum("flow_count").alias("flow_count"), F.sum("total_bytes").alias("total_bytes"), F.hll_union_agg("devices").alias("devices"))


def rollup_read(parts: DataFrame) -> DataFrame:
    """The daily rollup of parts: exact sums, devices by the merged sketches (a device that two batches met counts once)."""
    return rollup_merged(parts).withColumn("unique_devices", F.hll_sketch_estimate("devices")).drop("devices")


def health(flows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Row counts and the last flow's time: two one-row aggregates side by side."""
    return flows.agg(F.count("*").alias("flows"), F.max("timestamp").alias("last_flow")).crossJoin(F.broadcast(sessions.agg(F.count("*").alias("http_sessions"))))


def located(flows: DataFrame, geo: DataFrame, as_of: datetime, since: str = "1h") -> DataFrame:
    """Flows and bytes by place of the destination; flows are summed by address before the join."""
    rows = window(flows, as_of, since).groupBy("dst_ip").agg(F.count("*").alias("flows"), F.sum(volume()).alias("bytes"))
    rows = rows.where(~(F.col("dst_ip").startswith("192.168.") | F.col("dst_ip").startswith("10.") | F.col("dst_ip").startswith("172.")))
    return rows.join(geo.dropDuplicates(["ip"]), rows.dst_ip == geo.ip).groupBy("lat", "lon", "country", "city").agg(F.sum("flows").alias("flows"), F.sum("bytes").alias("bytes"))


def geo_lookup(ips: str, geo: DataFrame) -> DataFrame:
    """Places of a comma-separated list of addresses; unknown ones are left out."""
    wanted = [x.strip() for x in ips.split(",") if x.strip()]
    return geo.where(F.col("ip").isin(wanted)).select("ip", "country", "city", "lat", "lon") if wanted else geo.limit(0).select("ip", "country", "city", "lat", "lon")


def network_of(rows: DataFrame, networks: DataFrame, address: str = "ip") -> DataFrame:
    """rows and the columns of the network (networks: cidr and more) with the longest prefix that holds their address; of
    networks given twice one row, by the greatest of the others; null columns for addresses in none.

    Intervals become equality: an address is looked up by its prefix of each length that any network has (at most 162, one
    row that Spark broadcasts), so neither side is compared with all of the other. Addresses are looked up once each.
    """
    bits = net.network_bits(F.col("cidr"))
    other = [c for c in networks.columns if c != "cidr"]
    # IPv4 and IPv6 prefixes are told apart by a first character
    family = lambda ip: F.when(ip.contains(":"), "6").otherwise("4")
    known = networks.select(F.concat(family(F.col("cidr")), bits).alias("_prefix"), F.struct(*other, "cidr").alias("_network")).where("_prefix is not null")
    known = known.groupBy("_prefix").agg(F.max("_network").alias("_network"))
    lengths = known.agg(F.collect_set(F.length("_prefix")).alias("_lengths"))
    found = rows.select(F.col(address).alias("_ip")).where("_ip is not null").distinct().select("_ip", F.concat(family(F.col("_ip")), net.address_bits(F.col("_ip"))).alias("_bits")).where("_bits is not null")
    found = found.crossJoin(F.broadcast(lengths)).select("_ip", "_bits", F.explode("_lengths").alias("_length")).where(F.col("_length") <= F.length("_bits"))
    found = found.select("_ip", F.substring("_bits", F.lit(1), F.col("_length")).alias("_prefix")).join(known, "_prefix")
    found = found.groupBy("_ip").agg(F.max_by("_network", F.length("_prefix")).alias("_network"))
    return rows.join(found, rows[address] == found["_ip"], "left").select(*[rows[c] for c in rows.columns], "_network.*")


def latest_version(flows: DataFrame) -> DataFrame:
    """Of flows with one (timestamp, src_ip, first_seen) the one seen last."""
    ties = [F.desc(c) for c in ("event_id",) if c in flows.columns]
    rank = Window.partitionBy("timestamp", "src_ip", "first_seen").orderBy(F.desc("last_seen"), *ties)
    return flows.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank")


def retained(rows: DataFrame, as_of: datetime, days: int = 90) -> DataFrame:
    return window(rows, as_of, f"{days}d")

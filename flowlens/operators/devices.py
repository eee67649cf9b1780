"""Queries about devices: what is live, what is new, profiles, scores and alerts.

Set differences are anti-joins on one key column: the names of a flow are exploded once, so neither an OR in a join
condition nor a query for each device is needed.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions import classify
from flowlens.functions.net import is_private_wide
from flowlens.operators.traffic import minute, named, total, volume
from flowlens.timerange import ago, parse_since, window

#: MAC prefixes of proxies, whose traffic is not their own.
PROXIES = ("e2:08:f4", "5a:e2:02", "ea:0c:af")


def destinations(rows: DataFrame) -> DataFrame:
    """src_ip, dest: every non-empty TLS and DNS name, one scan."""
    return rows.select("src_ip", F.explode(F.array("sni", "dns_domain")).alias("dest")).where("dest <> ''")


def new_destinations(flows: DataFrame, as_of: datetime, recent: str = "5m", baseline: str = "1d", distinct: bool = True) -> DataFrame:
    """Names that a device met in the recent window but not in the baseline before it."""
    now, before = destinations(window(flows, as_of, recent)), destinations(window(flows, as_of, baseline, until=recent)).distinct()
    rows = now.join(before, ["src_ip", "dest"], "left_anti")
    return rows.distinct() if distinct else rows


def first_seen(flows: DataFrame, as_of: datetime, recent: str = "5m") -> DataFrame:
    """Names of the recent window that the device never met before it, in all history."""
    now, before = destinations(window(flows, as_of, recent)).distinct(), destinations(flows.where(F.col("timestamp") < ago(as_of, parse_since(recent)))).distinct()
    return now.join(before, ["src_ip", "dest"], "left_anti")


def baseline_size(flows: DataFrame, as_of: datetime, recent: str = "5m", baseline: str = "1d") -> DataFrame:
    """Distinct TLS names and distinct DNS names of each device, '' among them."""
    return window(flows, as_of, baseline, until=recent).groupBy("src_ip").agg((F.count_distinct("sni") + F.count_distinct("dns_domain")).alias("size"))


def live(flows: DataFrame, as_of: datetime, recent: str = "5m", baseline: str = "1d") -> DataFrame:
    """Private devices of the recent window with nested destinations, applications and new names."""
    groups = window(flows, as_of, recent).where(is_private_wide(F.col("src_ip"))).groupBy("src_ip", "sni", "dns_domain", "app_name").agg(F.sum(volume()).alias("bytes"), F.max("src_mac").alias("mac"))
    dest = F.when(F.col("sni") != "", F.col("sni")).otherwise(F.col("dns_domain"))
    per_dest = groups.withColumn("dest", dest).groupBy("src_ip", "dest").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("groups"), F.max("mac").alias("mac"), F.collect_set("app_name").alias("apps"), F.min("app_name").alias("app"))
    devices = per_dest.groupBy("src_ip").agg(
        F.max("mac").alias("mac"), F.sum("bytes").alias("bytes"), F.sum("groups").alias("flows"),
        F.array_sort(F.collect_list(F.when(F.col("dest") != "", F.struct("dest", "app", "bytes")))).alias("destinations"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("apps")))).alias("apps"),
    )
    new = new_destinations(flows, as_of, recent, baseline).groupBy("src_ip").agg(F.array_sort(F.collect_set("dest")).alias("new_dests"))
    return devices.join(new, "src_ip", "left").withColumn("new_dests", F.coalesce("new_dests", F.array().cast("array<string>")))


def of_device(flows: DataFrame, ip: str) -> DataFrame:
    return flows.where(F.col("src_ip") == ip)


def current(flows: DataFrame, ip: str, as_of: datetime, since: str = "5m", top: int = 20) -> DataFrame:
    by = ["sni", "dns_domain", "app_name"]
    return window(of_device(flows, ip), as_of, since).groupBy(by).agg(F.count("*").alias("flows"), F.sum(volume()).alias("bytes")).orderBy(F.desc("bytes"), *by).limit(top)


def trends(flows: DataFrame, ip: str, as_of: datetime, since: str | None = None) -> DataFrame:
    tcp, udp = F.col("protocol") == "TCP", F.col("protocol") == "UDP"
    rows = window(of_device(flows, ip), as_of, since, default="24h").groupBy(minute().alias("bucket"))
    return rows.agg(F.sum(volume()).alias("bytes"), F.count("*").alias("flows"), F.count_if(tcp).alias("tcp"), F.count_if(udp).alias("udp"), total(F.when(tcp, volume())).alias("tcp_bytes"), total(F.when(udp, volume())).alias("udp_bytes")).orderBy("bucket")


def fingerprints(flows: DataFrame, ip: str, as_of: datetime, since: str = "1d", top: int = 20) -> DataFrame:
    by = ["tls_signature_hash", "ja3", "ja3s", "tls_version"]
    rows = window(of_device(flows, ip), as_of, since).where("tls_signature_hash <> ''")
    return rows.groupBy(by).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), *by).limit(top)


def fingerprint_count(flows: DataFrame, ip: str, as_of: datetime, since: str = "1d") -> DataFrame:
    return window(of_device(flows, ip), as_of, since).agg(F.count_distinct(named("tls_signature_hash")).alias("distinct_sigs"))


def detail(flows: DataFrame, ip: str, as_of: datetime, since: str = "1d", top: int = 50) -> DataFrame:
    by = ["src_ip", "app_name", "app_category"]
    rows = window(of_device(flows, ip), as_of, since).groupBy(by)
    return rows.agg(F.count("*").alias("flow_count"), F.sum(volume()).alias("total_bytes"), F.max("sni").alias("sni"), F.max("dns_domain").alias("dns_domain")).orderBy(F.desc("total_bytes"), *by).limit(top)


def recent_devices(flows: DataFrame, as_of: datetime, recent: str = "5m") -> DataFrame:
    """One row for each private address: its MAC, applications, names, bytes and flows."""
    rows = window(flows, as_of, recent).where(is_private_wide(F.col("src_ip")))
    groups = rows.groupBy("src_ip", "app_name", "sni", "dns_domain", "src_mac").agg(F.sum(volume()).alias("bytes"), F.count("*").alias("flows"))
    return groups.groupBy("src_ip").agg(
        F.max("src_mac").alias("mac"), F.sum("bytes").alias("bytes"), F.sum("flows").alias("flows"),
        F.array_sort(F.collect_set(F.when(~F.col("app_name").isin("", "Unknown"), F.col("app_name")))).alias("apps"),
        F.array_sort(F.array_distinct(F.concat(F.collect_set(named("sni")), F.collect_set(named("dns_domain"))))).alias("domains"),
    )


def primary_addresses(devices: DataFrame) -> DataFrame:
    """Of the addresses with one MAC that with the most bytes; without a MAC every address. Proxies are left out."""
    own = devices.where("mac <> ''").groupBy("mac").agg(F.max(F.struct("bytes", "src_ip"))["src_ip"].alias("src_ip")).select("src_ip")
    kept = own.union(devices.where("mac = ''").select("src_ip"))
    return devices.join(kept, "src_ip", "left_semi").where(~F.substring("mac", 1, 8).isin(*PROXIES))


def insights(flows: DataFrame, as_of: datetime, recent: str = "5m", baseline: str = "1d") -> DataFrame:
    """Profiles and behaviour scores of the recent devices, the highest score first; one plan for all devices."""
    devices = primary_addresses(recent_devices(flows, as_of, recent))
    new = first_seen(flows, as_of, recent).groupBy("src_ip").agg(F.count("*").alias("new_count"))
    size = baseline_size(flows, as_of, recent, baseline)
    rows = devices.join(new, "src_ip", "left").join(size, "src_ip", "left").fillna(0, ["new_count", "size"])
    rows = rows.withColumn("profile", classify.device_profile(F.col("apps"), F.col("domains"), F.col("mac"))).withColumn("model", classify.device_model(F.col("domains"), F.col("mac"), F.lit("")))
    score = classify.behavior_score(F.col("new_count"), F.size("domains"), F.size("apps"), F.col("size"), F.col("flows"))
    rows = rows.withColumn("raw_score", score).withColumn("score", F.col("raw_score").cast("int")).withColumn("alert", F.col("raw_score") > 50)
    return rows.select("src_ip", "mac", "bytes", "flows", "apps", "domains", "new_count", "size", "profile.kind", "profile.os", "model", "raw_score", "score", "alert").orderBy(F.desc("raw_score"), "src_ip")


def insight_summary(rows: DataFrame) -> DataFrame:
    """Counts by operating system and of high scores. ios and macos count what is named exactly so; see corrected."""
    is_os = lambda *names: F.count_if(F.col("os").isin(*names))
    known = ("Android", "iOS", "macOS", "Windows")
    return rows.agg(
        F.count("*").alias("devices"), is_os("Android").alias("android"), is_os("iOS").alias("ios"), is_os("macOS").alias("macos"), is_os("Windows").alias("windows"),
        F.count_if(~F.col("os").isin(*known)).alias("other"), is_os("iOS", "macOS", "iOS/macOS").alias("apple_corrected"), F.count_if(F.col("score") > 50).alias("high_risk"),
    )


def traffic_alerts(flows: DataFrame, as_of: datetime, since: str = "1h", top: int = 20, dests: int = 10, most: int = 10_000_000) -> DataFrame:
    """Local devices with many names or much traffic."""
    rows = window(flows, as_of, since).where(F.col("src_ip").startswith("192.168.")).groupBy("src_ip")
    rows = rows.agg((F.count_distinct("sni") + F.count_distinct("dns_domain")).alias("dests"), F.count_distinct("app_name").alias("apps"), F.sum(volume()).alias("bytes"))
    return rows.where((F.col("dests") > dests) | (F.col("bytes") > most)).orderBy(F.desc("bytes"), "src_ip").limit(top)


def top_alerts(alerts: DataFrame, as_of: datetime, since: str | None = "1d", top: int = 50, key: str = "event_id") -> DataFrame:
    return window(alerts, as_of, since, default="24h").orderBy(F.desc("risk_score"), F.desc("timestamp"), key).limit(top)


def unresolved(alerts: DataFrame, resolved: DataFrame, as_of: datetime, since: str | None = None, top: int = 100, key: str = "event_id") -> DataFrame:
    """The top alerts without those of resolved addresses (resolved: src_ip); the limit comes first."""
    return top_alerts(alerts, as_of, since, top, key).join(resolved.select("src_ip").distinct(), "src_ip", "left_anti")


def alert_summary(alerts: DataFrame, as_of: datetime, since: str | None = None) -> DataFrame:
    return window(alerts, as_of, since, default="24h").agg(F.count("*").alias("total"), F.avg("risk_score").alias("avg_risk"), F.max("risk_score").alias("max_risk"), F.count_distinct("src_ip").alias("affected_devices"))


def mac_as_of(rows: DataFrame, sightings: DataFrame, life_s: int = 3600, chunk_s: int = 300) -> DataFrame:
    """rows (ip, at, in seconds, and more) with mac: the last that sightings (ip, at, mac) tell of the address at that time
    or up to life_s before it, else null; of sightings at one second the greatest mac.

    An as-of join without pairs: rows and sightings are one stream by address and chunk of chunk_s seconds. Within a chunk the
    last sighting is a running value; what was last before a chunk comes from the chunks' own last sightings, which are
    aggregated first. So a busy address is as many tasks as it has chunks.
    """
    chunk = F.floor(F.col("at") / chunk_s).alias("_chunk")
    # without an address or a mac there is nothing to sight
    seen = sightings.where("ip is not null and mac is not null and mac <> ''").groupBy("ip", "at").agg(F.max("mac").alias("mac"))
    last = seen.groupBy("ip", chunk).agg(F.max(F.struct("at", "mac")).alias("_last"))
    # every chunk of rows asks for the last of the chunks before it
    chunks = last.unionByName(rows.select("ip", chunk).distinct(), allowMissingColumns=True).groupBy("ip", "_chunk").agg(F.max("_last").alias("_last"))
    earlier = Window.partitionBy("ip").orderBy("_chunk").rangeBetween(-(life_s // chunk_s) - 1, -1)
    chunks = chunks.select("ip", "_chunk", F.max("_last").over(earlier).alias("_carried"))
    tagged = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), "ip", "at", F.lit(None).cast("string").alias("mac"), chunk)
    both = tagged.unionByName(seen.select("ip", "at", "mac", chunk), allowMissingColumns=True)
    # sightings of a second come before its rows
    running = Window.partitionBy("ip", "_chunk").orderBy("at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_own", F.last(F.when(F.col("_row").isNull(), F.struct("at", "mac")), ignorenulls=True).over(running)).where(F.col("_row").isNotNull())
    both = both.join(chunks.where("_carried is not null"), ["ip", "_chunk"], "left")
    found = F.coalesce("_own", "_carried")
    return both.select("_row.*", F.when(F.col("at") - found["at"] <= life_s, found["mac"]).alias("mac"))


def affected(alerts: DataFrame, high: int = 75) -> DataFrame:
    return alerts.agg(F.count_distinct("src_ip").alias("devices"), F.count_if(F.col("risk_score") >= high).alias("critical"))

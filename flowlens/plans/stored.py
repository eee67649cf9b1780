"""Registered queries of table jobs (written, merged, expired and rolled-up tables), of lookups in tables that are read, and of
orders within busy keys; and their SQL. Tables go to a folder of their own in the shared one for each call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import classify
from flowlens.operators import anomaly, devices, sessions, traffic
from flowlens.plans.oracle import BASE, BY_NAME, FLOWS, since
from flowlens.sources import payloads, projections, tables
from flowlens.sources.shared import shared_path
from flowlens.timerange import latest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, build: Callable[[SparkSession, str, DataFrame], DataFrame], sql: str) -> None:
    """build: (spark, sf_dir, events) to a frame."""
    QUERIES[name] = lambda spark, sf_dir: build(spark, sf_dir, spark.read.parquet(f"{sf_dir}/events.parquet"))
    ORACLE[name] = sql


# table jobs
def _written(spark, _, events):
    flows, path = projections.flows_from_events(events), shared_path(spark, "flows")
    tables.write_flows(flows, path)
    back = tables.read_flows(spark, path, latest(events, "ts"), "7d")
    return back.groupBy("yyyymm", "app_name").agg(F.count("*").alias("flows"), F.sum(traffic.volume()).alias("bytes")).withColumn("yyyymm", F.col("yyyymm").cast("long"))


_add("flows_written", _written, f"{FLOWS} SELECT CAST(strftime(timestamp, '%Y%m') AS BIGINT) AS yyyymm, app_name, count(*) AS flows, CAST(sum(bytes) AS BIGINT) AS bytes FROM flows WHERE {since(7)} GROUP BY ALL")


def _versions(events):
    """Flows of a minute and address as versions of one."""
    return projections.flows_from_events(events, classified=False).withColumn("timestamp", traffic.minute()).withColumn("first_seen", F.lit(0).cast("long"))


def _merged(spark, _, events):
    flows, path = _versions(events), shared_path(spark, "flows")
    # late rows first; a batch that comes again changes nothing
    for number in (2, 0, 1, 0):
        tables.merge_flows(flows.where(F.col("event_id") % 3 == number), path, f"batch-{number}")
    return spark.read.parquet(path).select("event_id", "timestamp", "src_ip", "last_seen")


_add(
    "flows_merged",
    _merged,
    f"""WITH {BASE} SELECT event_id, m AS timestamp, src_ip, last_seen FROM (
  SELECT *, date_trunc('minute', timestamp) AS m, row_number() OVER (PARTITION BY date_trunc('minute', timestamp), src_ip ORDER BY last_seen DESC, event_id DESC) AS r FROM base) WHERE r = 1""",
)


def _expired(spark, _, events):
    flows, path = projections.flows_from_events(events, classified=False), shared_path(spark, "flows")
    tables.write_flows(flows, path)
    tables.expire(spark, path, latest(events, "ts"), 10)
    return spark.read.parquet(path).select("event_id", "timestamp")


_NOW = f"WITH {BASE}, now AS (SELECT max(timestamp) AS t FROM base) "
_add("flows_expired", _expired, f"{_NOW} SELECT event_id, timestamp FROM base WHERE {since(10)}")


def _alerts(spark, _, events):
    path = shared_path(spark, "alerts")
    alerts = projections.alerts_from_events(events).withColumn("src_ip", F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("src_ip")))
    tables.append_alerts(alerts, path)
    return spark.read.parquet(path).select("event_id", "timestamp", "src_ip", F.col("risk_score").cast("long").alias("risk_score"))


_add("alerts_written", _alerts, f"{_NOW} SELECT event_id, timestamp, src_ip, k AS risk_score FROM base WHERE event_type = 'error' AND event_id % 7 <> 0")


def _sessions(spark, _, events):
    path = shared_path(spark, "sessions")
    tables.append_sessions(payloads.json_records(events), path)
    return spark.read.parquet(path).select("timestamp", "host", "path", "method", "src_ip", "content_length", F.col("status_code").cast("long").alias("status_code"))


_add(
    "sessions_written",
    _sessions,
    f"{_NOW} SELECT to_timestamp(first_seen // 1000000000) AT TIME ZONE 'UTC' AS timestamp, sni AS host, substr('/' || repeat('y', k * 2), 1, 128) AS path, ['GET', 'POST'][k % 2 + 1] AS method, 'mitmproxy' AS src_ip, k AS content_length, 0 AS status_code FROM base WHERE event_id % 5 = 2 AND k % 10 <> 0",
)


def _rollup(spark, _, events):
    flows = projections.flows_from_events(events)
    parts = None
    for number in range(4):
        part = traffic.rollup_part(flows.where(F.col("event_id") % 4 == number))
        parts = part if parts is None else parts.unionByName(part)
    exact = traffic.daily_rollup(flows).select("date", "app_id", "app_name", "app_category", F.col("unique_devices").alias("exact"))
    rows = traffic.rollup_read(parts).join(exact, ["date", "app_id", "app_name", "app_category"])
    # four standard deviations of the sketch's error
    close = F.abs(F.col("unique_devices") - F.col("exact")) <= 4 * 1.04 / 2 ** (traffic.SKETCH_BITS / 2) * F.col("exact") + 1
    return rows.select("date", "app_id", "app_name", "app_category", "flow_count", "total_bytes", close.alias("close"))


_add("daily_rollup_parts", _rollup, f"{FLOWS} SELECT CAST(timestamp AS DATE) AS date, app_id, app_name, app_category, count(*) AS flow_count, CAST(sum(bytes) AS BIGINT) AS total_bytes, true AS close FROM flows GROUP BY ALL")


# lookups in tables
def _networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network of eight addresses for each nation, and one of four within every third."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_name").alias("name"))
    cidr = lambda at, length: F.concat(F.lit("198.51.100."), at.cast("string"), F.lit(f"/{length}"))
    wide = nations.select(cidr(F.col("i") * 8, 29).alias("cidr"), "name", F.lit("all").alias("part"))
    east = nations.where("i % 3 = 0").select(cidr(F.col("i") * 8 + 4, 30).alias("cidr"), "name", F.lit("east").alias("part"))
    return wide.unionByName(east)


def _located(spark, sf_dir, events):
    flows = projections.flows_from_events(events, classified=False)
    rows = flows.groupBy("dst_ip").agg(F.count("*").alias("flows")).unionByName(spark.createDataFrame([("2001:db8::1", 1), ("not an address", 2)], "dst_ip string, flows long"))
    return traffic.network_of(rows, _networks(spark, sf_dir), "dst_ip").select("dst_ip", "flows", "name", "part", "cidr")


_add(
    "located_networks",
    _located,
    f"""WITH {BASE}, d AS (SELECT dst_ip, k, count(*) AS flows FROM base GROUP BY ALL)
SELECT dst_ip, flows, n_name AS name, CASE WHEN east THEN 'east' ELSE 'all' END AS part, '198.51.100.' || CASE WHEN east THEN k // 4 * 4 || '/30' ELSE k // 8 * 8 || '/29' END AS cidr
FROM (SELECT *, k // 8 % 3 = 0 AND k % 8 >= 4 AS east FROM d) LEFT JOIN nation ON n_nationkey = k // 8
UNION ALL SELECT * FROM (VALUES ('2001:db8::1', 1, NULL, NULL, NULL), ('not an address', 2, NULL, NULL, NULL))""",
)


def _registry(spark, sf_dir, events):
    digits = lambda n: F.lower(F.lpad(F.hex(n.cast("long")), 6, "0"))
    prefix = lambda n: F.regexp_replace(digits(n), "(..)(?!$)", "$1:")
    registry = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.upper(prefix(F.col("s_suppkey"))).alias("prefix"), F.col("s_name").alias("vendor"))
    flows = projections.flows_from_events(events, classified=False).withColumn("src_mac", F.concat(prefix(F.col("event_id") % 1500), F.lit(":00:00:01")))
    return classify.with_manufacturer(flows, registry).select("event_id", "device_manufacturer")


_add("device_manufacturer_registry", _registry, f"WITH {BASE} SELECT event_id, coalesce(s_name, {BY_NAME}) AS device_manufacturer FROM base LEFT JOIN supplier ON s_suppkey = event_id % 1500")


# orders within busy keys
def _macs(spark, _, events):
    flows = projections.flows_from_events(events, classified=False).withColumn("at", F.unix_seconds(F.col("timestamp").cast("timestamp"))).join(events.select("event_id", "event_type"), "event_id")
    seen = flows.where("event_type = 'click'").select(F.col("src_ip").alias("ip"), "at", F.col("src_mac").alias("mac"))
    return devices.mac_as_of(flows.select("event_id", F.col("src_ip").alias("ip"), "at"), seen, 86_400, 7200).select("event_id", "mac")


_add(
    "mac_as_of",
    _macs,
    f"""WITH {BASE}, s AS (SELECT src_ip AS ip, CAST(floor(epoch(timestamp)) AS BIGINT) AS at, max(src_mac) AS mac FROM base WHERE event_type = 'click' GROUP BY ALL),
r AS (SELECT event_id, src_ip AS ip, CAST(floor(epoch(timestamp)) AS BIGINT) AS at FROM base)
SELECT event_id, arg_max(s.mac, s.at) AS mac FROM r LEFT JOIN s ON s.ip = r.ip AND s.at <= r.at AND r.at - s.at <= 86400 GROUP BY event_id""",
)
_add(
    "anomaly_memory",
    lambda spark, _, events: anomaly.scored(projections.flows_from_events(events, classified=False), memory=5).where("domain <> ''").select("event_id", "is_new", "known"),
    f"""WITH RECURSIVE {BASE}, o AS (
  SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY timestamp, event_id) AS n FROM (SELECT event_id, timestamp, src_ip, CASE WHEN sni <> '' THEN sni ELSE dns_domain END AS domain FROM base) WHERE domain <> ''),
r AS (SELECT event_id, src_ip, n, true AS is_new, 0 AS known, [domain] AS names FROM o WHERE n = 1 UNION ALL
  SELECT o.event_id, o.src_ip, o.n, NOT list_contains(r.names, o.domain), len(r.names), CASE WHEN list_contains(r.names, o.domain) THEN r.names WHEN len(r.names) = 5 THEN list_append(r.names[2:5], o.domain) ELSE list_append(r.names, o.domain) END
  FROM r JOIN o ON o.src_ip = r.src_ip AND o.n = r.n + 1)
SELECT event_id, is_new, CAST(known AS BIGINT) AS known FROM r""",
)
_BUSY = "o.sec - r.sec > 7200 OR o.sec - r.begun > 10800"
_add(
    "sessions_busy_keys",
    lambda spark, _, events: sessions.capped_sessions(events.select((F.col("user_id") % 20).alias("part"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")), ["part"], "at", 7200, 10_800, 18_000),
    f"""WITH RECURSIVE o AS (SELECT user_id % 20 AS part, CAST(floor(epoch(ts)) AS BIGINT) AS sec, row_number() OVER (PARTITION BY user_id % 20 ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
r AS (SELECT part, n, sec, sec AS begun, 1 AS nth FROM o WHERE n = 1 UNION ALL
  SELECT o.part, o.n, o.sec, CASE WHEN {_BUSY} THEN o.sec ELSE r.begun END, r.nth + CASE WHEN {_BUSY} THEN 1 ELSE 0 END FROM r JOIN o ON o.part = r.part AND o.n = r.n + 1)
SELECT part, min(begun) AS first_at, max(sec) AS last_at, count(*) AS rows FROM r GROUP BY part, nth""",
)

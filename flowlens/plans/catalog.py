"""Registered queries: each a callable of (spark, sf_dir), and the SQL that must give the same rows.

The recent window is a day and the baseline seven, as the test events span thirty days.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import classify, net
from flowlens.operators import anomaly, devices, sessions, traffic
from flowlens.plans import messages, stored
from flowlens.plans.oracle import BASE, FLOWS, before, since
from flowlens.sources import projections
from flowlens.timerange import newest, window

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DAY, WEEK = "1d", "7d"
#: A device with many flows in every test size.
DEVICE = "192.168.1.1"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _add(name: str, build: Callable, sql: str | None = None) -> None:
    """build: (flows, as_of) to a frame; sql: a SELECT over FLOWS' tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        flows = projections.flows_from_events(_events(spark, sf_dir))
        return build(flows, newest(_events(spark, sf_dir), "ts"))

    QUERIES[name] = run
    if sql:
        ORACLE[name] = FLOWS + sql


def _add_events(name: str, build: Callable, sql: str | None = None) -> None:
    """build: (events, as_of) to a frame; sql: a whole statement."""
    QUERIES[name] = lambda spark, sf_dir: build(_events(spark, sf_dir), newest(_events(spark, sf_dir), "ts"))
    if sql:
        ORACLE[name] = sql


_SECS = "greatest(1, date_diff('second', min(timestamp), max(timestamp)))"
_B = "CAST(sum(bytes) AS BIGINT)"
_CHAT = "app_name IN ('WeChat', '微信')"

_add("stats", lambda f, t: traffic.stats(f, t).select("*").withColumns({c: F.round(c, 6) for c in ("throughput_mbps", "fps")}), f"""
SELECT count(*) AS total_flows, {_B} AS total_bytes, count(DISTINCT app_id) AS apps,
  count(DISTINCT CASE WHEN src_ip LIKE '192.168.%' OR src_ip LIKE '10.%' THEN src_ip END) AS devices,
  count(DISTINCT nullif(sni, '')) AS snis, count(DISTINCT nullif(dns_domain, '')) AS domains,
  count(*) FILTER (protocol = 'TCP') AS tcp_flows, count(*) FILTER (protocol = 'UDP') AS udp_flows,
  round(sum(bytes) / {_SECS} / 125000, 6) AS throughput_mbps, round(count(*) / {_SECS}, 6) AS fps
FROM flows WHERE {since()}""")  # fmt: skip
_COLS = "timestamp, src_ip, dst_ip, src_port, dst_port, protocol, sni, tls_version, server_cipher_suite, tls_signature_hash, dns_domain, app_name, app_category, bytes_up, bytes_down, packets_up, packets_down, duration_ms, src_mac"
_INTS = ("src_port", "dst_port", "server_cipher_suite")
_ICOLS = ", ".join(f"CAST({c} AS BIGINT) AS {c}" if c in _INTS else c for c in _COLS.split(", "))
_add("flows_search", lambda f, t: traffic.newest(traffic.search(f, t, WEEK, search_ip="192.168.", search_domain="qq.com"), 500).withColumns({c: F.col(c).cast("bigint") for c in _INTS}).select(*_COLS.split(", ")), f"""
SELECT {_ICOLS} FROM (SELECT * FROM flows WHERE {since(7)} AND (contains(src_ip, '192.168.') OR contains(dst_ip, '192.168.'))
  AND (contains(sni, 'qq.com') OR contains(dns_domain, 'qq.com')) ORDER BY timestamp DESC, event_id LIMIT 500)""")  # fmt: skip
_add("flows_by_app", lambda f, t: traffic.newest(traffic.search(f, t, "30d", app_id=1), 1000).select("event_id", "timestamp", "src_ip", "app_name"), f"""
SELECT event_id, timestamp, src_ip, app_name FROM flows WHERE {since(30)} AND app_id = 1 ORDER BY timestamp DESC, event_id LIMIT 1000""")  # fmt: skip
_add("csv_export", lambda f, t: traffic.csv_export(window(f, t, WEEK)), f"""
SELECT timestamp, src_ip, dst_ip, app_name AS app, replace(CASE WHEN sni <> '' THEN sni ELSE dns_domain END, ',', ';') AS domain, bytes, protocol
FROM (SELECT * FROM flows WHERE {since(7)} ORDER BY timestamp DESC, event_id LIMIT 10000)""")  # fmt: skip
_add("apps", traffic.apps, f"""
SELECT app_id, app_name, app_category, count(*) AS flow_count, {_B} AS total_bytes, count(DISTINCT src_ip) AS device_count
FROM flows WHERE {since()} GROUP BY ALL ORDER BY total_bytes DESC, app_id, app_name, app_category LIMIT 100""")  # fmt: skip
_add("devices", traffic.devices, f"""
SELECT src_ip, count(*) AS flow_count, {_B} AS total_bytes, count(DISTINCT app_id) AS app_count, max(timestamp) AS last_seen, max(src_mac) AS mac,
  count(DISTINCT nullif(sni, '')) AS sni_count FROM flows WHERE {since()} GROUP BY src_ip ORDER BY total_bytes DESC, src_ip LIMIT 100""")  # fmt: skip
for _name, _col in (("dns_top", "dns_domain"), ("sni_top", "sni")):
    _add(_name, lambda f, t, c=_col: traffic.top_names(f, t, c), f"SELECT {_col}, count(*) AS hits, count(DISTINCT src_ip) AS devices FROM flows WHERE {since()} AND {_col} <> '' GROUP BY {_col} ORDER BY hits DESC, {_col} LIMIT 100")
_add("trends_minute", lambda f, t: traffic.trends(f, t, WEEK), f"SELECT date_trunc('minute', timestamp) AS bucket, count(*) AS flows, {_B} AS bytes FROM flows WHERE {since(7)} GROUP BY bucket")
_add("trends_last_points", lambda f, t: traffic.last_points(traffic.trends(f, t, WEEK)), f"SELECT date_trunc('minute', timestamp) AS bucket, count(*) AS flows, {_B} AS bytes FROM flows WHERE {since(7)} GROUP BY bucket ORDER BY bucket DESC LIMIT 24")
_add("summary_totals", traffic.summary_totals, f"SELECT count(*) AS flows, {_B} AS bytes, count(DISTINCT src_ip) AS devices FROM flows WHERE {since()}")
_add("summary_top_apps", traffic.summary_top_apps, f"SELECT app_name, round(sum(bytes) / 1024 / 1024, 1) AS mb FROM flows WHERE {since()} AND app_name <> 'Unknown' GROUP BY app_name ORDER BY sum(bytes) DESC, app_name LIMIT 5")
_add("summary_peak_hours", lambda f, t: traffic.summary_peak_hours(f, t).select(F.col("h").cast("bigint").alias("h"), "c"), f"SELECT hour(timestamp) AS h, count(*) AS c FROM flows WHERE {since()} GROUP BY h ORDER BY c DESC, h LIMIT 3")
_add("topology_edges", lambda f, t: traffic.topology(f, t, DAY), f"""
SELECT src_ip, dst_ip, app_name, count(*) AS w, {_B} AS b FROM flows WHERE {since()} AND src_ip LIKE '192.168.%' AND dst_port IN (80, 443, 8080)
GROUP BY src_ip, dst_ip, app_name ORDER BY b DESC, src_ip, dst_ip, app_name LIMIT 200""")  # fmt: skip
_hour = lambda: F.col("h").cast("bigint").alias("h")
_add("timeline_apps", lambda f, t: traffic.timeline_apps(f, t).select(_hour(), "app_name", "c"), f"SELECT hour(timestamp) AS h, app_name, count(*) AS c FROM flows WHERE {since()} AND app_name NOT IN ('', 'Unknown') GROUP BY h, app_name")
_add("timeline_sites", lambda f, t: traffic.timeline_sites(f, t).select(_hour(), "sni", "dns_domain", "c"), f"""
SELECT hour(timestamp) AS h, sni, dns_domain, count(*) AS c FROM flows WHERE {since()} AND (sni <> '' OR dns_domain <> '')
GROUP BY h, sni, dns_domain ORDER BY h, c DESC, sni, dns_domain LIMIT 500""")  # fmt: skip
_add("topk_apps_per_hour", lambda f, t: traffic.top_per_group(traffic.timeline_apps(f, t, WEEK), "h", "c", 3, "app_name").select(_hour(), "app_name", "c", F.col("rank").cast("bigint").alias("rank")), f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY c DESC, app_name) AS rank FROM (
  SELECT hour(timestamp) AS h, app_name, count(*) AS c FROM flows WHERE {since(7)} AND app_name NOT IN ('', 'Unknown') GROUP BY h, app_name)) WHERE rank <= 3""")  # fmt: skip
_add("category_totals", lambda f, t: traffic.shares(window(f, t, WEEK), "app_category", traffic.volume()), f"""
SELECT app_category, {_B} AS total, round(100 * sum(bytes) / (SELECT sum(bytes) FROM flows WHERE {since(7)}), 2) AS percent FROM flows WHERE {since(7)} GROUP BY app_category""")  # fmt: skip
_add("tls_version_shares", lambda f, t: traffic.shares(window(f, t, WEEK).where("tls_version <> ''"), "tls_version", F.lit(1)), f"""
SELECT tls_version, count(*) AS total, round(100 * count(*) / (SELECT count(*) FROM flows WHERE {since(7)} AND tls_version <> ''), 2) AS percent
FROM flows WHERE {since(7)} AND tls_version <> '' GROUP BY tls_version""")  # fmt: skip
_add("chat_summary", lambda f, t: traffic.chat_summary(f, t, WEEK), f"""
SELECT count(*) FILTER ({_CHAT}) AS flows, CAST(coalesce(sum(bytes) FILTER ({_CHAT}), 0) AS BIGINT) AS bytes, round_even(avg(duration_ms) FILTER ({_CHAT}), 0) AS avg_ms,
  count(DISTINCT src_ip) FILTER ({_CHAT}) AS devices, count(DISTINCT dst_ip) FILTER ({_CHAT}) AS servers,
  CAST(floor(100 * count(*) FILTER ({_CHAT}) / count(*)) AS BIGINT) AS flow_percent, CAST(floor(100 * coalesce(sum(bytes) FILTER ({_CHAT}), 0) / sum(bytes)) AS BIGINT) AS byte_percent
FROM flows WHERE {since(7)}""")  # fmt: skip
_add("chat_devices", lambda f, t: traffic.chat_devices(f, t, WEEK), f"""
SELECT src_ip, max(device_manufacturer) AS mfg, count(*) AS flows, {_B} AS bytes, round_even(avg(duration_ms), 0) AS avg_ms FROM flows
WHERE {since(7)} AND {_CHAT} AND src_ip LIKE '192.168.%' GROUP BY src_ip ORDER BY bytes DESC, src_ip LIMIT 10""")  # fmt: skip
_add("chat_conn_types", lambda f, t: traffic.chat_types(f, t, WEEK), f"""
SELECT CASE WHEN duration_ms < 100 THEN 'heartbeat' WHEN duration_ms < 1000 THEN 'short' WHEN duration_ms < 5000 THEN 'msg' WHEN duration_ms < 30000 THEN 'file' ELSE 'media' END AS conn_type,
  count(*) AS c, round_even(avg(bytes), 0) AS avg_bytes, {_B} AS total_bytes FROM flows WHERE {since(7)} AND {_CHAT} GROUP BY conn_type""")  # fmt: skip
_add("chat_hourly", lambda f, t: traffic.chat_hours(f, t, WEEK).select(_hour(), "flows", "bytes", "devices"), f"SELECT hour(timestamp) AS h, count(*) AS flows, {_B} AS bytes, count(DISTINCT src_ip) AS devices FROM flows WHERE {since(7)} AND {_CHAT} GROUP BY h")
_add("chat_domains", lambda f, t: traffic.chat_domains(f, t, WEEK), f"SELECT dns_domain, count(*) AS hits, count(DISTINCT src_ip) AS devices FROM flows WHERE {since(7)} AND {_CHAT} AND dns_domain <> '' GROUP BY dns_domain ORDER BY hits DESC, dns_domain LIMIT 10")
_add("daily_rollup", lambda f, t: traffic.daily_rollup(f), f"SELECT CAST(timestamp AS DATE) AS date, app_id, app_name, app_category, count(*) AS flow_count, {_B} AS total_bytes, count(DISTINCT src_ip) AS unique_devices FROM flows GROUP BY ALL")
_add("dedup_latest", lambda f, t: traffic.latest_version(f.withColumn("timestamp", traffic.minute()).withColumn("first_seen", F.lit(0))).select("event_id", "timestamp", "src_ip", "last_seen"), """
SELECT event_id, m AS timestamp, src_ip, last_seen FROM (SELECT *, date_trunc('minute', timestamp) AS m, row_number() OVER (PARTITION BY date_trunc('minute', timestamp), src_ip ORDER BY last_seen DESC, event_id DESC) AS r FROM flows) WHERE r = 1""")  # fmt: skip
_add("retention", lambda f, t: traffic.retained(f, t, 10).agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM flows WHERE {since(10)}")

# devices
_DEST = "SELECT {d} src_ip, dest FROM (SELECT src_ip, unnest([sni, dns_domain]) AS dest FROM flows WHERE {w}) WHERE dest <> ''"
_BASELINE = _DEST.format(d="DISTINCT", w=f"{since(7)} AND {before(1)}")
_add("live_new_dests", lambda f, t: devices.new_destinations(f, t, DAY, WEEK), f"{_DEST.format(d='DISTINCT', w=since())} EXCEPT ({_BASELINE})")
_add("device_new_dests_all", lambda f, t: devices.new_destinations(f, t, DAY, WEEK, distinct=False), f"SELECT r.src_ip, r.dest FROM ({_DEST.format(d='', w=since())}) r WHERE NOT EXISTS (SELECT 1 FROM ({_BASELINE}) b WHERE b.src_ip = r.src_ip AND b.dest = r.dest)")
_add("device_first_seen", lambda f, t: devices.first_seen(f, t, DAY), f"{_DEST.format(d='DISTINCT', w=since())} EXCEPT ({_DEST.format(d='DISTINCT', w=before())})")
_add("device_baseline_size", lambda f, t: devices.baseline_size(f, t, DAY, WEEK), f"SELECT src_ip, count(DISTINCT sni) + count(DISTINCT dns_domain) AS size FROM flows WHERE {since(7)} AND {before()} GROUP BY src_ip")
_PRIVATE = "(src_ip LIKE '192.168.%' OR src_ip LIKE '10.%' OR regexp_matches(src_ip, '^172\\.(1[6-9]|2[0-9]|3[01])\\.[0-9]+\\.[0-9]+$'))"
_add("live_devices", lambda f, t: devices.live(f, t, DAY, WEEK).select("src_ip", "mac", "bytes", "flows", F.size("destinations").cast("bigint").alias("n_dest"), F.array_join("apps", "|").alias("apps"), F.array_join("new_dests", "|").alias("new_dests")), f"""
, g AS (SELECT src_ip, sni, dns_domain, app_name, sum(bytes) AS b, max(src_mac) AS m, CASE WHEN sni <> '' THEN sni ELSE dns_domain END AS dest FROM flows WHERE {since()} AND {_PRIVATE} GROUP BY ALL),
n AS (SELECT src_ip, string_agg(dest, '|' ORDER BY dest) AS new_dests FROM ({_DEST.format(d='DISTINCT', w=since())} EXCEPT ({_BASELINE})) GROUP BY src_ip),
a AS (SELECT src_ip, string_agg(app_name, '|' ORDER BY app_name) AS apps FROM (SELECT DISTINCT src_ip, app_name FROM g) GROUP BY src_ip)
SELECT g.src_ip, max(m) AS mac, CAST(sum(b) AS BIGINT) AS bytes, count(*) AS flows, count(DISTINCT nullif(dest, '')) AS n_dest, any_value(apps) AS apps, coalesce(any_value(new_dests), '') AS new_dests
FROM g JOIN a ON a.src_ip = g.src_ip LEFT JOIN n ON n.src_ip = g.src_ip GROUP BY g.src_ip""")  # fmt: skip
_ME = f"src_ip = '{DEVICE}'"
_add("device_current", lambda f, t: devices.current(f, DEVICE, t, WEEK), f"SELECT sni, dns_domain, app_name, count(*) AS flows, {_B} AS bytes FROM flows WHERE {_ME} AND {since(7)} GROUP BY ALL ORDER BY bytes DESC, sni, dns_domain, app_name LIMIT 20")
_add("device_trends", lambda f, t: devices.trends(f, DEVICE, t, WEEK), f"""
SELECT date_trunc('minute', timestamp) AS bucket, {_B} AS bytes, count(*) AS flows, count(*) FILTER (protocol = 'TCP') AS tcp, count(*) FILTER (protocol = 'UDP') AS udp,
  CAST(coalesce(sum(bytes) FILTER (protocol = 'TCP'), 0) AS BIGINT) AS tcp_bytes, CAST(coalesce(sum(bytes) FILTER (protocol = 'UDP'), 0) AS BIGINT) AS udp_bytes FROM flows WHERE {_ME} AND {since(7)} GROUP BY bucket""")  # fmt: skip
_add("tls_fingerprints", lambda f, t: devices.fingerprints(f, DEVICE, t, WEEK), f"SELECT tls_signature_hash, ja3, ja3s, tls_version, count(*) AS cnt FROM flows WHERE {_ME} AND {since(7)} AND tls_signature_hash <> '' GROUP BY ALL ORDER BY cnt DESC, ALL LIMIT 20".replace(", ALL LIMIT", ", tls_signature_hash, ja3, ja3s, tls_version LIMIT"))
_add("tls_distinct", lambda f, t: devices.fingerprint_count(f, DEVICE, t, WEEK), f"SELECT count(DISTINCT nullif(tls_signature_hash, '')) AS distinct_sigs FROM flows WHERE {_ME} AND {since(7)}")
_add("device_detail", lambda f, t: devices.detail(f, DEVICE, t, WEEK), f"SELECT src_ip, app_name, app_category, count(*) AS flow_count, {_B} AS total_bytes, max(sni) AS sni, max(dns_domain) AS dns_domain FROM flows WHERE {_ME} AND {since(7)} GROUP BY src_ip, app_name, app_category ORDER BY total_bytes DESC, app_name LIMIT 50")
_DEVICES = f"""
, dev AS (SELECT src_ip, max(src_mac) AS mac, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS flows, count(DISTINCT CASE WHEN app_name NOT IN ('', 'Unknown') THEN app_name END) AS n_apps FROM flows WHERE {since()} AND {_PRIVATE} GROUP BY src_ip),
doms AS (SELECT src_ip, count(DISTINCT dest) AS n_domains FROM ({_DEST.format(d='DISTINCT', w=since())}) GROUP BY src_ip),
prim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mac ORDER BY bytes DESC, src_ip DESC) AS r FROM dev) WHERE (r = 1 OR mac = '') AND substr(mac, 1, 8) NOT IN ('e2:08:f4', '5a:e2:02', 'ea:0c:af'))"""
_sized = lambda d: d.select("src_ip", "mac", "bytes", "flows", F.size("apps").cast("bigint").alias("n_apps"), F.size("domains").cast("bigint").alias("n_domains"))
_add("insights_devices", lambda f, t: _sized(devices.recent_devices(f, t, DAY)), _DEVICES + " SELECT dev.*, coalesce(n_domains, 0) AS n_domains FROM dev LEFT JOIN doms USING (src_ip)")
_add("insights_primary_ip", lambda f, t: devices.primary_addresses(devices.recent_devices(f, t, DAY)).select("src_ip", "mac", "bytes"), _DEVICES + " SELECT src_ip, mac, bytes FROM prim")
_SCORES = f"""nw AS (SELECT src_ip, count(*) AS new_count FROM ({_DEST.format(d='DISTINCT', w=since())} EXCEPT ({_DEST.format(d='DISTINCT', w=before())})) GROUP BY src_ip),
sz AS (SELECT src_ip, count(DISTINCT sni) + count(DISTINCT dns_domain) AS size FROM flows WHERE {since(7)} AND {before()} GROUP BY src_ip),
x AS (SELECT src_ip, coalesce(new_count, 0) AS new_count, coalesce(size, 0) AS size, coalesce(n_domains, 0) AS total, n_apps, flows FROM prim LEFT JOIN nw USING (src_ip) LEFT JOIN sz USING (src_ip) LEFT JOIN doms USING (src_ip)),
y AS (SELECT *, CASE WHEN total = 0 THEN 0.0 ELSE least(100, CASE WHEN size > 0 THEN new_count / total ELSE 1.0 END * 50 + CASE WHEN n_apps > 0 THEN ln(n_apps) / ln(5) ELSE 0 END * 25 + least(flows / 300, 1.0) * 25) END AS s FROM x)"""
_add("insights_scores", lambda f, t: devices.insights(f, t, DAY, WEEK).select("src_ip", "new_count", "size", F.round("raw_score", 6).alias("raw_score"), "alert"), f"{_DEVICES}, {_SCORES} SELECT src_ip, new_count, size, CAST(round(s, 6) AS DOUBLE) AS raw_score, s > 50 AS alert FROM y")
_SEES = lambda *parts: "coalesce(bool_or(" + " OR ".join(f"contains(dest, '{p}')" for p in parts) + "), false)"
_PROFILES = f"""
, seen AS (SELECT src_ip, {_SEES("apple.com", "icloud.com", "appsto.re")} AS apple, {_SEES("miui.com", "xiaomi.net", "micloud.xiaomi", "mi.com")} AS xiaomi, {_SEES("huawei.com", "hicloud.com")} AS huawei,
  {_SEES("wns.windows.com", "windowsupdate.com", "update.microsoft.com", "edge.microsoft.com")} AS windows, {_SEES("googleapis.com", "firebase")} AS android, {_SEES("guzzoni", "configuration.apple.com")} AS mac_only,
  {_SEES("iphone-ld", "courier.push")} AS phone_only, {_SEES("miui.com", "micloud.xiaomi")} AS mi_model, {_SEES("sys.miui.com")} AS mi_sys, {_SEES("samsung.com")} AS samsung FROM ({_DEST.format(d='DISTINCT', w=since())}) GROUP BY src_ip),
named AS (SELECT src_ip, bool_or(contains(app_name, 'WeChat')) AS chat, bool_or(contains(app_name, 'Apple') OR contains(app_name, 'iCloud')) AS apple_app, bool_or(contains(app_name, 'Windows')) AS windows_app
  FROM flows WHERE {since()} AND {_PRIVATE} AND app_name NOT IN ('', 'Unknown') GROUP BY src_ip),
marks AS (SELECT p.src_ip, p.mac, substr(p.mac, 1, 8) AS pre, {", ".join(f"coalesce({c}, false) AS {c}" for c in ("apple", "xiaomi", "huawei", "windows", "android", "mac_only", "phone_only", "mi_model", "mi_sys", "samsung", "chat", "apple_app", "windows_app"))}
  FROM prim p LEFT JOIN seen s ON s.src_ip = p.src_ip LEFT JOIN named n ON n.src_ip = p.src_ip),
profiles AS (SELECT src_ip, string_split(CASE WHEN pre IN ('aa:80:a0', 'de:2c:28') THEN 'Xiaomi|Android' WHEN pre IN ('5e:8f:c9', '6c:1f:f7', 'fc:25:3f', 'f0:18:98') THEN 'Apple 设备|iOS/macOS' WHEN pre = 'ea:0c:af' THEN 'NRadio 路由器|OpenWrt'
    WHEN pre IN ('b4:6e:10', '3a:a4:28') THEN 'Vivo|Android' WHEN pre IN ('e2:08:f4', '5a:e2:02') THEN '代理客户端|Clash/Surge' WHEN pre = 'd6:cb:c4' THEN 'Apple 设备|iOS' WHEN xiaomi THEN 'Xiaomi|Android' WHEN huawei THEN 'Huawei|Android'
    WHEN windows AND NOT apple AND NOT chat THEN 'Windows PC|Windows' WHEN apple AND mac_only THEN 'Mac|macOS' WHEN apple AND phone_only THEN 'iPhone/iPad|iOS' WHEN apple THEN 'Apple Device|iOS/macOS' WHEN android AND chat THEN 'Android 手机|Android'
    WHEN apple_app THEN 'Apple Device|iOS/macOS' WHEN windows_app THEN 'Windows PC|Windows' WHEN chat THEN '手机|移动端' ELSE '未知设备|Unknown' END, '|') AS told,
  CASE WHEN mi_model AND mi_sys AND mac = 'aa:80:a0:29:4e:0a' THEN 'Xiaomi 13 Pro' WHEN mi_model THEN 'Xiaomi 手机' WHEN huawei THEN 'Huawei 手机' WHEN samsung THEN 'Samsung Galaxy' ELSE '' END AS model FROM marks)"""
_add("insights_profiles", lambda f, t: devices.insights(f, t, DAY, WEEK).select("src_ip", "kind", "os", "model"), f"{_DEVICES}{_PROFILES} SELECT src_ip, told[1] AS kind, told[2] AS os, model FROM profiles")
_add("insights_os_breakdown", lambda f, t: devices.insight_summary(devices.insights(f, t, DAY, WEEK)), f"""{_DEVICES}{_PROFILES}, {_SCORES}
SELECT count(*) AS devices, count(*) FILTER (told[2] = 'Android') AS android, count(*) FILTER (told[2] = 'iOS') AS ios, count(*) FILTER (told[2] = 'macOS') AS macos, count(*) FILTER (told[2] = 'Windows') AS windows,
  count(*) FILTER (told[2] NOT IN ('Android', 'iOS', 'macOS', 'Windows')) AS other, count(*) FILTER (told[2] IN ('iOS', 'macOS', 'iOS/macOS')) AS apple_corrected, count(*) FILTER (floor(s) > 50) AS high_risk
FROM profiles JOIN y ON y.src_ip = profiles.src_ip""")  # fmt: skip
_add("alerts_traffic", lambda f, t: devices.traffic_alerts(f, t, DAY, most=200_000), f"""
SELECT src_ip, count(DISTINCT sni) + count(DISTINCT dns_domain) AS dests, count(DISTINCT app_name) AS apps, {_B} AS bytes FROM flows WHERE {since()} AND src_ip LIKE '192.168.%'
GROUP BY src_ip HAVING dests > 10 OR bytes > 200000 ORDER BY bytes DESC, src_ip LIMIT 20""")  # fmt: skip
_ALERTS = f"WITH {BASE}, now AS (SELECT max(timestamp) AS t FROM base), alerts AS (SELECT event_id, timestamp, src_ip, src_mac, CAST(k AS BIGINT) AS risk_score FROM base WHERE event_type = 'error') "
_score = lambda: F.col("risk_score").cast("bigint").alias("risk_score")
_alert = lambda e: projections.alerts_from_events(e)
_add_events("alerts_anomaly", lambda e, t: devices.top_alerts(_alert(e), t, WEEK).select("event_id", "timestamp", "src_ip", "src_mac", _score()), _ALERTS + f"SELECT * FROM alerts WHERE {since(7)} ORDER BY risk_score DESC, timestamp DESC, event_id LIMIT 50")
_add_events("anomalies_summary", lambda e, t: devices.alert_summary(_alert(e), t, WEEK).select("total", F.round("avg_risk", 6).alias("avg_risk"), F.col("max_risk").cast("bigint").alias("max_risk"), "affected_devices"), _ALERTS + f"SELECT count(*) AS total, round(avg(risk_score), 6) AS avg_risk, max(risk_score) AS max_risk, count(DISTINCT src_ip) AS affected_devices FROM alerts WHERE {since(7)}")
_add_events("anomalies_unresolved", lambda e, t: devices.unresolved(_alert(e), _alert(e).where("risk_score = 99"), t, WEEK).select("event_id", "timestamp", "src_ip", _score()), _ALERTS + f"SELECT event_id, timestamp, src_ip, risk_score FROM (SELECT * FROM alerts WHERE {since(7)} ORDER BY risk_score DESC, timestamp DESC, event_id LIMIT 100) WHERE src_ip NOT IN (SELECT src_ip FROM alerts WHERE risk_score = 99)")
_add_events("alerts_affected", lambda e, t: devices.affected(_alert(e)), _ALERTS + "SELECT count(DISTINCT src_ip) AS devices, count(*) FILTER (risk_score >= 75) AS critical FROM alerts")
_SESSIONS = f"WITH {BASE}, s AS (SELECT event_id, timestamp, {{d}} AS host, ['GET', 'POST', 'PUT'][k % 3 + 1] AS method, '/p/' || k AS path, k AS content_length FROM base WHERE event_type = 'click') ".replace("{d}", "sni")
_add_events("http_sessions", lambda e, t: traffic.newest_sessions(projections.sessions_from_events(e)).select("event_id", "timestamp", "host", "method", "path", "content_length"), _SESSIONS + "SELECT * FROM s ORDER BY timestamp DESC, event_id LIMIT 100")
_add_events("health", lambda e, t: traffic.health(projections.flows_from_events(e, classified=False), projections.sessions_from_events(e)), _SESSIONS + "SELECT (SELECT count(*) FROM base) AS flows, (SELECT max(timestamp) FROM base) AS last_flow, (SELECT count(*) FROM s) AS http_sessions")
_add("geo_points", lambda f, t: traffic.located(f, projections.geo(f.sparkSession), t, WEEK), f"""
, geo AS (SELECT '198.51.100.' || i AS ip, 'Country ' || (i % 5) AS country, 'City ' || (i % 20) AS city, CAST(i % 20 - 10 AS DOUBLE) AS lat, CAST(i % 20 * 2 AS DOUBLE) AS lon FROM range(100) r(i) WHERE i % 10 <> 0)
SELECT lat, lon, country, city, count(*) AS flows, {_B} AS bytes FROM flows JOIN geo ON dst_ip = ip WHERE {since(7)} GROUP BY lat, lon, country, city""")  # fmt: skip
def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A location for each supplier's address."""
    suppliers, nations = spark.read.parquet(f"{sf_dir}/supplier.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.concat(F.lit("198.51.100."), F.col("s_suppkey").cast("string")).alias("ip"), F.col("n_name").alias("country"), F.col("s_name").alias("city"), (F.col("s_nationkey") - 12).cast("double").alias("lat"), (F.col("s_suppkey") % 180).cast("double").alias("lon"))


QUERIES["geo_lookup"] = lambda spark, sf_dir: traffic.geo_lookup(" 198.51.100.1, ,198.51.100.0,198.51.100.7,198.51.100.9", _places(spark, sf_dir))
ORACLE["geo_lookup"] = "SELECT '198.51.100.' || s_suppkey AS ip, n_name AS country, s_name AS city, CAST(s_nationkey - 12 AS DOUBLE) AS lat, CAST(s_suppkey % 180 AS DOUBLE) AS lon FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey IN (0, 1, 7, 9)"

# classification
_add("classify_apps", lambda f, t: f.groupBy("app_id", "app_name", "app_category", F.round(F.col("confidence").cast("double"), 2).alias("conf")).agg(F.count("*").alias("n")), "SELECT app_id, app_name, app_category, CAST(confidence AS DOUBLE) AS conf, count(*) AS n FROM flows GROUP BY ALL")
_add_events("classify_ports", lambda e, t: projections.flows_from_events(e, classified=False).select("event_id", classify.rules_engine(F.lit(""), F.lit(""), F.col("src_port") % 6000).alias("v")).groupBy("v.app_id", "v.app_name").agg(F.count("*").alias("n")), FLOWS + "SELECT CAST(coalesce(p.app_id, 0) AS BIGINT) AS app_id, coalesce(p.app_name, 'Unknown') AS app_name, count(*) AS n FROM base LEFT JOIN services p ON p.port = base.src_port % 6000 GROUP BY ALL")


def _voted(flows: DataFrame) -> DataFrame:
    """The vote of all three engines, on flows whose fingerprints and names come and go."""
    k = F.substring_index("dst_ip", ".", -1).cast("int")
    ja3 = F.get(F.array(*[F.lit(x) for x in VOTE_JA3]), k % len(VOTE_JA3))
    name, port = F.when(k % 3 == 0, F.col("sni")).otherwise(""), F.when(k % 2 == 0, F.col("dst_port")).otherwise(9999)
    verdicts = F.array(classify.rules_engine(name, F.lit(""), port), classify.ja3_engine(ja3), classify.flow_engine(*[F.col(c) for c in ("bytes_up", "bytes_down", "packets_up", "packets_down", "duration_ms")]))
    vote = classify.accepted(classify.weighted_vote(verdicts))
    return flows.select("event_id", vote.alias("v")).select("event_id", "v.app_id", "v.app_name", "v.app_category", F.round(F.col("v.confidence").cast("double"), 4).alias("conf"))


VOTE_JA3 = ("6734f37431670b3aaaaa", "e7d705a3286e19eabbbb", "e7ffffffffffffffcccc", "c1d2e3f4a5b6c7d8dddd", "", "0000000000000000")
_add("classify_votes", lambda f, t: _voted(f), """
, q AS (SELECT event_id, ['6734f37431670b3a', 'e7d705a3286e19ea', 'e7ffffffffffffff', 'c1d2e3f4a5b6c7d8', '', '0000000000000000'][k % 6 + 1] AS fp,
    CASE WHEN k % 3 = 0 THEN lower(sni) ELSE '' END AS s, CASE WHEN k % 2 = 0 THEN dst_port ELSE 9999 END AS port, bytes AS tb, packets_up + packets_down AS tp, bytes_up AS bup, bytes_down AS bd, duration_ms // 1000 AS secs FROM base),
m AS (SELECT event_id, min(ord) AS ord FROM q JOIN rules ON s = domain OR ends_with(s, '.' || domain) GROUP BY event_id),
v AS (
  SELECT q.event_id, 0 AS i, coalesce(r.app_id, p.app_id, 0) AS app_id, coalesce(r.app_name, p.app_name, 'Unknown') AS app_name, coalesce(r.app_category, p.app_category, 'Unknown') AS app_category,
    CASE WHEN r.ord IS NOT NULL THEN 0.85 WHEN p.port IS NOT NULL THEN 0.6 ELSE 0 END AS c, 1.0 AS w FROM q LEFT JOIN m ON m.event_id = q.event_id LEFT JOIN rules r ON r.ord = m.ord LEFT JOIN services p ON p.port = q.port
  UNION ALL
  SELECT event_id, 1, CASE fp WHEN '6734f37431670b3a' THEN 500 WHEN 'e7d705a3286e19ea' THEN 520 WHEN 'e7ffffffffffffff' THEN 520 WHEN 'c1d2e3f4a5b6c7d8' THEN 505 ELSE 0 END,
    CASE fp WHEN '6734f37431670b3a' THEN 'Cobalt Strike' WHEN 'e7d705a3286e19ea' THEN 'Chrome' WHEN 'e7ffffffffffffff' THEN 'Chrome (推测)' WHEN 'c1d2e3f4a5b6c7d8' THEN 'Clash' ELSE 'Unknown' END,
    CASE fp WHEN '6734f37431670b3a' THEN 'Malware' WHEN 'e7d705a3286e19ea' THEN 'Browser' WHEN 'e7ffffffffffffff' THEN 'Browser' WHEN 'c1d2e3f4a5b6c7d8' THEN 'Proxy' ELSE 'Unknown' END,
    CASE fp WHEN '6734f37431670b3a' THEN 0.95 WHEN 'e7d705a3286e19ea' THEN 0.85 WHEN 'e7ffffffffffffff' THEN 0.3 WHEN 'c1d2e3f4a5b6c7d8' THEN 0.7 ELSE 0 END, 0.7 FROM q
  UNION ALL
  SELECT event_id, 2, 0, n, CASE n WHEN '视频流' THEN 'Streaming' WHEN '文件下载' THEN 'Transfer' WHEN '心跳' THEN 'System' WHEN '上传' THEN 'Transfer' WHEN '交互' THEN 'Interactive' ELSE 'Unknown' END,
    CASE n WHEN '视频流' THEN 0.75 WHEN '文件下载' THEN 0.7 WHEN '心跳' THEN 0.8 WHEN '上传' THEN 0.6 WHEN '交互' THEN 0.45 ELSE 0 END, 0.5
  FROM (SELECT event_id, CASE WHEN tb < 1 OR tp < 1 THEN 'Unknown' WHEN bd / greatest(tb, 1) > 0.8 AND tb / tp > 800 AND secs > 10 THEN '视频流' WHEN bd / greatest(tb, 1) > 0.9 AND tb / tp > 1000 AND secs < 30 THEN '文件下载'
    WHEN tb < 5000 AND tp <= 6 AND tb / tp < 500 THEN '心跳' WHEN bup > bd AND tb > 100000 THEN '上传' WHEN tb / tp < 300 AND tp > 5 THEN '交互' ELSE 'Unknown' END AS n FROM q)
), g AS (
  SELECT event_id, app_id, sum(c * w) AS score, arg_max(app_name, c * 10 - i) AS app_name, arg_max(app_category, c * 10 - i) AS app_category FROM v GROUP BY event_id, app_id
), o AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, app_id DESC) AS r, lead(score, 1, 0) OVER (PARTITION BY event_id ORDER BY score DESC, app_id DESC) AS next FROM g)
SELECT event_id, CAST(CASE WHEN ok THEN app_id ELSE 0 END AS BIGINT) AS app_id, CASE WHEN ok THEN app_name ELSE '' END AS app_name, CASE WHEN ok THEN app_category ELSE '' END AS app_category,
  CAST(round(CASE WHEN ok THEN least(score, 0.99) ELSE 0 END, 4) AS DOUBLE) AS conf
FROM (SELECT *, score > 0.30001 AND (score > 1.5 * next OR score > 0.5) AS ok FROM o WHERE r = 1)""")  # fmt: skip
_add("device_manufacturer", lambda f, t: f.groupBy("device_manufacturer").agg(F.count("*").alias("n")), "SELECT device_manufacturer, count(*) AS n FROM flows GROUP BY ALL")

# packets, sessions, behaviour
_add_events("size_histogram", lambda e, t: projections.flows_from_events(e, classified=False).groupBy("protocol").agg(net.size_histogram(F.col("bytes_up") % 1700).alias("h")).select("protocol", F.array_join(F.transform("h", lambda x: x.cast("string")), ",").alias("hist")), f"WITH {BASE}, b AS (SELECT protocol, bytes_up % 1700 AS s FROM base) SELECT protocol, " + " || ',' || ".join(f"count(*) FILTER ({c})" for c in ("s <= 64", "s BETWEEN 65 AND 128", "s BETWEEN 129 AND 256", "s BETWEEN 257 AND 512", "s BETWEEN 513 AND 1024", "s BETWEEN 1025 AND 1500", "s > 1500")) + " AS hist FROM b GROUP BY protocol")
_HOUR_NS = 3_600_000_000_000
_add_events("interarrival_mean", lambda e, t: sessions.interarrival(e.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("at"), "event_id"), ["user_id"], "at", "event_id", 10 * _HOUR_NS).select("user_id", F.round("iat_mean_us", 3).alias("iat_mean_us"), "gaps"), f"SELECT user_id, round(coalesce(avg(g) FILTER (g < {10 * _HOUR_NS}), 0) / 1000, 3) AS iat_mean_us, count(*) FILTER (g < {10 * _HOUR_NS}) AS gaps FROM (SELECT user_id, epoch_us(ts) * 1000 - lag(epoch_us(ts) * 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events) GROUP BY user_id")
_add_events("sessions_idle", lambda e, t: sessions.idle_sessions(e.select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id", 12 * 3600), """
SELECT user_id, s AS session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS rows FROM (
  SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS s FROM (
    SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 43200 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s""")  # fmt: skip
_add_events("sessions_lifetime", lambda e, t: sessions.capped_sessions(e.select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "event_id"), ["user_id"], "at", 12 * 3600, 48 * 3600), """
WITH RECURSIVE o AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
r AS (SELECT user_id, n, sec, sec AS begun, 1 AS part FROM o WHERE n = 1 UNION ALL
  SELECT o.user_id, o.n, o.sec, CASE WHEN o.sec - r.sec > 43200 OR o.sec - r.begun > 172800 THEN o.sec ELSE r.begun END, r.part + CASE WHEN o.sec - r.sec > 43200 OR o.sec - r.begun > 172800 THEN 1 ELSE 0 END
  FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id, min(begun) AS first_at, max(sec) AS last_at, count(*) AS rows FROM r GROUP BY user_id, part""")  # fmt: skip
_W = """, d AS (SELECT event_id, timestamp, src_ip, bytes, duration_ms, hour(timestamp) AS h, CASE WHEN sni <> '' THEN sni ELSE dns_domain END AS domain FROM base),
f1 AS (SELECT *, row_number() OVER w - 1 AS n, domain <> '' AND row_number() OVER (PARTITION BY src_ip, domain ORDER BY timestamp, event_id) = 1 AS is_new, bytes / greatest(duration_ms / 1000, 0.1) AS rate,
  count(*) OVER (PARTITION BY src_ip, h ORDER BY timestamp, event_id) - 1 AS hour_count FROM d WINDOW w AS (PARTITION BY src_ip ORDER BY timestamp, event_id)),
f2 AS (SELECT *, coalesce(sum(CASE WHEN is_new THEN 1 ELSE 0 END) OVER w, 0) AS known, coalesce(sum(CASE WHEN rate > 0 THEN 1 ELSE 0 END) OVER w, 0) AS pos FROM f1 WINDOW w AS (PARTITION BY src_ip ORDER BY timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f3 AS (SELECT *, avg(CASE WHEN rate > 0 THEN rate END) OVER (PARTITION BY src_ip ORDER BY pos RANGE BETWEEN 60 PRECEDING AND 1 PRECEDING) AS mean FROM f2),
s AS (SELECT *, CASE WHEN NOT is_new THEN 0 WHEN n < 20 THEN 10 ELSE 10 + 25 * least(known / 2000, 1) END AS novelty,
  CASE WHEN n < 20 OR mean IS NULL OR mean < 1 THEN 0 WHEN rate / mean > 5 THEN least(15 + 10 * least((rate / mean - 5) / 5, 1), 25) WHEN rate / mean < 0.1 AND bytes > 100000 THEN 10 ELSE 0 END AS volume,
  CASE WHEN n < 20 THEN 0 WHEN hour_count / greatest(n, 1) < 1.0 / 240 AND n > 100 THEN CASE WHEN h < 6 OR h >= 23 THEN 20 ELSE 10 END WHEN hour_count / greatest(n, 1) < 1.0 / 48 AND hour_count < 3 THEN 8 ELSE 0 END AS timing FROM f3) """
_raw = lambda e: projections.flows_from_events(e, classified=False)
for _part in ("novelty", "volume", "timing"):
    _add_events(f"anomaly_{_part}", lambda e, t, c=_part: anomaly.scored(_raw(e)).select("event_id", F.round(c, 4).alias(c)), f"WITH {BASE}{_W} SELECT event_id, CAST(round({_part}, 4) AS DOUBLE) AS {_part} FROM s")
_add_events("anomaly_risk", lambda e, t: anomaly.scored(_raw(e)).groupBy("src_ip").agg(F.sum(F.col("risk_score").cast("bigint")).alias("risk"), F.max("risk_score").cast("bigint").alias("top")), f"WITH {BASE}{_W} SELECT src_ip, CAST(sum(floor(novelty + volume + timing)) AS BIGINT) AS risk, CAST(max(floor(novelty + volume + timing)) AS BIGINT) AS top FROM s GROUP BY src_ip")
_add_events("anomaly_alerts_cooled", lambda e, t: anomaly.alerts(anomaly.scored(_raw(e)), 25).withColumn("risk_score", _score()), f"""
WITH RECURSIVE {BASE}{_W}, a AS (
  SELECT s.event_id, s.timestamp, s.src_ip, b.src_mac, CAST(floor(least(novelty + volume + timing, 100)) AS BIGINT) AS risk_score,
    CASE WHEN novelty <= 15 AND volume <= 15 AND timing <= 15 THEN 'behaviour deviates from the baseline'
      ELSE concat_ws('; ', CASE WHEN novelty > 15 THEN 'new domain: ' || domain END, CASE WHEN volume > 15 THEN 'unusual traffic volume' END, CASE WHEN timing > 15 THEN 'unusual time' END) END AS reason
  FROM s JOIN base b ON b.event_id = s.event_id
), o AS (SELECT *, row_number() OVER (PARTITION BY src_ip, reason ORDER BY timestamp, event_id) AS n FROM a WHERE risk_score >= 25),
r AS (SELECT *, timestamp AS last, true AS keep FROM o WHERE n = 1 UNION ALL
  SELECT o.*, CASE WHEN o.timestamp - r.last >= INTERVAL 300 SECOND THEN o.timestamp ELSE r.last END, o.timestamp - r.last >= INTERVAL 300 SECOND
  FROM r JOIN o ON o.src_ip = r.src_ip AND o.reason = r.reason AND o.n = r.n + 1)
SELECT event_id, timestamp, src_ip, src_mac, risk_score, reason FROM r WHERE keep""")  # fmt: skip

QUERIES |= messages.QUERIES | stored.QUERIES
ORACLE |= messages.ORACLE | stored.ORACLE

"""Application and device classification as column expressions: rule tables, fingerprints, flow shape and a vote.

Every verdict is a struct (engine, app_id, app_name, app_category, confidence, detail). Confidences are 32-bit
floats, and thresholds compare in that type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.lookup import first_suffix, let, lookup
from flowlens.plans import dimensions

WEIGHTS = {"rules": 1.0, "ja3": 0.7, "flow": 0.5}
OTHER_WEIGHT, ACCEPT = 0.3, 0.3


def f32(x) -> Column:
    return (F.lit(x) if isinstance(x, (int, float)) else x).cast("float")


def verdict(engine: str, app_id, name, category, confidence, detail="") -> Column:
    of = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(engine).alias("engine"), of(app_id).cast("long").alias("app_id"), of(name).alias("app_name"), of(category).alias("app_category"), f32(confidence).alias("confidence"), of(detail).alias("detail"))


def unknown(engine: str) -> Column:
    return verdict(engine, 0, "Unknown", "Unknown", 0.0)


def rules_engine(sni: Column, dns: Column, port: Column, rules=None, ports=None) -> Column:
    """The first rule whose domain is that of the TLS or DNS name or a parent of it; else the port's service."""
    table: dict[str, tuple] = {}
    for ord_, app_id, name, category, domain in rules or dimensions.rules():
        table.setdefault(domain, (ord_, app_id, name, category))
    match = first_suffix(table, "ord int,app_id bigint,app_name string,app_category string")
    service = lookup(ports or dimensions.ports(), "app_id bigint,app_name string,app_category string")(port.cast("string"))
    rule = F.array_min(F.filter(F.array(match(sni), match(dns)), lambda r: r.isNotNull()))
    named = lambda x, c: F.when(x.isNotNull(), verdict("rules", x["app_id"], x["app_name"], x["app_category"], c))
    return F.coalesce(let(rule, lambda x: named(x, 0.85)), let(service, lambda x: named(x, 0.6)), unknown("rules"))


def ja3_engine(ja3: Column, table=None) -> Column:
    prefix = F.substring(ja3, 1, 16)
    found = lookup(table or dimensions.fingerprints(), "app_id bigint,app_name string,app_category string,confidence float")(prefix)
    guess = F.substring(ja3, 1, 2).isin("e7", "51", "a0")
    return (
        F.when(F.coalesce(F.length(ja3), F.lit(0)) < 16, unknown("ja3"))
        .otherwise(F.coalesce(let(found, lambda x: F.when(x.isNotNull(), verdict("ja3", x["app_id"], x["app_name"], x["app_category"], x["confidence"]))), F.when(guess, verdict("ja3", 520, "Chrome (推测)", "Browser", 0.30)), unknown("ja3")))
    )


def flow_engine(bytes_up: Column, bytes_down: Column, packets_up: Column, packets_down: Column, duration_ms: Column) -> Column:
    """A guess from volumes and durations alone; the first case that holds."""
    total, packets = bytes_up + bytes_down, packets_up + packets_down
    down, size, secs = bytes_down / F.greatest(total, F.lit(1)), total / F.greatest(packets, F.lit(1)), F.floor(duration_ms / 1000)
    return (
        F.when((total < 1) | (packets < 1), unknown("flow"))
        .when((down > 0.8) & (size > 800) & (secs > 10), verdict("flow", 0, "视频流", "Streaming", 0.75))
        .when((down > 0.9) & (size > 1000) & (secs < 30), verdict("flow", 0, "文件下载", "Transfer", 0.70))
        .when((total < 5000) & (packets <= 6) & (size < 500), verdict("flow", 0, "心跳", "System", 0.80))
        .when((bytes_up > bytes_down) & (total > 100_000), verdict("flow", 0, "上传", "Transfer", 0.60))
        .when((size < 300) & (packets > 5), verdict("flow", 0, "交互", "Interactive", 0.45))
        .otherwise(unknown("flow"))
    )


def weighted_vote(verdicts: Column) -> Column:
    return let(verdicts, _voted)


def _voted(verdicts: Column) -> Column:
    """app_id, app_name, app_category, confidence of the winner: its weighted confidence is over half, or over one
    and a half times the next one's. The most confident verdict names its app_id's group, the first of equal ones."""
    weight = lambda v: F.coalesce(*[F.when(v["engine"] == k, f32(w)) for k, w in WEIGHTS.items()], f32(OTHER_WEIGHT))
    ids = F.array_distinct(F.transform(verdicts, lambda v: v["app_id"]))

    def group(app_id: Column) -> Column:
        own = F.filter(verdicts, lambda v: v["app_id"] == app_id)
        score = F.aggregate(own, f32(0.0), lambda s, v: (s + v["confidence"] * weight(v)).cast("float"))
        top = F.array_max(F.transform(own, lambda v, i: F.struct(v["confidence"].alias("c"), (-i).alias("i"), v["app_name"].alias("app_name"), v["app_category"].alias("app_category"))))
        return F.struct(score.alias("score"), app_id.alias("app_id"), top["app_name"].alias("app_name"), top["app_category"].alias("app_category"))

    def won(ranked: Column) -> Column:
        first, second = F.get(ranked, F.lit(0)), F.coalesce(F.get(ranked, F.lit(1))["score"], f32(0.0))
        wins = (first["score"] > 0) & ((first["score"] > (second * f32(1.5))) | (first["score"] > f32(0.5)))
        named = F.struct(first["app_id"].alias("app_id"), first["app_name"].alias("app_name"), first["app_category"].alias("app_category"), F.least(first["score"], f32(0.99)).alias("confidence"))
        none = F.struct(F.lit(0).cast("long").alias("app_id"), F.lit("Unknown").alias("app_name"), F.lit("Unknown").alias("app_category"), f32(0.0).alias("confidence"))
        return F.when(wins, named).otherwise(none)

    return let(F.reverse(F.array_sort(F.transform(ids, group))), won)


def accepted(vote: Column) -> Column:
    """A vote of no more than 0.3 is never stored."""
    none = F.struct(F.lit(0).cast("long").alias("app_id"), F.lit("").alias("app_name"), F.lit("").alias("app_category"), f32(0.0).alias("confidence"))
    return let(vote, lambda v: F.when(v["confidence"] > f32(ACCEPT), v).otherwise(none))


def manufacturer(sni: Column, dns: Column, mac: Column, table=None) -> Column:
    """By the MAC address, else by names; '' if neither tells."""
    own = lookup(table or dimensions.manufacturers(), "vendor string")(F.lower(F.substring(mac, 1, 8)))["vendor"]
    s, d = F.lower(sni), F.lower(dns)
    under = lambda name, domain: (name == domain) | name.endswith("." + domain)
    either = lambda part: s.contains(part) | d.contains(part)
    named = (
        F.when(either("miui") | either("micloud"), "Xiaomi")
        .when(under(s, "apple.com") | under(d, "icloud.com"), "Apple")
        .when(s.contains("huawei") | d.contains("hicloud"), "Huawei")
        .when(either("windowsupdate") | either("wns.windows"), "Microsoft Windows")
        .when(either("samsung"), "Samsung")
        .otherwise("")
    )
    return F.coalesce(own, named)


def with_manufacturer(rows: DataFrame, registry: DataFrame, sni: str = "sni", dns: str = "dns_domain", mac: str = "src_mac", name: str = "device_manufacturer") -> DataFrame:
    """rows and their manufacturer by a registry (prefix, vendor) of any size, such as `dimensions.registry` reads; by names
    where it has none. The first vendor by name counts of a prefix that stands twice."""
    known = registry.groupBy(F.lower("prefix").alias("_prefix")).agg(F.min("vendor").alias("_vendor"))
    found = rows.withColumn("_prefix", F.lower(F.substring(F.col(mac), 1, 8))).join(known, "_prefix", "left")
    by_name = manufacturer(F.col(sni), F.col(dns), F.lit(""))
    return found.withColumn(name, F.coalesce("_vendor", by_name)).select(*[c for c in rows.columns if c != name], name)


def vendor_of_device(vendor_class: Column, mac: Column, table=None) -> Column:
    """DHCP vendor class first, then the MAC address."""
    v = F.lower(F.coalesce(vendor_class, F.lit("")))
    return F.when(v.contains("iphone"), "Apple").when(v.contains("xiaomi") | v.contains("mi "), "Xiaomi").when(v.contains("huawei"), "Huawei").otherwise(manufacturer(F.lit(""), F.lit(""), mac, table))


def device_profile(apps: Column, domains: Column, mac: Column) -> Column:
    """kind, os, confidence from the applications and names a device talks to, and its MAC address."""
    prefix = F.lower(F.substring(F.coalesce(mac, F.lit("")), 1, 8))
    named = F.array_join(apps, " ")
    sees = lambda *parts: F.exists(domains, lambda d: _any(d, parts))
    is_ = lambda kind, os, c: F.struct(F.lit(kind).alias("kind"), F.lit(os).alias("os"), f32(c).alias("confidence"))
    apple = sees("apple.com", "icloud.com", "appsto.re")
    xiaomi = sees("miui.com", "xiaomi.net", "micloud.xiaomi", "mi.com")
    windows = sees("wns.windows.com", "windowsupdate.com", "update.microsoft.com", "edge.microsoft.com")
    android = sees("googleapis.com", "firebase")
    chat = named.contains("WeChat")
    return (
        F.when(prefix.isin("aa:80:a0", "de:2c:28"), is_("Xiaomi", "Android", 0.9))
        .when(prefix.isin("5e:8f:c9", "6c:1f:f7", "fc:25:3f", "f0:18:98"), is_("Apple 设备", "iOS/macOS", 0.7))
        .when(prefix == "ea:0c:af", is_("NRadio 路由器", "OpenWrt", 0.9))
        .when(prefix.isin("b4:6e:10", "3a:a4:28"), is_("Vivo", "Android", 0.9))
        .when(prefix.isin("e2:08:f4", "5a:e2:02"), is_("代理客户端", "Clash/Surge", 0.6))
        .when(prefix == "d6:cb:c4", is_("Apple 设备", "iOS", 0.6))
        .when(xiaomi, is_("Xiaomi", "Android", 0.85))
        .when(sees("huawei.com", "hicloud.com"), is_("Huawei", "Android", 0.85))
        .when(windows & ~apple & ~chat, is_("Windows PC", "Windows", 0.7))
        .when(apple & sees("guzzoni", "configuration.apple.com"), is_("Mac", "macOS", 0.8))
        .when(apple & sees("iphone-ld", "courier.push"), is_("iPhone/iPad", "iOS", 0.8))
        .when(apple, is_("Apple Device", "iOS/macOS", 0.6))
        .when(android & chat, is_("Android 手机", "Android", 0.6))
        .when(named.contains("Apple") | named.contains("iCloud"), is_("Apple Device", "iOS/macOS", 0.5))
        .when(named.contains("Windows"), is_("Windows PC", "Windows", 0.5))
        .when(chat, is_("手机", "移动端", 0.4))
        .otherwise(is_("未知设备", "Unknown", 0.0))
    )


def _any(column: Column, parts) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | column.contains(part)
    return out


#: Device models by names and user agent: (name parts, all user agent parts, model); the first row that holds.
MODELS = [
    (("miui.com", "micloud.xiaomi"), [(("xiaomi14", "fuxi"), "Xiaomi 14"), (("xiaomi13",), "Xiaomi 13"), (("xiaomi12", "cupid"), "Xiaomi 12"), (("xiaomi11",), "Xiaomi 11"), (("redmi", "note "), "Redmi Note")], "Xiaomi 手机"),
    (("apple.com", "icloud.com"), [(("iphone15,3",), "iPhone 14 Pro Max"), (("iphone15,2",), "iPhone 14 Pro"), (("iphone14,8",), "iPhone 14 Plus"), (("iphone14,3",), "iPhone 13 Pro Max"), (("iphone&16,",), "iPhone 15"), (("iphone&15,",), "iPhone 14"), (("iphone&14,",), "iPhone 13"), (("iphone",), "iPhone"), (("macbookpro&macintosh", "macbookpro&mac os"), "MacBook Pro"), (("macbookair&macintosh", "macbookair&mac os"), "MacBook Air"), (("macmini&macintosh", "macmini&mac os"), "Mac mini"), (("macintosh", "mac os"), "Mac"), (("ipad&ipadpro",), "iPad Pro"), (("ipad",), "iPad")], None),
    (("huawei.com", "hicloud.com"), [(("pura70",), "Huawei Pura 70"), (("mate60",), "Huawei Mate 60"), (("p60",), "Huawei P60"), (("nova",), "Huawei Nova")], "Huawei 手机"),
]


def device_model(domains: Column, mac: Column, user_agent: Column) -> Column:
    names, ua = F.array_join(domains, " "), F.lower(F.coalesce(user_agent, F.lit("")))

    def agent(parts) -> Column:
        out = F.lit(False)
        for part in parts:
            both = F.lit(True)
            for x in part.split("&"):
                both = both & ua.contains(x)
            out = out | both
        return out

    cases: list[Column] = []
    for domains_, models, other in MODELS:
        here = _any(names, domains_)
        cases += [F.when(here & agent(parts), model) for parts, model in models]
        if domains_[0] == "miui.com":
            cases.append(F.when(here & names.contains("sys.miui.com") & (mac == "aa:80:a0:29:4e:0a"), "Xiaomi 13 Pro"))
        if other:
            cases.append(F.when(here, other))
    samsung = names.contains("samsung.com") | ua.contains("samsung")
    cases += [F.when(samsung & ua.contains("s24"), "Samsung Galaxy S24"), F.when(samsung & ua.contains("s23"), "Samsung Galaxy S23"), F.when(samsung, "Samsung Galaxy")]
    cases += [F.when(ua.contains("windows nt 10"), "Windows 10/11"), F.when(ua.contains("windows nt 6.3"), "Windows 8.1"), F.when(ua.contains("windows nt"), "Windows PC")]
    return F.coalesce(*cases, F.lit(""))


def behavior_score(first_seen: Column, total: Column, apps: Column, baseline: Column, flows: Column) -> Column:
    """0 (usual) to 100: new destinations, variety of applications and number of flows."""
    novelty = F.when(baseline > 0, first_seen / F.greatest(total, F.lit(1))).otherwise(1.0)
    diversity = F.when(apps > 0, F.log(apps.cast("double")) / F.log(F.lit(5.0))).otherwise(0.0)
    return F.when(total == 0, 0.0).otherwise(F.least(novelty * 50 + diversity * 25 + F.least(flows / 300, F.lit(1.0)) * 25, F.lit(100.0)))

"""Application layers of packets: which parser reads a payload is told by ports, and a flow keeps the last of each field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions import parsers
from flowlens.operators import reassembly

TCP, UDP = 6, 17
# Ports of the protocols.
HTTP_PORTS, CONNECT_PORTS, MYSQL_PORT, REDIS_PORT, DNS_PORT, QUIC_PORT = (80, 8080, 8000), (80, 8080), 3306, 6379, 53, 443

#: What `fields` adds: '' where a packet doesn't tell.
FIELDS = ("sni", "ja3", "tls_signature_hash", "ja3s", "tls_version", "dns_domain", "http_host", "http_method", "http_ua", "connect_host", "mysql_command", "redis_command")


def fields(packets: DataFrame) -> DataFrame:
    """packets (PACKETS) and FIELDS. A parser gets only payloads of its ports, the others are null to it."""
    tcp, udp = F.col("protocol") == TCP, F.col("protocol") == UDP
    either = lambda port: (F.col("src_port") == port) | (F.col("dst_port") == port)
    payload = lambda routed: F.when(routed, F.col("payload"))
    rows = packets.withColumn("_quic", payload(udp & either(QUIC_PORT)))
    rows = parsers.quic_names(rows, "_quic", "_quic_sni")
    rows = rows.withColumns({
        "_client": parsers.tls_client_hello(payload(tcp)), "_server": parsers.tls_server_hello(payload(tcp)), "_dns": parsers.dns_query(payload(either(DNS_PORT))),
        "_http": parsers.http_request(payload(tcp & F.col("dst_port").isin(*HTTP_PORTS))), "_connect": parsers.connect_host(payload(tcp & F.col("dst_port").isin(*CONNECT_PORTS))),
        "_mysql": parsers.mysql_command(payload(tcp & (F.col("dst_port") == MYSQL_PORT))), "_redis": parsers.redis_command(payload(tcp & either(REDIS_PORT))),
    })
    found = {
        "sni": F.coalesce("_client.sni", "_quic_sni"), "ja3": F.col("_client.ja3"), "tls_signature_hash": F.col("_client.signature"), "ja3s": F.col("_server.ja3s"), "tls_version": parsers.tls_label(F.col("_server.version")),
        "dns_domain": F.col("_dns"), "http_host": F.col("_http.host"), "http_method": F.col("_http.method"), "http_ua": F.col("_http.user_agent"), "connect_host": F.col("_connect"), "mysql_command": F.col("_mysql.command"), "redis_command": F.col("_redis.command"),
    }
    return rows.select(*packets.columns, *[F.coalesce(c, F.lit("")).alias(name) for name, c in found.items()])


#: What TLS hellos tell.
HELLO_FIELDS = ("sni", "ja3", "tls_signature_hash", "ja3s", "tls_version")


def hellos(packets: DataFrame) -> DataFrame:
    """seq and HELLO_FIELDS of hellos in several segments, by the packet that completes them; others are read by `fields`."""
    rows = reassembly.heads(packets).select("seq", parsers.tls_client_hello(F.col("head")).alias("_client"), parsers.tls_server_hello(F.col("head")).alias("_server"))
    found = {"sni": F.col("_client.sni"), "ja3": F.col("_client.ja3"), "tls_signature_hash": F.col("_client.signature"), "ja3s": F.col("_server.ja3s"), "tls_version": parsers.tls_label(F.col("_server.version"))}
    rows = rows.where("_client is not null or _server is not null")
    # one packet may complete several records
    return rows.select("seq", *[F.coalesce(c, F.lit("")).alias(name) for name, c in found.items()]).groupBy("seq").agg(*[F.max(name).alias(name) for name in found])


def told(rows: DataFrame, hellos: DataFrame, fields: tuple[str, ...] = HELLO_FIELDS) -> DataFrame:
    """rows (with seq and fields) and what hellos tell of their packets, where that isn't ''."""
    late = hellos.select(F.col("seq"), *[F.col(f).alias(f"_{f}") for f in fields])
    rows = rows.join(late, "seq", "left")
    return rows.withColumns({f: F.when(F.col(f"_{f}") != "", F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}).drop(*[f"_{f}" for f in fields])


def last_told(name: str, order: Column) -> Column:
    """An aggregate: the last value that isn't ''."""
    told = F.when(F.col(name) != "", order)
    return F.coalesce(F.max_by(F.col(name), told), F.lit("")).alias(name)


def merged(packets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, FIELDS of all of a key's packets, and src_mac, the first packet's; one pre-aggregated shuffle, no order."""
    order = F.struct("timestamp_ns", "seq")
    return packets.groupBy(*keys).agg(F.min_by("src_mac", order).alias("src_mac"), *[last_told(f, order) for f in FIELDS])

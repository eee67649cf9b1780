"""Wire messages, packets, segments and JSON records made from the events table, for tests and benchmarks.

Each is built from hex digits by column expressions and carries event_id. Of ten messages in a row some are damaged, so
that what a parser must refuse is there too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens import schema
from flowlens.functions import net, parsers
from flowlens.sources.projections import flows_from_events

# Fixed payloads by event number.
MYSQL_CODES = (3, 3, 3, 23, 22, 6, 14, 99)
MYSQL_TEXTS = ("SELECT 1", "drop table accounts", "select * into outfile 'x'", "", "SELECT a_rather_long_column_name_here, another FROM t", "db", "GRANT ALL ON x")
REDIS_TEXTS = ("AUTH secret\r\n", "GET key\r\n", "SELECT 5\r\n", "*3\r\n$3\r\nSET\r\n$1\r\na\r\n$1\r\nb\r\n", "*2\r\n$6\r\nCONFIG\r\n$3\r\nGET\r\n", "PING\r\n", "*x\r\n", "flushall\r\n", "*2\r\n$6\r\nSELECT\r\n$2\r\n12\r\n")
VENDOR_CLASSES = ("iPhone15", "Xiaomi phone", "HUAWEI P40", "MSFT 5.0", "")
QUIC_CONNECTION = bytes.fromhex("8394c8f03e515708")
#: Event times are packed this much closer, so that a user's packets are seconds apart.
PACE = 4000


def _n(value: Column | int, size: int) -> Column:
    """The digits of a number of size bytes, big-endian."""
    number = value if isinstance(value, Column) else F.lit(value)
    return F.lpad(F.hex(number.cast("long")), 2 * size, "0")


def _bytes_in(digits: Column) -> Column:
    return (F.length(digits) / 2).cast("int")


def _sized(digits: Column, size: int) -> Column:
    return F.concat(_n(_bytes_in(digits), size), digits)


def _cut(digits: Column, size: int) -> Column:
    return F.substring(digits, 1, 2 * size)


def _pick(values, i: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))


def numbered(events: DataFrame) -> DataFrame:
    """The flow projection with k, the number in the props, and nth, the event's last digit."""
    flows = flows_from_events(events, classified=False)
    return flows.withColumn("k", F.substring_index("dst_ip", ".", -1).cast("long")).withColumn("nth", F.col("event_id") % 10)


def dns(events: DataFrame) -> DataFrame:
    """Questions; 9: cut in the header, 8: no question, 7: a pointer after the first label."""
    rows = numbered(events)
    labels = F.split("dns_domain", r"\.")
    coded = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat(_n(F.length(x), 1), F.hex(x))), "")
    name = F.when(F.col("nth") == 7, F.concat(coded(F.slice(labels, 1, 1)), F.lit("C00C"))).otherwise(F.concat(coded(labels), F.lit("00")))
    count = F.when(F.col("nth") == 8, "0000").otherwise("0001")
    message = F.concat(F.lit("00010100"), count, F.lit("000000000000"), name, F.lit("00010001"))
    return rows.select("event_id", F.unhex(F.when(F.col("nth") == 9, _cut(message, 11)).otherwise(message)).alias("payload"))


def http(events: DataFrame) -> DataFrame:
    """Requests; 9: not UTF-8, 8: no method known, 7: CONNECT."""
    rows = numbered(events)
    host = F.when(F.col("sni") == "", "none.example").otherwise(F.col("sni"))
    method = F.when(F.col("nth") == 8, "FETCH").otherwise(_pick(("GET", "POST", "PUT"), F.col("k") % 3))
    k = F.col("k").cast("int")
    line = F.when(F.col("nth") == 7, F.concat(F.lit("CONNECT "), host, F.lit(":443"))).otherwise(F.concat(method, F.lit(" /p/"), F.repeat(F.lit("x"), k), F.lit("?q=1")))
    text = F.concat(line, F.lit(" HTTP/1.1\r\nhOsT: "), host, F.lit("\r\nUser-Agent: agent/"), F.repeat(F.lit("ab"), k), F.lit("\r\n\r\nHost: body"))
    return rows.select("event_id", F.unhex(F.concat(F.when(F.col("nth") == 9, "FF").otherwise(""), F.hex(text))).alias("payload"))


def _hello() -> Column:
    """Digits of a client hello's handshake message, with padding that parsers leave out."""
    k = F.col("k")
    name = F.hex("sni")
    entry = F.concat(F.lit("00"), _sized(name, 2))
    server = F.when(F.col("sni") == "", "").otherwise(F.concat(F.lit("0000"), _sized(_sized(entry, 2), 2)))
    groups = F.when(k % 2 == 0, "000A000600040017001D").otherwise("000A00040002001D")
    extensions = F.concat(server, groups, F.lit("000B00020100"), F.lit("00150008"), F.lit("00" * 8))
    ciphers = F.concat(_n(4865 + k % 3, 2), F.lit("C02F"))
    body = F.concat(F.lit("0303"), F.lit("00" * 32), F.lit("00"), _sized(ciphers, 2), F.lit("0100"), _sized(extensions, 2))
    return F.concat(F.lit("01"), _sized(body, 3))


def _record(handshake: Column) -> Column:
    return F.concat(F.lit("160301"), _sized(handshake, 2))


def client_hellos(events: DataFrame) -> DataFrame:
    """TLS records; 9: the last byte is missing."""
    return _last_cut(numbered(events).withColumn("d", _record(_hello())))


def _last_cut(rows: DataFrame) -> DataFrame:
    whole = F.col("d")
    return rows.select("event_id", F.unhex(F.when(F.col("nth") == 9, F.substring(whole, F.lit(1), F.length(whole) - 2)).otherwise(whole)).alias("payload"))


def server_hellos(events: DataFrame) -> DataFrame:
    """TLS records of 1.2 and older; 9: the last byte is missing."""
    rows = numbered(events)
    k = F.col("k")
    extensions = F.when(k % 2 == 0, "FF01000100").otherwise("FF0100010000170000")
    body = F.concat(F.when(k % 3 == 0, "0302").otherwise("0303"), F.lit("00" * 32), F.lit("00"), _n(4865 + k % 5, 2), F.lit("00"), _sized(extensions, 2))
    return _last_cut(rows.withColumn("d", _record(F.concat(F.lit("02"), _sized(body, 3)))))


def split_hellos(events: DataFrame) -> DataFrame:
    """PACKETS and event_id of client hellos in one to five segments, an address for each event (the same again after 2^24
    events); segments come out of order, in odd events they overlap by three bytes, in every fourth event the first is sent
    again; 9: the last byte is missing."""
    rows = numbered(events).withColumn("d", _record(_hello()))
    rows = rows.withColumn("d", F.when(F.col("nth") == 9, F.substring("d", F.lit(1), F.length("d") - 2)).otherwise(F.col("d"))).withColumn("n", _bytes_in(F.col("d")))
    event, parts = F.col("event_id"), (1 + F.col("k") % 5).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("j", F.explode(F.sequence(F.lit(0), parts - 1)))
    begin, end = F.expr("n * j div parts"), F.least(F.expr("n * (j + 1) div parts") + 3 * (event % 2), F.col("n"))
    turns = F.array((F.col("j") * 2 + event) % 5)
    turns = F.when((F.col("j") == 0) & (event % 4 == 0), F.array_append(turns, F.lit(7).cast("long"))).otherwise(turns)
    rows = rows.select("event_id", "first_seen", begin.alias("begin"), F.unhex(F.substring("d", (2 * begin + 1).cast("int"), (2 * (end - begin)).cast("int"))).alias("payload"), F.explode(turns).alias("turn"))
    client = F.unhex(F.concat(F.lit("0B"), *[_n(F.shiftright("event_id", 8 * i).bitwiseAND(255), 1) for i in (2, 1, 0)]))
    return rows.select(
        (event * 10 + F.col("turn")).alias("seq"), (F.col("first_seen") + F.col("turn") * 1_000_000).alias("timestamp_ns"), client.alias("src_ip"), F.unhex(F.lit("C6336401")).alias("dst_ip"), F.lit(1000).alias("src_port"), F.lit(443).alias("dst_port"),
        F.lit(6).cast("short").alias("protocol"), "payload", F.unhex(F.lit("AA80A0000001")).alias("src_mac"), F.lit(65535).alias("snaplen"), F.lit(0).cast("short").alias("tcp_flags"), (1_000_000 + event * 5000 + F.col("begin")).alias("tcp_seq"), "event_id",
    )


def mysql_greetings(events: DataFrame) -> DataFrame:
    """Greetings with a named plugin (even k) or none; 9: another protocol version."""
    rows = numbered(events)
    number = F.col("event_id")
    little = F.concat(*[_n(F.shiftright(number, 8 * i).bitwiseAND(255), 1) for i in range(4)])
    flags = F.when(F.col("k") % 2 == 0, "0800").otherwise("0000")
    version = F.hex(F.concat(F.lit("8.0."), F.col("k").cast("string"), F.lit("-log")))
    tail = F.concat(F.lit("15"), F.lit("00" * 23), F.hex(F.lit("caching_sha2_password")), F.lit("00"))
    digits = F.concat(F.when(F.col("nth") == 9, "09").otherwise("0A"), version, F.lit("00"), little, F.lit("00" * 9), F.lit("FFFF210200"), flags, tail)
    return rows.select("event_id", F.unhex(digits).alias("payload"))


def mysql_commands(events: DataFrame) -> DataFrame:
    """Commands; 9: empty."""
    rows = numbered(events)
    digits = F.concat(_n(_pick(MYSQL_CODES, F.col("k") % len(MYSQL_CODES)), 1), F.hex(_pick(MYSQL_TEXTS, F.col("event_id") % len(MYSQL_TEXTS))))
    return rows.select("event_id", F.unhex(F.when(F.col("nth") == 9, "").otherwise(digits)).alias("payload"))


def redis_commands(events: DataFrame) -> DataFrame:
    rows = numbered(events)
    return rows.select("event_id", _pick(REDIS_TEXTS, F.col("event_id") % len(REDIS_TEXTS)).cast("binary").alias("payload"))


def quic_initials(events: DataFrame) -> DataFrame:
    """Protected initial packets of version 1 with packet number 2; 9: the last byte is another, so the seal is broken."""
    rows = numbered(events)
    key, iv, hp = parsers.quic_keys(QUIC_CONNECTION)
    nonce = (int.from_bytes(iv, "big") ^ 2).to_bytes(12, "big")
    size = 1162  # frames, padded
    head = "C300000001" + f"{len(QUIC_CONNECTION):02X}" + QUIC_CONNECTION.hex() + "0000" + f"{0x4000 | (4 + size + 16):04X}"
    hello = _hello()
    frames = F.rpad(F.concat(F.lit("0600"), _n(_bytes_in(hello) + 0x4000, 2), hello), 2 * size, "0")
    sealed = F.aes_encrypt(F.unhex(frames), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(nonce), F.lit(bytes.fromhex(head + "00000002")))
    rows = rows.withColumn("sealed", F.substring(sealed, 13, 1 << 20))
    rows = rows.withColumn("mask", F.hex(F.aes_encrypt(F.substring("sealed", 1, 16), F.lit(hp), F.lit("ECB"))))
    digit = lambda at, n: F.conv(F.substring("mask", at, n), 16, 10).cast("long")
    first = _n(digit(1, 2).bitwiseAND(15).bitwiseXOR(F.lit(0xC3).cast("long")), 1)
    number = _n(digit(3, 8).bitwiseXOR(F.lit(2).cast("long")), 4)
    digits = F.concat(first, F.lit(head[2:]), number, F.hex("sealed"))
    last = F.when(F.substring(digits, -2, 2) == "00", "01").otherwise("00")
    broken = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 2), last)
    return rows.select("event_id", F.unhex(F.when(F.col("nth") == 9, broken).otherwise(digits)).alias("payload"))


def frames(events: DataFrame) -> DataFrame:
    """Ethernet frames with two bytes of trailing padding; 9: ARP, 8: IPv6."""
    rows = numbered(events)
    k, tcp = F.col("k"), F.col("protocol") == "TCP"
    data = F.hex(F.concat(F.lit("data "), k.cast("string")))
    ports = F.concat(_n(F.col("src_port"), 2), _n(F.col("dst_port"), 2))
    segment = F.concat(ports, _n(F.col("event_id") * 100, 4), F.lit("000000005018000000000000"), data)
    layer4 = F.when(tcp, segment).otherwise(F.concat(ports, _n(_bytes_in(data) + 8, 2), F.lit("0000"), data))
    kind = F.when(tcp, "06").otherwise("11")
    address = lambda c: F.hex(net.ip_bytes(F.col(c)))
    v4 = F.concat(F.lit("0800"), F.lit("4500"), _n(_bytes_in(layer4) + 20, 2), F.lit("0000000040"), kind, F.lit("0000"), address("src_ip"), address("dst_ip"), layer4)
    v6 = F.concat(F.lit("86DD"), F.lit("60000000"), _n(_bytes_in(layer4), 2), kind, F.lit("40"), F.lit("20010DB8" + "00" * 10), _n(k + 1, 2), F.lit("FE80" + "00" * 13 + "01"), layer4)
    rest = F.when(F.col("nth") == 8, v6).when(F.col("nth") == 9, F.concat(F.lit("0806"), F.lit("00" * 46))).otherwise(v4)
    return rows.select("event_id", F.unhex(F.concat(F.lit("00" * 6), F.regexp_replace("src_mac", ":", ""), rest, F.lit("0000"))).alias("frame"))


def packets(events: DataFrame, *more: str) -> DataFrame:
    """PACKETS between each user's client and one server; every third goes back, errors with k a multiple of 5 end. more:
    columns of the events that packets keep. Clients' addresses repeat after 62,500 users."""
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("long")
    back = F.col("event_id") % 3 == 0
    client = F.unhex(F.concat(F.lit("0A01"), _n((F.col("user_id") / 250).cast("long") % 250, 1), _n(F.col("user_id") % 250, 1)))
    server = F.unhex(F.lit("C6336401"))
    rows = events.select("event_id", "user_id", F.expr(f"unix_micros(cast(ts as timestamp)) * 1000 div {PACE}").alias("at"), k.alias("k"), "event_type", back.alias("back"), client.alias("client"), *[F.col(c).alias(f"_{c}") for c in more])
    one = lambda a, b: F.when(F.col("back"), a).otherwise(b)
    return rows.select(
        F.col("event_id").alias("seq"), F.col("at").alias("timestamp_ns"), one(server, F.col("client")).alias("src_ip"), one(F.col("client"), server).alias("dst_ip"),
        one(F.lit(443), F.lit(1000)).alias("src_port"), one(F.lit(1000), F.lit(443)).alias("dst_port"), F.lit(6).cast("short").alias("protocol"),
        F.repeat(F.lit("x"), (F.col("k") * 13).cast("int")).cast("binary").alias("payload"), F.unhex(F.lit("AA80A0000001")).alias("src_mac"), F.lit(65535).alias("snaplen"),
        F.when((F.col("event_type") == "error") & (F.col("k") % 5 == 0), 1).otherwise(0).cast("short").alias("tcp_flags"), F.lit(0).cast("long").alias("tcp_seq"), *[F.col(f"_{c}").alias(c) for c in more],
    )


def messages(events: DataFrame) -> DataFrame:
    """PACKETS whose payloads are messages of the protocol of their port: DNS, HTTP, MySQL, Redis, QUIC and TLS in turn."""
    rows = numbered(events).select("event_id", "first_seen", (F.col("event_id") % 7).cast("int").alias("turn"), F.split("src_ip", r"\.").alias("ip"), "src_mac")
    parts = [(dns, 53, 17), (http, 80, 6), (mysql_commands, 3306, 6), (redis_commands, 6379, 6), (quic_initials, 443, 17), (client_hellos, 8443, 6), (dns, 9999, 17)]
    out = None
    for turn, (make, port, protocol) in enumerate(parts):
        made = make(events.where(F.col("event_id") % 7 == turn)).select("event_id", "payload", F.lit(port).alias("dst_port"), F.lit(protocol).cast("short").alias("protocol"))
        out = made if out is None else out.unionByName(made)
    rows = rows.select("event_id", "first_seen", F.unhex(F.array_join(F.transform("ip", lambda x: _n(x.cast("long"), 1)), "")).alias("src_ip"), F.unhex(F.regexp_replace("src_mac", ":", "")).alias("src_mac"))
    return out.join(rows, "event_id").select(
        F.col("event_id").alias("seq"), F.col("first_seen").alias("timestamp_ns"), "src_ip", F.unhex(F.lit("C6336401")).alias("dst_ip"), F.lit(1000).alias("src_port"), "dst_port", "protocol", "payload", "src_mac", F.lit(65535).alias("snaplen"), F.lit(0).cast("short").alias("tcp_flags"), F.lit(0).cast("long").alias("tcp_seq"),
    )


def segments(events: DataFrame) -> DataFrame:
    """user_id, seq, tcp_seq, payload: each user's stream is its events' numbers; after the first, segments come in
    swapped pairs, and every fifth is sent twice."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    text = F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(";"))
    rows = events.select("user_id", "event_id", text.alias("text"), (F.row_number().over(order) - 1).alias("rn"), (1000 + F.coalesce(F.sum(F.length(text)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("tcp_seq"))
    swapped = F.when(F.col("rn") == 0, 0).otherwise((F.col("rn") - 1).bitwiseXOR(F.lit(1)) + 1)
    copies = F.when(F.col("event_id") % 5 == 0, F.array(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(0)))
    arrivals = F.transform(copies, lambda later: ((swapped + later) * 2 + later % 2).cast("long"))
    return rows.select("user_id", F.explode(arrivals).alias("seq"), F.col("tcp_seq").cast("long"), F.col("text").cast("binary").alias("payload"))


def json_records(events: DataFrame) -> DataFrame:
    """Records of the JSON source, through their JSON text, with event_id: flows, devices, requests, responses, others."""
    rows = numbered(events)
    kind = _pick(("flow_end", "device_info", "http_request", "http_response", "keepalive"), F.col("event_id") % 5)
    host = F.when(F.col("k") % 10 == 0, "mitmproxy.org").otherwise(F.col("sni"))
    record = F.struct(
        kind.alias("type"), (F.col("first_seen") / 1_000_000_000).cast("long").cast("double").alias("timestamp"), "first_seen", "last_seen", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", F.col("sni").alias("tls_sni"), "dns_domain", "src_mac",
        F.col("packets_up").alias("packets"), F.col("bytes_up").alias("bytes"), F.when(F.col("k") % 7 == 0, "").otherwise(F.col("src_ip")).alias("ip"), F.col("src_mac").alias("mac"), _pick(VENDOR_CLASSES, F.col("k") % 5).alias("vendor_class"),
        host.alias("host"), F.concat(F.lit("/"), F.repeat(F.lit("y"), (F.col("k") * 2).cast("int"))).alias("path"), _pick(("GET", "POST"), F.col("k") % 2).alias("method"), F.when(kind == "http_response", 200).alias("status_code"), F.col("k").alias("content_length"),
    )
    return rows.select("event_id", F.from_json(F.to_json(record), schema.UDP_JSON).alias("r")).select("event_id", "r.*")

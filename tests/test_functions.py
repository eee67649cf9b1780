"""Pure functions and column expressions on literal cases."""

import struct
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from flowlens.functions import classify, net, parsers
from flowlens.operators import reassembly, sessions
from flowlens.timerange import parse_since


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("15m", timedelta(minutes=15)), ("1h", timedelta(hours=1)), ("7d", timedelta(days=7)), ("0m", timedelta(0)), ("999999m", timedelta(minutes=525600)), ("", timedelta(hours=1)), ("invalid", timedelta(hours=1)), ("5M", timedelta(hours=1))])
def test_since(text, want):
    assert parse_since(text) == want


def test_addresses(spark):
    rows = spark.createDataFrame([(bytes([192, 168, 1, 2]), "192.168.1.2"), (bytes.fromhex("20010db8000000000000000000000001"), "2001:db8::1"), (b"abc", "0.0.0.0"), (bytes(16), "::"), (bytes.fromhex("20010db8000100010001000100010001"), "2001:db8:1:1:1:1:1:1")], "ip binary, want string")
    assert all(r.x == r.want for r in rows.select(net.ip_text(F.col("ip")).alias("x"), "want").collect())
    assert value(spark, net.ip_bytes(F.lit("10.0.0.1"))) == bytes([10, 0, 0, 1])
    assert value(spark, net.mac_text(F.lit(bytes.fromhex("AA80A0000001")))) == "aa:80:a0:00:00:01"
    for ip, want in (("172.16.0.1", True), ("172.32.0.1", False), ("10.1.1.1", True), ("fe80::1", False), ("8.8.8.8", False)):
        assert value(spark, net.is_private_wide(F.lit(ip))) is want


def test_flow_key_has_no_direction(spark):
    key = lambda *a: value(spark, F.to_json(net.flow_key(*[F.lit(x) for x in a])))
    assert key("192.168.1.2", 1000, "10.0.0.1", 443, 6) == key("10.0.0.1", 443, "192.168.1.2", 1000, 6)
    assert key("a", 1, "b", 2, 6) != key("a", 1, "b", 2, 17)


def test_sizes(spark):
    sizes = [0, 64, 65, 128, 129, 256, 257, 512, 513, 1024, 1025, 1500, 1501, 9000]
    rows = spark.createDataFrame([(s,) for s in sizes], "s int")
    assert [r.b for r in rows.select(net.size_bucket(F.col("s")).alias("b")).collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6]
    assert list(rows.agg(net.size_histogram(F.col("s")).alias("h")).first().h) == [2] * 7
    assert value(spark, net.merge_histograms(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)))) == [4, 6]
    assert [value(spark, net.human_bytes(F.lit(n))) for n in (7, 3100, 2_000_000, 1_500_000_000)] == ["7", "3.1K", "2.0M", "1.5G"]


@pytest.mark.parametrize(("sni", "dns", "port", "name", "confidence"), [("www.youtube.com", "", 443, "YouTube", 0.85), ("", "weixin.qq.com", 1, "微信", 0.85), ("evil-binance.com", "", 443, "HTTPS", 0.6), ("", "", 22, "SSH", 0.6), ("", "", 3306, "MySQL", 0.6), ("", "", 6379, "Redis", 0.6), ("a.b.c", "", 9999, "Unknown", 0.0), ("WWW.Bilibili.com", "", 1, "Bilibili", 0.85), ("y.qq.com", "", 1, "QQ", 0.85), ("", "", 785, "WireGuard", 0.6)])
def test_rules(spark, sni, dns, port, name, confidence):
    v = value(spark, classify.rules_engine(F.lit(sni), F.lit(dns), F.lit(port)))
    assert v.app_name == name and abs(v.confidence - confidence) < 1e-6


def test_other_engines(spark):
    flow = lambda *a: value(spark, classify.flow_engine(*[F.lit(x) for x in a]))
    assert flow(5000, 500_000, 50, 400, 120_000).app_name == "视频流"
    assert flow(200, 300, 2, 2, 10_000).app_name == "心跳"
    assert flow(100, 2_000_000, 2, 500, 8_000).app_name == "文件下载"
    assert flow(0, 0, 0, 0, 0).confidence == 0
    ja3 = lambda x: value(spark, classify.ja3_engine(F.lit(x)))
    assert ja3("6734f37431670b3aff").confidence > 0.9
    assert ja3("0" * 64).app_name == "Unknown" and ja3("").confidence == 0
    assert ja3("51c64c77e60f3970").app_name == "Chrome" and ja3("e7" + "0" * 20).app_name == "Chrome (推测)"


def test_votes(spark):
    v = lambda e, i, c, n="x": classify.verdict(e, i, n, "c", c)
    vote = lambda *vs: value(spark, classify.weighted_vote(F.array(*vs)))
    assert vote(v("rules", 1, 0.85), v("ja3", 2, 0.95)).app_id == 1
    assert vote(v("ja3", 5, 0.65), v("flow", 0, 0.80)).app_name == "Unknown"  # .455 against .40
    assert vote(v("ja3", 520, 0.30), v("flow", 0, 0.80, "心跳")).app_name == "心跳"
    # the upload verdict's .30 in 32 bits is not over .3, so it is never stored
    assert value(spark, classify.accepted(classify.weighted_vote(F.array(v("flow", 0, 0.60))))).confidence == 0


def test_devices(spark):
    for prefix, want in (("AA:80:A0:00:00:01", "Xiaomi"), ("f0:18:98:1", "Apple"), ("00:75:92:1", "Amazon"), ("00:15:99:1", "Samsung"), ("00:18:82:1", "Huawei"), ("00:00:00:00:00:00", "")):
        assert value(spark, classify.manufacturer(F.lit(""), F.lit(""), F.lit(prefix))) == want
    assert value(spark, classify.manufacturer(F.lit("x.apple.com"), F.lit(""), F.lit(""))) == "Apple"
    assert value(spark, classify.manufacturer(F.lit(""), F.lit("apple.com"), F.lit(""))) == ""
    names = lambda *x: F.array(*[F.lit(i) for i in x]).cast("array<string>")
    p = value(spark, classify.device_profile(names(), names(), F.lit("aa:80:a0:00:00:01")))
    assert (p.kind, p.os, round(p.confidence, 2)) == ("Xiaomi", "Android", 0.9)
    assert value(spark, classify.device_profile(names(), names("miui.com", "icloud.com"), F.lit(""))).kind == "Xiaomi"
    assert value(spark, classify.device_model(names(), F.lit(""), F.lit("Mozilla (Windows NT 10.0)"))) == "Windows 10/11"
    assert value(spark, classify.device_model(names("x.apple.com"), F.lit(""), F.lit("iPhone15,3"))) == "iPhone 14 Pro Max"
    assert value(spark, classify.vendor_of_device(F.lit("Xiaomi phone"), F.lit(""))) == "Xiaomi"


def test_behaviour_score(spark):
    score = lambda *a: value(spark, classify.behavior_score(*[F.lit(x) for x in a]))
    assert score(0, 0, 0, 0, 0) == 0
    assert score(1, 20, 5, 100, 10) < 50 < score(10, 10, 2, 10, 5)
    assert score(100, 100, 50, 10, 1000) <= 100


def dns_message(name):
    return struct.pack(">6H", 1, 0x100, 1, 0, 0, 0) + b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\0\0\1\0\1"


def client_hello(sni="example.com", ciphers=(0x1301, 0xC02F)):
    name = sni.encode()
    ext = struct.pack(">HHHBH", 0, len(name) + 5, len(name) + 3, 0, len(name)) + name + struct.pack(">HHHH", 10, 4, 2, 29) + struct.pack(">HHBB", 11, 2, 1, 0) + struct.pack(">HH", 21, 8) + bytes(8)
    body = struct.pack(">H", 0x0303) + bytes(32) + b"\0" + struct.pack(f">H{len(ciphers)}H", 2 * len(ciphers), *ciphers) + b"\1\0" + struct.pack(">H", len(ext)) + ext
    return b"\1" + len(body).to_bytes(3, "big") + body


def record(handshake):
    return b"\x16\3\1" + struct.pack(">H", len(handshake)) + handshake


def test_binary_parsers(spark):
    assert parsers.dns_name(dns_message("example.com")) == "example.com"
    assert parsers.dns_name(b"\0" * 11) is None and parsers.dns_name(b"\0" * 12) is None
    hello = parsers.parse_client_hello(record(client_hello()))
    assert (hello["sni"], hello["version"], hello["extensions"], hello["signature"], len(hello["ja3"])) == ("example.com", 0x0303, [0, 10, 11], "771-2-3-29", 64)
    assert parsers.parse_client_hello(record(client_hello())[:-1]) is None
    body = struct.pack(">H", 0x0303) + bytes(32) + b"\0" + struct.pack(">HBH", 0x1301, 0, 4) + struct.pack(">HH", 43, 0)
    server = parsers.parse_server_hello(record(b"\2" + len(body).to_bytes(3, "big") + body))
    assert (server["cipher"], server["version"]) == (0x1301, 0x0303)
    greeting = b"\x0a8.0.36-log\0" + struct.pack("<I", 7) + bytes(8) + b"\0" + struct.pack("<HBHHB", 0xFFFF, 33, 2, 0x0008, 21) + bytes(10) + bytes(13) + b"caching_sha2_password\0"
    assert parsers.parse_mysql_handshake(greeting) == {"server_version": "8.0.36", "connection_id": 7, "auth_plugin": "caching_sha2_password"}
    ip = bytes([0x45, 0]) + struct.pack(">H", 44) + bytes(5) + bytes([6]) + bytes(2) + bytes([1, 2, 3, 4, 5, 6, 7, 8])
    frame = bytes(6) + bytes.fromhex("aa80a0000001") + b"\x08\0" + ip + struct.pack(">HHIIBBHHH", 1000, 443, 99, 0, 0x50, 2, 0, 0, 0) + b"data"
    packet = parsers.parse_frame(frame)
    assert (packet["src_port"], packet["dst_port"], packet["tcp_seq"], packet["tcp_flags"], packet["payload"]) == (1000, 443, 99, 2, b"data")
    got = spark.createDataFrame([(bytearray(frame),), (bytearray(b"x"),), (None,)], "f binary").select(parsers.ethernet(F.col("f")).alias("p")).collect()
    assert bytes(got[0].p.src_ip) == bytes([1, 2, 3, 4]) and got[1].p is None and got[2].p is None


def test_text_parsers(spark):
    http = value(spark, parsers.http_request(F.lit(b"GET /a/b HTTP/1.1\r\nHost: example.com\r\nUser-Agent: x y\r\n\r\nbody")))
    assert (http.method, http.host, http.uri_stem, http.user_agent) == ("GET", "example.com", "/a/b", "x y")
    assert value(spark, parsers.http_request(F.lit(b"\xff\xfe\xfd\xfc\xfb\xfa\xf9\xf8"))) is None
    assert value(spark, parsers.connect_host(F.lit(b"CONNECT api.example.com:443 HTTP/1.1"))) == "api.example.com"
    command = value(spark, parsers.mysql_command(F.lit(b"\x03drop table t")))
    assert (command.command, command.summary, command.dangerous) == ("QUERY", "drop table t", True)
    redis = lambda b: value(spark, parsers.redis_command(F.lit(b)))
    assert redis(b"AUTH secret\r\n").has_auth and redis(b"SELECT 5\r\n").db_index == 5 and redis(b"PING\r\n").command == "PING"
    array = redis(b"*3\r\n$3\r\nSET\r\n$1\r\na\r\n$1\r\nb\r\n")
    assert (array.command, array.dangerous) == ("SET", False)
    assert redis(b"*2\r\n$6\r\nCONFIG\r\n$3\r\nGET\r\n").dangerous and redis(b"*2\r\n$6\r\nSELECT\r\n$1\r\n5\r\n").db_index == 5


def test_quic(spark):
    # the published example keys of the version 1 initial salt
    key, iv, hp = parsers.quic_keys(bytes.fromhex("8394c8f03e515708"))
    assert (key.hex(), iv.hex(), hp.hex()) == ("1f369613dd76d5467730efcbe3b1a22d", "fa044b2f42a3fd3b46fb255c", "9f50449e04a0e810283a1e9933adedd2")
    assert [parsers.varint(bytes.fromhex(x), 0)[0] for x in ("3f", "7fff", "80000005")] == [63, 16383, 5]
    connection, hello = bytes.fromhex("8394c8f03e515708"), client_hello("quic.example")
    frames = b"\x06\0" + struct.pack(">H", 0x4000 | len(hello)) + hello
    frames += bytes(1162 - len(frames))
    number = (2).to_bytes(4, "big")
    head = b"\xc3\0\0\0\1\x08" + connection + b"\0\0" + struct.pack(">H", 0x4000 | (4 + len(frames) + 16))
    nonce = (int.from_bytes(iv, "big") ^ 2).to_bytes(12, "big")
    sealed = spark.range(1).select(F.aes_encrypt(F.lit(frames), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(nonce), F.lit(head + number)).alias("x")).first().x[12:]
    sample = bytes(sealed[:16])
    mask = bytes(spark.range(1).select(F.aes_encrypt(F.lit(sample), F.lit(hp), F.lit("ECB")).alias("x")).first().x[:5])
    packet = bytes([head[0] ^ (mask[0] & 15)]) + head[1:] + bytes(a ^ b for a, b in zip(number, mask[1:], strict=True)) + bytes(sealed)
    rows = spark.createDataFrame([(1, bytearray(packet)), (2, bytearray(b"\x40abc")), (3, bytearray(packet[:-40] + bytes(40)))], "id int, payload binary")
    assert [r.quic_sni for r in parsers.quic_names(rows).orderBy("id").collect()] == ["quic.example", None, None]


def test_reassembly(spark):
    assert reassembly.joined([(1, b"abc"), (4, b"def")]) == b"abcdef"
    assert reassembly.joined([(1, b"abc"), (7, b"ghi"), (4, b"def")]) == b"abcdefghi"
    assert reassembly.joined([(1, b"abcd"), (3, b"cdef")]) == b"abcdef"
    assert reassembly.joined([(1, b"abc"), (9, b"x")]) == b"abc"
    assert reassembly.joined([(0, b"a"), (0, b"b")]) == b"ab"
    assert reassembly.joined([(1, b"abc"), (4, b"def")], most=4) == b"abcd"
    assert reassembly.joined([(1, b"a"), (4, b"d"), (3, b"c"), (2, b"b")], held=1) == b"ab"
    rows = spark.createDataFrame([("f", 1, 10, bytearray(b"he")), ("f", 3, 14, bytearray(b"o")), ("f", 2, 12, bytearray(b"ll"))], "k string, seq long, tcp_seq long, payload binary")
    assert bytes(reassembly.streams(rows, ["k"]).first().stream) == b"hello"


def test_split_sessions():
    assert sessions.split_sessions([0, 10, 20, 40, 50, 60, 65, 75, 80, 101], 15, 60) == [1, 1, 1, 2, 2, 2, 2, 2, 2, 3]

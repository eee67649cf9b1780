"""Protocol parsers. Text protocols are column expressions; binary ones are small Arrow-batched pandas UDFs.

Each returns null for what isn't a whole message of its protocol; no input raises an error.
"""

from __future__ import annotations

import hashlib
import hmac
import struct
from functools import cache, wraps

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.functions.lookup import let

# Fixed values of the protocols.
HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH", "CONNECT")
MYSQL_COMMANDS = {1: "QUIT", 2: "INIT_DB", 3: "QUERY", 4: "FIELD_LIST", 5: "CREATE_DB", 6: "DROP_DB", 7: "REFRESH", 8: "SHUTDOWN", 9: "STATISTICS", 14: "PING", 22: "STMT_PREPARE", 23: "STMT_EXECUTE", 24: "STMT_SEND_LONG_DATA", 25: "STMT_CLOSE", 26: "STMT_FETCH", 27: "STMT_RESET", 28: "SET_OPTION"}
REDIS_DANGEROUS = "FLUSHALL FLUSHDB CONFIG SLAVEOF REPLICAOF DEBUG SHUTDOWN BGREWRITEAOF BGSAVE MONITOR CLIENT SLOWLOG OBJECT EVAL EVALSHA SCRIPT MODULE ACL ROLE MIGRATE RESTORE SORT KEYS SCAN".split()
QUIC_SALT = bytes.fromhex("38762cf7f55934b34d179ae6a4c80cadccbb7f0a")


def text_of(payload: Column) -> Column:
    """The payload as UTF-8 text, null if it isn't."""
    return F.when(F.is_valid_utf8(payload.cast("string")), payload.cast("string"))


def http_request(payload: Column) -> Column:
    """method, host, uri_stem (64 characters), user_agent (128) of an HTTP/1 request."""
    text = text_of(payload)
    head = F.substring_index(F.array_join(F.slice(F.split(text, "\r\n", 10), 1, 9), "\r\n"), "\r\n\r\n", 1)
    line = F.substring_index(text, "\r\n", 1)
    method = F.regexp_extract(text, "^(" + "|".join(HTTP_METHODS) + ") ", 1)
    field = lambda name: F.trim(F.regexp_extract(head, rf"(?i)\r\n{name}:([^\r\n]*)", 1))
    uri = F.coalesce(F.get(F.split(line, " ", 3), F.lit(1)), F.lit("/"))
    meta = F.struct(method.alias("method"), field("host").alias("host"), F.substring(uri, 1, 64).alias("uri_stem"), F.substring(field("user-agent"), 1, 128).alias("user_agent"))
    return F.when((F.length(payload) >= 8) & (method != ""), meta)


def connect_host(payload: Column) -> Column:
    return F.nullif(F.regexp_extract(text_of(payload), r"^CONNECT ([^ :]+)", 1), F.lit(""))


def mysql_command(payload: Column) -> Column:
    """command, summary (40 characters), dangerous of a command packet without its 4-byte header."""
    code = F.conv(F.hex(F.substring(payload, 1, 1)), 16, 10).cast("int")
    names = F.create_map(*[F.lit(x) for pair in MYSQL_COMMANDS.items() for x in pair])
    summary = F.substring(F.coalesce(text_of(F.substring(payload, 2, 1 << 30)), F.lit("")), 1, 40)
    upper = F.upper(summary)
    dangerous = (code == 6) | upper.rlike(r"^(DROP |ALTER |TRUNCATE |GRANT |REVOKE |CREATE USER|KILL )|INTO OUTFILE|INTO DUMPFILE|LOAD_FILE") | ((code == 23) & (upper != ""))
    return F.when(F.length(payload) > 0, F.struct(F.coalesce(F.try_element_at(names, code), F.lit("UNKNOWN")).alias("command"), summary.alias("summary"), dangerous.alias("dangerous")))


def redis_command(payload: Column) -> Column:
    """command, has_auth, db_index, dangerous of an inline or array command."""
    text = text_of(payload)
    parts = F.filter(F.split(F.rtrim(text), r"\s+"), lambda x: x != "")
    array = F.regexp_extract_all(text, F.lit(r"\$\d+\r\n([^\r\n]*)(?=\r\n)"), F.lit(1))
    is_array = text.startswith("*")
    words = F.when(is_array, F.when(text.rlike(r"^\*\d+\r\n\$\d+\r\n"), array)).otherwise(parts)
    command = F.upper(F.get(words, F.lit(0)))
    db = F.when(command == "SELECT", F.get(words, F.lit(1)).try_cast("long"))
    return F.when(command.isNotNull(), F.struct(command.alias("command"), (command == "AUTH").alias("has_auth"), db.alias("db_index"), command.isin(REDIS_DANGEROUS).alias("dangerous")))


def tls_label(version: Column) -> Column:
    return F.when(version == 0x0304, "TLSv1.3").when(version == 0x0303, "TLSv1.2").when(version.isNotNull(), "TLSv1.1").otherwise("")


def _whole(parse):
    """Messages that end too early, or whose lengths don't fit, are None."""

    @wraps(parse)
    def safe(data):
        try:
            return None if data is None else parse(bytes(data))
        except (IndexError, ValueError, struct.error):
            return None

    return safe


def _frame(values: list, fields: list[str]) -> pd.DataFrame:
    return pd.DataFrame([v or dict.fromkeys(fields) for v in values], columns=fields)


@_whole
def dns_name(data: bytes) -> str | None:
    """The first question's name."""
    if len(data) < 12 or struct.unpack_from(">H", data, 4)[0] == 0:
        return None
    labels, at = [], 12
    while data[at] and data[at] & 0xC0 != 0xC0:
        size = data[at]
        if at + 1 + size > len(data):
            return None
        labels.append(data[at + 1 : at + 1 + size].decode())
        at += 1 + size
    return ".".join(labels) or None


def _u16s(data: bytes) -> list[int]:
    return [x for (x,) in struct.iter_unpack(">H", data)] if len(data) % 2 == 0 else []


def _joined(values) -> str:
    return "-".join(map(str, values))


def _hello(data: bytes, kind: int, least: int) -> bytes | None:
    """The body of the handshake message of a kind in one TLS record."""
    if len(data) < 6 or data[0] != 22:
        return None
    size = struct.unpack_from(">H", data, 3)[0]
    message = data[5 : 5 + size]
    if size < 4 or len(message) < size or message[0] != kind:
        return None
    length = int.from_bytes(message[1:4], "big")
    return message[4 : 4 + length] if least <= length <= len(message) - 4 else None


def client_hello(body: bytes) -> dict | None:
    """Fields of a client hello's body. ja3 is SHA-256 over numbers in semicolon-separated groups."""
    version, at = struct.unpack_from(">H", body)[0], 34
    at += 1 + body[at]
    size = struct.unpack_from(">H", body, at)[0]
    if at + 2 + size > len(body):
        return None
    ciphers = _u16s(body[at + 2 : at + 2 + size])
    at += 2 + size
    at += 1 + body[at]
    name, extensions, groups, points = "", [], [], []
    if at + 2 <= len(body):
        end = at + 2 + struct.unpack_from(">H", body, at)[0]
        if end > len(body):
            return None
        at += 2
        while at + 4 <= end:
            kind, size = struct.unpack_from(">HH", body, at)
            value, at = body[at + 4 : at + 4 + size], at + 4 + size
            if kind == 21:  # padding
                continue
            extensions.append(kind)
            if kind == 0 and size > 5:
                name = value[5 : 5 + struct.unpack_from(">H", value, 3)[0]].decode(errors="replace")
            elif kind == 10 and size >= 2:
                groups = _u16s(value[2 : 2 + struct.unpack_from(">H", value)[0]])
            elif kind == 11 and size >= 1:
                points = list(value[1 : 1 + value[0]])
    text = f"{version},{_joined(ciphers)};{_joined(extensions)};{_joined(groups)};{_joined(points)}"
    signature = _joined((version, min(len(ciphers), 99), min(len(extensions), 99), groups[0] if groups else 0))
    return {"sni": name, "ja3": hashlib.sha256(text.encode()).hexdigest(), "version": version, "ciphers": ciphers, "extensions": extensions, "signature": signature}


@_whole
def parse_client_hello(data: bytes) -> dict | None:
    body = _hello(data, 1, 34)
    return body and client_hello(body)


@_whole
def parse_server_hello(data: bytes) -> dict | None:
    body = _hello(data, 2, 38)
    if not body:
        return None
    version, at = struct.unpack_from(">H", body)[0], 34
    at += 1 + body[at]
    cipher, at = struct.unpack_from(">H", body, at)[0], at + 3
    extensions = []
    if at + 2 <= len(body):
        end = min(len(body), at + 2 + struct.unpack_from(">H", body, at)[0])
        at += 2
        while at + 4 <= end:
            kind, size = struct.unpack_from(">HH", body, at)
            extensions.append(kind)
            at += 4 + size
    return {"ja3s": hashlib.sha256(f"{version},{cipher};{_joined(extensions)}".encode()).hexdigest(), "cipher": cipher, "version": version}


@_whole
def parse_mysql_handshake(data: bytes) -> dict | None:
    """Of a server greeting without its 4-byte header."""
    if len(data) < 4 or data[0] not in (10, 11):
        return None
    end = data.index(0, 1)
    version, at = data[1:end].decode(), end + 1
    connection = struct.unpack_from("<I", data, at)[0]
    at += 13  # connection id, 8 bytes of the challenge, a filler
    low = struct.unpack_from("<H", data, at)[0]
    flags, plugin = low, "mysql_native_password"
    if at + 7 <= len(data):
        flags |= struct.unpack_from("<H", data, at + 5)[0] << 16
    if flags & 0x80000:
        begin = at + 8 + 10 + max(13, data[at + 7] - 8)
        plugin = data[begin:].split(b"\0")[0].decode() or plugin
    return {"server_version": version.partition("-")[0], "connection_id": connection, "auth_plugin": plugin}


@_whole
def parse_frame(data: bytes) -> dict | None:
    """An Ethernet frame with TCP or UDP over IPv4 or IPv6, without VLAN tags or extension headers."""
    kind, at = struct.unpack_from(">H", data, 12)[0], 14
    if kind == 0x0800 and data[14] >> 4 == 4:
        protocol, src, dst = data[23], data[26:30], data[30:34]
        end, at = 14 + struct.unpack_from(">H", data, 16)[0], 14 + 4 * (data[14] & 15)
    elif kind == 0x86DD and data[14] >> 4 == 6:
        protocol, src, dst = data[20], data[22:38], data[38:54]
        end, at = 54 + struct.unpack_from(">H", data, 18)[0], 54
    else:
        return None
    ports = struct.unpack_from(">HH", data, at)
    flags, seq = 0, 0
    if protocol == 6:
        seq, flags = struct.unpack_from(">I", data, at + 4)[0], data[at + 13]
        at += 4 * (data[at + 12] >> 4)
    elif protocol == 17:
        at += 8
    else:
        return None
    return {"src_ip": src, "dst_ip": dst, "src_port": ports[0], "dst_port": ports[1], "protocol": protocol, "payload": data[at : min(end, len(data))], "src_mac": data[6:12], "tcp_flags": flags, "tcp_seq": seq}


# QUIC: the key schedule is Python, AES is SQL's.
def _expand(secret: bytes, label: str, size: int) -> bytes:
    name = b"tls13 " + label.encode()
    info = struct.pack(">HB", size, len(name)) + name + b"\0"
    return hmac.new(secret, info + b"\1", hashlib.sha256).digest()[:size]


def quic_keys(connection_id: bytes) -> tuple[bytes, bytes, bytes]:
    """key, iv and header protection key of a client's initial packets."""
    secret = _expand(hmac.new(QUIC_SALT, connection_id, hashlib.sha256).digest(), "client in", 32)
    return _expand(secret, "quic key", 16), _expand(secret, "quic iv", 12), _expand(secret, "quic hp", 16)


def varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, offset after it)."""
    size = 1 << (data[at] >> 6)
    if at + size > len(data):
        raise IndexError
    return int.from_bytes(data[at : at + size], "big") & ((1 << (8 * size - 2)) - 1), at + size


@_whole
def quic_header(data: bytes) -> dict | None:
    """Of a version 1 initial packet: where the packet number is, its end, the sample and the keys."""
    if data[0] & 0xF0 != 0xC0 or data[1:5] != b"\0\0\0\1":
        return None
    size = data[5]
    connection, at = data[6 : 6 + size], 6 + size
    at += 1 + data[at]
    token, at = varint(data, at)
    length, at = varint(data, at + token)
    if at + length > len(data) or length < 20:
        return None
    key, iv, hp = quic_keys(connection)
    return {"at": at, "end": at + length, "sample": data[at + 4 : at + 20], "key": key, "iv": iv, "hp": hp}


@_whole
def quic_sni(frames: bytes) -> str | None:
    """The name in a client hello whose bytes are in the packet's CRYPTO frames."""
    parts: dict[int, bytes] = {}
    at = 0
    while at < len(frames):
        kind = frames[at]
        if kind in (0, 1):  # padding, ping
            at += 1
        elif kind == 6:
            offset, at = varint(frames, at + 1)
            size, at = varint(frames, at)
            parts[offset], at = frames[at : at + size], at + size
        else:
            break
    message = b""
    for offset in sorted(parts):
        if offset > len(message):
            break
        message = message[:offset] + parts[offset]
    if len(message) < 4 or message[0] != 1:
        return None
    hello = client_hello(message[4 : 4 + int.from_bytes(message[1:4], "big")])
    return hello and hello["sni"]


def _text_udf(parse):
    """A column function; made when it is first used, as that takes a session."""

    @cache
    def udf():
        return F.pandas_udf(lambda s: s.map(parse), "string")

    return lambda payload: udf()(payload)


def _struct_udf(parse, fields: str):
    """Like _text_udf, for structs: null where there is no message."""
    names = [x.strip().split(" ")[0] for x in fields.split(", ")]

    @cache
    def udf():
        return F.pandas_udf(lambda s: _frame([parse(x) for x in s], names), fields)

    return lambda payload: let(udf()(payload), lambda s: F.when(s[names[0]].isNotNull(), s))


dns_query = _text_udf(dns_name)
tls_client_hello = _struct_udf(parse_client_hello, "sni string, ja3 string, version int, ciphers array<int>, extensions array<int>, signature string")
tls_server_hello = _struct_udf(parse_server_hello, "ja3s string, cipher int, version int")
mysql_handshake = _struct_udf(parse_mysql_handshake, "server_version string, connection_id long, auth_plugin string")
ethernet = _struct_udf(parse_frame, "src_ip binary, dst_ip binary, src_port int, dst_port int, protocol short, payload binary, src_mac binary, tcp_flags short, tcp_seq long")
_quic_header = _struct_udf(quic_header, "at int, end int, sample binary, key binary, iv binary, hp binary")
_quic_sni = _text_udf(quic_sni)


def _digits(number: Column, size: int | Column) -> Column:
    """The digits of a number of size bytes."""
    return F.lpad(F.hex(number), 2 * (F.lit(size) if isinstance(size, int) else size), F.lit("0"))


def _part(data: Column, at: int | Column, size: int | Column) -> Column:
    return F.hex(F.substring(data, F.lit(at) if isinstance(at, int) else at, F.lit(size) if isinstance(size, int) else size))


def _unprotected(rows, payload: str):
    """rows with _aad and _sealed (nonce before ciphertext): takes header protection off by _h and _mask."""
    data, mask, at, number = F.col(payload), F.col("_mask"), F.col("_h.at"), lambda digits: F.conv(digits, 16, 10).cast("long")
    rows = rows.withColumn("_first", number(_part(data, 1, 1)).bitwiseXOR(number(_part(mask, 1, 1)).bitwiseAND(15)))
    rows = rows.withColumn("_size", (F.col("_first").bitwiseAND(3) + 1).cast("int"))
    rows = rows.withColumn("_number", number(_part(data, at + 1, F.col("_size"))).bitwiseXOR(number(_part(mask, 2, F.col("_size")))))
    aad = F.concat(_digits(F.col("_first"), 1), _part(data, 2, at - 1), _digits(F.col("_number"), F.col("_size")))
    nonce = F.concat(_part(F.col("_h.iv"), 1, 8), _digits(number(_part(F.col("_h.iv"), 9, 4)).bitwiseXOR(F.col("_number")), 4))
    sealed = F.concat(F.unhex(nonce), F.substring(data, at + F.col("_size") + 1, F.col("_h.end") - at - F.col("_size")))
    return rows.withColumns({"_aad": F.unhex(aad), "_sealed": sealed}).drop("_first", "_size", "_number", "_mask")


def quic_names(packets, payload: str = "payload", name: str = "quic_sni"):
    """packets with the name of each QUIC initial packet's client hello, else null.

    Python gets a packet's bytes twice, for its keys and for its frames; batches are bounded (`bounded_batches`)."""
    bounded_batches(packets.sparkSession)
    rows = packets.withColumn("_h", _quic_header(F.col(payload)))
    rows = rows.withColumn("_mask", F.expr("substring(aes_encrypt(_h.sample, _h.hp, 'ECB'), 1, 16)"))
    opened = F.expr("try_aes_decrypt(_sealed, _h.key, 'GCM', 'DEFAULT', _aad)")
    return _unprotected(rows, payload).withColumn(name, _quic_sni(opened)).drop("_h", "_aad", "_sealed")


#: Rows and bytes of an Arrow batch of packets.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark) -> None:
    """Bounds what a Python worker holds of packets at once; a session's own smaller bounds stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("bB")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))

"""TCP streams from segments, for each flow and direction, and the heads of TLS records that lie in several segments."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a parser of a stream's head asks for: bytes of the stream, segments that wait for a gap to close.
HEAD_BYTES, HEAD_HELD = 32_778, 64
# Bytes of a TLS record at most, of its header; the kind of record that holds hellos.
RECORD_BYTES, RECORD_HEADER, HANDSHAKE = 16_389, 5, 0x16
#: Seconds within which the segments of a record come.
RECORD_S = 60
#: Sequence numbers of one bucket of the search for a record's segments.
_BUCKET = 1 << 14

DIRECTION = ["src_ip", "src_port", "dst_ip", "dst_port"]


def joined(segments, most: int | None = None, held: int | None = None) -> bytes:
    """Bytes in sequence order. segments: (seq, data) as they came; seq 0 appends. Overlaps are cut. The first segment
    that comes begins the stream; what lies before it is not part of it. With `held`, only so many segments wait for a
    gap to close (the furthest goes); with `most`, the stream ends there."""
    out, base, waiting, places = bytearray(), None, {}, []
    for seq, data in segments:
        if seq == 0:
            out += data
        elif base is None:
            base = seq
            out += data
        else:
            if seq not in waiting:
                waiting[seq] = data
                heapq.heappush(places, seq)
            if held is not None and len(waiting) > held:
                furthest = max(places)
                places.remove(furthest)
                heapq.heapify(places)
                del waiting[furthest]
        while base is not None and places:
            gap = places[0] - base - len(out)
            if gap > 0:
                break
            out += waiting.pop(heapq.heappop(places))[-gap:]  # without overlap, -0 keeps all
        if most is not None and len(out) >= most:
            break
    return bytes(out[:most])


def streams(packets: DataFrame, keys: list[str], order: str = "seq", most: int | None = None, held: int | None = None) -> DataFrame:
    """keys and stream (binary); packets: keys, order of arrival, tcp_seq, payload. most, held: see `joined`; HEAD_BYTES
    and HEAD_HELD give a stream's head."""
    fields = [f for f in packets.schema.fields if f.name in keys]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        row = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame(row | {"stream": [joined(zip(pdf["tcp_seq"], pdf["payload"], strict=True), most, held)]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", stream binary"
    return packets.select(*keys, order, "tcp_seq", "payload").groupBy(*keys).applyInPandas(build, schema)


def _number(data: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(data, at, size)), 16, 10).cast("long")


def heads(packets: DataFrame) -> DataFrame:
    """seq, head: the whole bytes of each handshake record that begins in a TCP segment (PACKETS) which doesn't hold all of
    it, by the packet (its seq) with which the record was complete.

    A segment that begins like such a record is an anchor: it tells where the record begins and, with its header, where
    it ends. Only segments of the same direction within that range, RECORD_S before or after, are looked at; the join is
    by direction and bucket of sequence numbers, so a busy direction is many keys. Of segments at one place the longest
    counts, the first of equal ones: an anchor has RECORD_BYTES segments at most, whatever is sent again. A running maximum
    of the ends in order of place tells what of a segment is new and whether a gap lies before it; with a gap before its
    end a record isn't complete and gives no row. Records without sequence numbers (0) are not searched for.
    """
    size = F.length("payload").cast("long")
    segments = packets.where((F.col("protocol") == 6) & (F.col("tcp_seq") != 0) & (size > 0))
    segments = segments.select(*DIRECTION, "timestamp_ns", "seq", "tcp_seq", "payload", size.alias("size"))
    known = F.when(F.col("size") >= RECORD_HEADER, RECORD_HEADER + _number(F.col("payload"), 4, 2)).otherwise(F.lit(RECORD_BYTES).cast("long"))
    begins = (_number(F.col("payload"), 1, 1) == HANDSHAKE) & ((F.col("size") < 2) | (_number(F.col("payload"), 2, 1) == 3))
    anchors = segments.where(begins).select(*DIRECTION, F.col("seq").alias("anchor"), F.col("timestamp_ns").alias("anchor_ns"), F.col("tcp_seq").alias("base"), F.least(known, F.lit(RECORD_BYTES)).alias("need"), "size")
    bucket = lambda c: F.floor(c / _BUCKET).cast("long")
    anchors = anchors.where(F.col("size") < F.col("need")).drop("size").withColumn("bucket", F.explode(F.sequence(bucket(F.col("base")), bucket(F.col("base") + F.col("need") - 1))))
    found = segments.withColumn("bucket", bucket(F.col("tcp_seq"))).join(anchors, [*DIRECTION, "bucket"])
    found = found.where((F.col("tcp_seq") >= F.col("base")) & (F.col("tcp_seq") < F.col("base") + F.col("need")) & (F.abs(F.col("timestamp_ns") - F.col("anchor_ns")) <= RECORD_S * 10**9))
    came = F.struct("timestamp_ns", "seq")
    best = F.min_by(F.struct("payload", "size", came.alias("came")), F.struct((-F.col("size")).alias("minus"), "timestamp_ns", "seq"))
    places = found.groupBy("anchor", "base", "need", "tcp_seq").agg(best.alias("s")).select("anchor", "base", "need", (F.col("tcp_seq") - F.col("base")).alias("at"), "s.*")
    before = Window.partitionBy("anchor").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    places = places.withColumn("reach", F.coalesce(F.max(F.col("at") + F.col("size")).over(before), F.lit(0)))
    gap = F.max(F.col("at") > F.col("reach")).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    new = F.expr("hex(substring(payload, cast(reach - at + 1 as int)))")
    pieces = places.where("at + size > reach").select("anchor", "need", "at", "came", new.alias("digits"), "reach", gap.alias("gap"))
    whole = pieces.where(~F.col("gap")).groupBy("anchor", "need").agg(F.array_sort(F.collect_list(F.struct("at", "digits", "came", "reach"))).alias("parts"))
    head = F.unhex(F.array_join(F.transform("parts", lambda p: p["digits"]), ""))
    whole = whole.select("parts", head.alias("head")).where(F.length("head") >= RECORD_HEADER)
    end = RECORD_HEADER + _number(F.col("head"), 4, 2)
    whole = whole.withColumn("end", end).where(F.length("head") >= F.col("end"))
    last = F.array_max(F.transform(F.filter("parts", lambda p: p["reach"] < F.col("end")), lambda p: p["came"]))
    # a beginning that was sent again is an anchor of the same record
    return whole.select(last["seq"].alias("seq"), F.substring(F.col("head"), F.lit(1), F.col("end").cast("int")).alias("head")).distinct()


def begins_record(data: bytes) -> bool:
    """Whether data begins like a handshake record, as far as it goes."""
    return data[:1] == bytes([HANDSHAKE]) and data[1:2] in (b"", b"\3")


def record_head(segments: dict[int, bytes], base: int) -> tuple[bytes, int] | None:
    """The whole record that begins at base and the place of the last segment that it needs, from segments by place."""
    out, last = b"", base
    for place in sorted(x for x in segments if base <= x < base + RECORD_BYTES):
        if place > base + len(out):
            break
        if place + len(segments[place]) > base + len(out):
            out += segments[place][base + len(out) - place :]
        end = RECORD_HEADER + int.from_bytes(out[3:5], "big") if len(out) >= RECORD_HEADER else RECORD_BYTES
        if len(out) >= end:
            return out[:end], last
    return None

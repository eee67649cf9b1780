"""Sessions, gaps and packet flows in batch.

No window spans a key's whole history, as one key may hold a large share of all rows: see `chunks`. Chunks are CHUNK times
as long as what is asked of their neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions import net
from flowlens.operators import layers
from flowlens.operators.chunks import chunked, in_groups, numbers, with_latest, with_previous, with_running
from flowlens.sources.shared import kept

IDLE_S, LIFETIME_S, GAP_NS, HEADER_BYTES = 15, 60, 10_000_000_000, 74
FIN, RST = 1, 4
CHUNK = 64


def interarrival(rows: DataFrame, keys: list[str], at: str, tie: str, longest: int = GAP_NS, chunk: int | None = None) -> DataFrame:
    """Mean gap in microseconds (at: nanoseconds) of each key and how many gaps count; longer ones are left out."""
    rows = with_previous(chunked(rows.select(*keys, at, tie), at, chunk or CHUNK * longest), keys, at, tie)
    counts = F.when(F.col(at) - F.col("_previous") < longest, F.col(at) - F.col("_previous"))
    return rows.groupBy(*keys).agg(F.coalesce(F.avg(counts) / 1000, F.lit(0.0)).alias("iat_mean_us"), F.count(counts).alias("gaps"))


def idle_sessions(rows: DataFrame, keys: list[str], at: str, tie: str, idle_s: int = IDLE_S, chunk: int | None = None) -> DataFrame:
    """Sessions (numbered from 1) that end with a gap of more than idle_s seconds: gaps and a running sum."""
    idle = idle_s * 1_000_000
    rows = rows.select(*keys, at, tie, F.unix_micros(F.col(at).cast("timestamp")).alias("_at"))
    rows = with_previous(chunked(rows, "_at", chunk or CHUNK * idle), keys, "_at", tie)
    new = F.when(F.col("_previous").isNull() | (F.col("_at") - F.col("_previous") > idle), 1).otherwise(0)
    rows = with_running(rows, keys, "_at", tie, new, "session")
    return rows.groupBy(*keys, "session").agg(F.min(at).alias("first_ts"), F.max(at).alias("last_ts"), F.count("*").alias("rows"))


def split_sessions(times, idle, lifetime) -> list[int]:
    """Session numbers of ordered times: a new one after a gap over idle, or once a session is older than lifetime."""
    out, number, first, last = [], 0, None, None
    for t in times:
        if last is None or t - last > idle or t - first > lifetime:
            number, first = number + 1, t
        out.append(number)
        last = t
    return out


def _successors(times: np.ndarray, breaks: np.ndarray, group: np.ndarray, lifetime: int) -> np.ndarray:
    """Of each time, were it the first of a session, the index of the next session's first time in its group; len(times): none
    is known. group: the number of each time's group, from 0; times are in order within their group."""
    n = len(times)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    end = np.append(first[1:], n)
    since = times - times[first][group]
    span = int(since.max()) + lifetime + 1
    # groups are laid one behind the other on one line, as many at once as it has room for
    late = np.empty(n, np.int64)
    most = max(1, (1 << 62) // span)
    for g in range(0, len(first), most):
        at = slice(first[g], end[min(g + most, len(first)) - 1])
        line = (group[at] - g) * span + since[at]
        late[at] = at.start + np.searchsorted(line, line + lifetime, "right")
    at = np.where(breaks, np.arange(n), n)
    next_break = np.append(np.minimum.accumulate(at[::-1])[::-1], n)[1:]
    after = np.minimum(late, next_break)
    return np.where(after < end[group], after, n)


def session_starts(rows: DataFrame, keys: list[str], at: str, idle: int, lifetime: int, chunk: int | None = None) -> DataFrame:
    """keys, _chunk, at: the first times of sessions that end with a gap over idle, or once they are older than lifetime.

    Where a session begins depends on where the last one began, back to the last gap over idle. So that a busy key isn't taken
    in order as a whole, its times are cut into chunks. A chunk tells where a chain of sessions leaves it that begins after a
    gap in it, and, for each of its first times, where one leaves that enters there: the next chunk's times that can follow are
    few. Which of these entries are met is found by pointer doubling: the entries' jumps are joined with themselves, so a run
    without a gap over 2^k chunks takes k rounds. Then each chunk follows the chains from its gaps and from the entry met.
    Python takes many chunks at once (`in_groups`), as keys with few rows are many.
    """
    chunk = chunk or CHUNK * max(idle, lifetime)
    if chunk < idle + lifetime:
        raise ValueError("a chunk must be as long as idle and lifetime together")
    times = with_previous(chunked(rows.select(*keys, at).distinct(), at, chunk), keys, at, at)
    times = kept(times.withColumn("_break", F.col("_previous").isNull() | (F.col(at) - F.col("_previous") > idle)).drop("_previous"), "times")
    # a chunk also sees the times that may follow its last session
    near = F.col(at) - F.col("_chunk") * chunk < idle + lifetime
    seen = times.withColumn("_in", F.explode(F.when(near, F.array("_chunk", F.col("_chunk") - 1)).otherwise(F.array("_chunk"))))
    key_ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in times.schema.fields if f.name in keys)
    names = [f.name for f in times.schema.fields if f.name in keys]

    def leave(table: pa.Table, group: np.ndarray) -> pa.Table:
        t, breaks = numbers(table, at), numbers(table, "_break")
        n, own = len(t), numbers(table, "_chunk") == numbers(table, "_in")
        after = _successors(t, breaks, group, lifetime).tolist()
        # where a chain leaves: the index of the first start beyond the chunk
        leaves = list(range(n + 1))
        for i in np.flatnonzero(own)[::-1].tolist():
            leaves[i] = leaves[after[i]]
        # a gap cuts what came before it: the last one's chain is the one that leaves, and without a gap those that enter
        gaps = np.flatnonzero(own & breaks)
        last = np.full(int(group[-1]) + 1, -1)
        np.maximum.at(last, group[gaps], gaps)
        enters = np.flatnonzero(own & (last[group] < 0) & (t % chunk < idle + lifetime))
        begins = np.concatenate([last[last >= 0], enters])
        ends = np.array(leaves)[begins]
        # a start with a gap before it is its own chunk's
        keep = np.flatnonzero(~np.append(breaks, True)[ends])
        begins, ends = begins[keep], ends[keep]
        return table.select(names).take(begins).append_column("entry", pa.array(t[begins], mask=breaks[begins])).append_column("to", pa.array(t[ends]))

    jumps = kept(in_groups(seen, [*keys, "_in"], at, leave, key_ddl + "entry long, to long"), "jumps")
    met = kept(jumps.where("entry is null").select(*keys, F.col("to").alias("entry")), "entries")
    jumps = jumps.where("entry is not null")
    alike = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    while not jumps.isEmpty() and not met.isEmpty():
        further = met.alias("m").join(jumps.alias("j"), [*alike(met, jumps), met["entry"] == jumps["entry"]]).select(*[met[k] for k in keys], jumps["to"].alias("entry"))
        other = jumps.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("entry").alias("_entry"), F.col("to").alias("_to"))
        twice = jumps.join(other, [*[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("to") == F.col("_entry")]).select(*keys, "entry", F.col("_to").alias("to"))
        met, jumps = kept(met.unionByName(further).distinct(), "entries"), kept(twice, "jumps")

    def follow(table: pa.Table, group: np.ndarray) -> pa.Table:
        # an entry that is met is also one of the times
        t = numbers(table, at)
        first = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(t, prepend=t[0]) != 0))
        roots = np.maximum.reduceat(numbers(table, "_root"), first)
        breaks = np.maximum.reduceat(numbers(table, "_break"), first)
        after = _successors(t[first], breaks, group[first], lifetime).tolist()
        starts = [*roots.tolist(), False]
        for i, begins in enumerate(starts):
            if begins:
                starts[after[i] if i < len(after) else i] = True
        return table.select([*names, "_chunk", at]).take(first[np.array(starts[:-1])])

    entered = chunked(met.withColumnRenamed("entry", at), at, chunk).distinct()
    marked = times.withColumn("_root", F.col("_break")).unionByName(entered.withColumns({"_break": F.lit(False), "_root": F.lit(True)}))
    return in_groups(marked, [*keys, "_chunk"], at, follow, key_ddl + f"_chunk long, `{at}` long")


def with_sessions(rows: DataFrame, keys: list[str], at: str, idle: int, lifetime: int, chunk: int | None = None) -> DataFrame:
    """rows and _start, the first time of their session; rows of one session are those of one start."""
    chunk = chunk or CHUNK * max(idle, lifetime)
    starts = session_starts(rows, keys, at, idle, lifetime, chunk)
    return with_latest(chunked(rows, at, chunk), starts, keys, at, "_start").drop("_chunk")


def capped_sessions(rows: DataFrame, keys: list[str], at: str, idle: int, lifetime: int, chunk: int | None = None) -> DataFrame:
    rows = with_sessions(rows, keys, at, idle, lifetime, chunk)
    return rows.groupBy(*keys, "_start").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("rows")).drop("_start")


def flows_from_packets(packets: DataFrame, fields: tuple[str, ...] = (), hellos: DataFrame | None = None, within: tuple[str, ...] = (), numbered: bool = False) -> DataFrame:
    """Flow rows of packets (PACKETS): sessions of each undirected five-tuple, closed by idleness, age, FIN or RST.

    Up is the direction of the session's first packet. fields: text columns of packets (as `layers.fields` adds them), of
    which a flow has the last that isn't ''. hellos: what `layers.hellos` finds in several segments of the packets. within:
    columns of packets that tell networks apart in which the same addresses are others; flows have them too. numbered: flows
    have their number, from 1, in their five-tuple. Sums, histograms and gaps are built-in aggregates; only the
    times and flags of a key are taken in order in Python, payloads never are.
    """
    ips = packets.withColumn("src", net.ip_text(F.col("src_ip"))).withColumn("dst", net.ip_text(F.col("dst_ip")))
    rows = ips.select(
        "seq", "timestamp_ns", "src", "dst", "src_port", "dst_port", "protocol", net.mac_text(F.col("src_mac")).alias("mac"),
        (F.length("payload") + HEADER_BYTES).cast("long").alias("size"), F.coalesce(F.col("tcp_flags").bitwiseAND(FIN | RST) > 0, F.lit(False)).alias("ends"),
        F.to_json(net.flow_key(F.col("src"), F.col("src_port"), F.col("dst"), F.col("dst_port"), F.col("protocol"))).alias("key"), *fields, *within,
    )
    if hellos is not None:
        rows = layers.told(rows, hellos, tuple(f for f in layers.HELLO_FIELDS if f in fields))
    # written, as the orders below read rows several times, and each would parse all payloads again
    rows = kept(rows, "packets")
    # what follows a FIN or RST is a flow of its own
    chunk, keys = CHUNK * LIFETIME_S * 10**9, [*within, "key"]
    rows = with_running(chunked(rows, "timestamp_ns", chunk), keys, "timestamp_ns", "seq", F.col("ends").cast("long"), "closed", to=-1).drop("_chunk")
    rows = kept(rows, "closed")
    rows = with_sessions(rows, [*keys, "closed"], "timestamp_ns", IDLE_S * 10**9, LIFETIME_S * 10**9, chunk)
    flow = [*keys, "closed", "_start"]
    own = Window.partitionBy(*flow).orderBy("timestamp_ns", "seq")
    first = F.first(F.struct("src", "src_port")).over(own)
    rows = rows.withColumn("up", F.struct("src", "src_port") == first).withColumn("gap", F.col("timestamp_ns") - F.lag("timestamp_ns").over(own))
    at_first = lambda c: F.min_by(c, F.struct("timestamp_ns", "seq")).alias({"src": "src_ip", "dst": "dst_ip", "mac": "src_mac"}.get(c, c))
    counted = F.when(F.col("gap") < GAP_NS, F.col("gap"))
    flows = rows.groupBy(*flow).agg(
        F.expr("cast(timestamp_micros(min(timestamp_ns) div 1000) as timestamp_ntz)").alias("timestamp"),
        F.min("timestamp_ns").alias("first_seen"), F.max("timestamp_ns").alias("last_seen"), at_first("src"), at_first("dst"), at_first("src_port"), at_first("dst_port"), at_first("mac"),
        F.max(F.when(F.col("protocol") == 6, "TCP").otherwise("UDP")).alias("protocol"),
        F.count_if(F.col("up")).alias("packets_up"), F.count_if(~F.col("up")).alias("packets_down"),
        F.coalesce(F.sum(F.when(F.col("up"), F.col("size"))), F.lit(0)).alias("bytes_up"), F.coalesce(F.sum(F.when(~F.col("up"), F.col("size"))), F.lit(0)).alias("bytes_down"),
        net.size_histogram(F.col("size")).alias("pkt_size_hist"), F.coalesce(F.avg(counted) / 1000, F.lit(0.0)).alias("pkt_iat_mean_us"), F.coalesce(F.sum(counted), F.lit(0)).alias("pkt_gaps_ns"), F.count(counted).alias("pkt_gaps"),
        *[layers.last_told(f, F.struct("timestamp_ns", "seq")) for f in fields],
    ).withColumn("duration_ms", F.expr("(last_seen - first_seen) div 1000000"))
    if numbered:
        flows = chunked(kept(flows, "flows"), "first_seen", chunk)
        flows = with_running(flows, keys, "first_seen", "closed", F.lit(1), "number").drop("_chunk")
    return flows.drop("key", "closed", "_start")


def added_flows(flows: DataFrame, by: list[str]) -> DataFrame:
    """Flow rows of `flows_from_packets` that are alike in `by`, as one: from the first to the last packet, with their sums."""
    total = lambda c: F.sum(c).alias(c)
    histogram = F.array(*[F.sum(F.col("pkt_size_hist")[i]) for i in range(len(net.SIZE_BOUNDS) + 1)]).alias("pkt_size_hist")
    rows = flows.groupBy(*by).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), *[total(c) for c in ("packets_up", "packets_down", "bytes_up", "bytes_down", "pkt_gaps_ns", "pkt_gaps")], histogram)
    mean = F.coalesce(F.try_divide("pkt_gaps_ns", "pkt_gaps") / 1000, F.lit(0.0))
    return rows.withColumns({"pkt_iat_mean_us": mean, "duration_ms": F.expr("(last_seen - first_seen) div 1000000")})

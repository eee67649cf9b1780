"""Addresses, flow keys and packet sizes as column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.functions.lookup import let


def ipv4_number(ip: Column) -> Column:
    """A dotted quad as a number; null for anything else."""
    parts = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("bigint"))
    number = reduce(lambda a, i: a * 256 + F.get(parts, F.lit(i)), range(1, 4), F.get(parts, F.lit(0)))
    return F.when((F.size(parts) == 4) & F.forall(parts, lambda x: x.between(0, 255)), number)


def is_private_narrow(ip: Column) -> Column:
    return ip.startswith("192.168.") | ip.startswith("10.")


def is_private_wide(ip: Column) -> Column:
    low, high = (172 << 24) + (16 << 16), (172 << 24) + (31 << 16) + 0xFFFF
    return is_private_narrow(ip) | F.coalesce(ipv4_number(ip).between(low, high), F.lit(False))


def ip_text(ip: Column) -> Column:
    """4 bytes as a dotted quad, 16 bytes as hex groups with the first longest run of zeros cut; else 0.0.0.0."""
    digits = F.hex(ip)
    v4 = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7), F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10)), ".")
    groups = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(29), F.lit(4)), lambda i: F.lower(F.conv(F.substring(digits, i, F.lit(4)), 16, 16))), ":")

    def short(full: Column) -> Column:
        runs = F.regexp_extract_all(full, F.lit("(?:^|:)0(?::0)+(?=:|$)"), F.lit(0))
        longest = F.array_max(F.transform(runs, lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("i"), r.alias("run"))))["run"]
        cut = lambda run: F.concat(F.substring(full, F.lit(1), F.position(run, full) - 1), F.lit("::"), F.regexp_replace(F.substring(full, F.position(run, full) + F.length(run), F.lit(99)), "^:", ""))
        return let(longest, lambda run: F.when(run.isNull(), full).otherwise(cut(run)))

    return F.when(F.length(ip) == 4, v4).when(F.length(ip) == 16, let(groups, short)).otherwise("0.0.0.0")


def ip_bytes(ip: Column) -> Column:
    """A dotted quad as 4 bytes; null for anything else."""
    return F.unhex(F.lpad(F.hex(ipv4_number(ip)), 8, "0"))


def address_bits(ip: Column) -> Column:
    """A dotted quad as 32 binary digits, hex groups (with or without ::) as 128; null for anything else."""
    v4 = F.lpad(F.conv(ipv4_number(ip).cast("string"), 10, 2), 32, "0")
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    short = F.position(F.lit("::"), ip) > 0
    head, tail = groups(F.substring_index(ip, "::", 1)), F.when(short, groups(F.substring_index(ip, "::", -1))).otherwise(F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.when(short, F.greatest(8 - F.size(head) - F.size(tail), F.lit(0))).otherwise(0))
    whole = F.concat(head, zeros, tail)
    v6 = F.array_join(F.transform(whole, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")
    valid = ip.contains(":") & (F.size(whole) == 8) & F.forall(whole, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$")) & (F.size(F.split(ip, "::")) <= 2)
    return F.coalesce(v4, F.when(valid, v6))


def network_bits(cidr: Column) -> Column:
    """The binary digits that all addresses of a network (`10.0.0.0/8`, `2001:db8::/32`) share; null for anything else."""
    bits, length = address_bits(F.substring_index(cidr, "/", 1)), F.get(F.split(cidr, "/"), F.lit(1)).try_cast("int")
    return F.when((length >= 0) & (length <= F.length(bits)), F.substring(bits, F.lit(1), length))


def mac_text(mac: Column) -> Column:
    return F.lower(F.regexp_replace(F.hex(mac), "(..)(?!$)", "$1:"))


def flow_key(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column, protocol: Column) -> Column:
    """The undirected five-tuple: the smaller (address, port) comes first."""
    a, b = F.struct(src_ip.alias("ip"), src_port.alias("port")), F.struct(dst_ip.alias("ip"), dst_port.alias("port"))
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), protocol.alias("protocol"))


#: Upper bounds of the packet-size buckets; the last bucket has none.
SIZE_BOUNDS = (64, 128, 256, 512, 1024, 1500)


def size_bucket(size: Column) -> Column:
    out = F.when(size <= SIZE_BOUNDS[0], 0)
    for i, bound in enumerate(SIZE_BOUNDS[1:], 1):
        out = out.when(size <= bound, i)
    return out.otherwise(len(SIZE_BOUNDS))


def size_histogram(size: Column) -> Column:
    """An aggregate: packets by size bucket, as an array of seven counts."""
    return F.array(*[F.count_if(size_bucket(size) == i) for i in range(len(SIZE_BOUNDS) + 1)])


def merge_histograms(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def human_bytes(n: Column) -> Column:
    """1.5G, 2.0M, 3.1K, 7; half a tenth rounds up."""
    one = lambda unit, name: F.concat(F.format_string("%.1f", (n / unit).cast("double")), F.lit(name))
    return F.when(n >= 1e9, one(1e9, "G")).when(n >= 1e6, one(1e6, "M")).when(n >= 1e3, one(1e3, "K")).otherwise(n.cast("long").cast("string"))

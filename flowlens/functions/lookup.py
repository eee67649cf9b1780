"""Small dimension tables as literals: a lookup is one hash and a scan of a bucket, without join or shuffle."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, though use may name it often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lookup(table: Mapping[str, tuple], fields: str) -> Callable[[Column], Column]:
    """A function from a key column to the struct of its row, or null. fields: DDL of the rows' values."""
    size = max(8, 2 * len(table))
    buckets: list[list] = [[] for _ in range(size)]
    for key, row in table.items():
        buckets[zlib.crc32(key.encode()) % size].append((key, row))
    names = [x.split()[0] for x in fields.split(",")]
    kinds = [x.split()[1] for x in fields.split(",")]
    row_type = "struct<key:string," + ",".join(f"{n}:{k}" for n, k in zip(names, kinds, strict=True)) + ">"

    # a JSON text that the optimizer folds to one literal: thousands of expression nodes would cost seconds of planning
    rows = [[{"key": k, **dict(zip(names, r, strict=True))} for k, r in b] for b in buckets]
    literal = F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), f"array<array<{row_type}>>")

    def find(key: Column) -> Column:
        bucket = F.get(literal, (F.crc32(key.cast("binary")) % size).cast("int"))
        return F.get(F.filter(bucket, lambda r: r["key"] == key), F.lit(0))  # null keys find nothing

    return find


def first_suffix(table: Mapping[str, tuple], fields: str) -> Callable[[Column], Column]:
    """Like lookup, by the domain itself and its parent domains; of several rows the least, by the first fields."""
    find = lookup(table, fields)
    names = [x.split()[0] for x in fields.split(",")]

    def match(domain: Column) -> Column:
        labels = F.split(F.lower(domain), r"\.")
        suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
        found = F.filter(F.transform(suffixes, find), lambda r: r.isNotNull())
        return F.array_min(F.transform(found, lambda r: F.struct(*[r[n].alias(n) for n in names])))

    return match

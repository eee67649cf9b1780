"""Time windows relative to an explicit as_of, so that results can be reproduced."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unit to its length and the most of it that a window may have.
UNITS = {"m": (timedelta(minutes=1), 525_600), "h": (timedelta(hours=1), 8_760), "d": (timedelta(days=1), 365)}


def parse_since(since: str | None, default: str = "1h") -> timedelta:
    """`15m`, `1h`, `7d`; what can't be read is an hour, an absent value the default."""
    if since is None:
        since = default
    found = re.fullmatch(r"(\d+)([mhd])", since.strip(), re.ASCII)
    if not found:
        return timedelta(hours=1)
    unit, most = UNITS[found[2]]
    return unit * min(int(found[1]), most)


def ntz(when: datetime) -> Column:
    return F.lit(when.isoformat(" ")).cast("timestamp_ntz")


def ago(as_of: datetime | Column, delta: timedelta) -> Column:
    """as_of - delta as a column. as_of: a time, or a column of one (see `newest`)."""
    return as_of - F.lit(delta) if isinstance(as_of, Column) else ntz(as_of - delta)


def window(df: DataFrame, as_of: datetime | Column, since: str | None, until: str | None = None, default: str = "1h", column: str = "timestamp") -> DataFrame:
    """Rows from as_of - since on, and before as_of - until if that is given; both bounds reach the scan."""
    df = df.where(F.col(column) >= ago(as_of, parse_since(since, default)))
    return df if until is None else df.where(F.col(column) < ago(as_of, parse_since(until)))


def newest(df: DataFrame, column: str = "timestamp") -> Column:
    """The table's last time as a column: a subquery of the plan that uses it, so that building a plan runs nothing. Column
    statistics or one pruned column answer it."""
    return df.agg(F.coalesce(F.max(column), F.lit("1970-01-01").cast("timestamp_ntz")).alias("newest")).scalar()


def latest(df: DataFrame, column: str = "timestamp") -> datetime:
    """The table's last time, for jobs that need it on the driver, as those that delete months do."""
    return df.agg(F.max(column)).first()[0] or datetime(1970, 1, 1)

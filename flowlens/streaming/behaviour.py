"""Behaviour scores of a stream of flows, each device's against its own history: the streaming side of `operators.anomaly`.

A device's state is what a score asks for: when each name was last taken in (a map), the last positive rates, the counts
by hour, flows and names. A flow costs a look-up of its name and two values for each micro-batch, whatever the history.
Flows of a micro-batch are taken in order of (timestamp, event_id); what comes in a later batch comes later.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from flowlens.operators import anomaly

#: The state store that keyed maps need.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

_OUT = "event_id long, timestamp timestamp_ntz, src_ip string, src_mac string, bytes_up long, bytes_down long, domain string, n long, is_new boolean, known long, rate double, mean_rate double, hour_count long, novelty double, volume double, timing double, risk_score int, reason string"


class Behaviour(StatefulProcessor):
    """memory: names that a device remembers, the first taken in going first; forget_s: seconds after which a state that
    wasn't written goes."""

    def __init__(self, memory: int | None, forget_s: int | None):
        self.memory, self.forget_ms = memory, forget_s and 1000 * forget_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.names = handle.getMapState("names", "name string", "number long", self.forget_ms)
        self.rates = handle.getValueState("rates", "rates array<double>", self.forget_ms)
        self.counts = handle.getValueState("counts", "flows long, names long, hours array<long>", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        flows, taken, hours = (int(self.counts.get()[0]), int(self.counts.get()[1]), [int(x) for x in self.counts.get()[2]]) if self.counts.exists() else (0, 0, [0] * 24)
        rates = [float(x) for x in self.rates.get()[0]] if self.rates.exists() else []
        met: dict[str, int | None] = {}
        out = []
        for r in pd.concat(rows).sort_values(["timestamp", "event_id"]).itertuples():
            name = r.domain if isinstance(r.domain, str) else None
            if name and name not in met:
                found = self.names.getValue((name,)) if self.names.containsKey((name,)) else None
                met[name] = found and int(found[0])
            # a name is remembered until `memory` others were taken in after it
            new = bool(name) and (met[name] is None or (self.memory is not None and taken - met[name] >= self.memory))
            known = taken if self.memory is None else min(taken, self.memory)
            mean = sum(rates) / len(rates) if rates else None
            hour = r.timestamp.hour
            novelty, volume, timing = anomaly.parts(flows, new, known, r.rate, mean, hours[hour], hour, int(r.bytes_up) + int(r.bytes_down))
            score = int(min(max(novelty + volume + timing, 0.0), 100.0))
            out.append((r.event_id, r.timestamp, key[0], r.src_mac, r.bytes_up, r.bytes_down, name, flows, new, known, r.rate, mean, hours[hour], novelty, volume, timing, score, anomaly.reasons(novelty, volume, timing, name)))
            flows, hours[hour] = flows + 1, hours[hour] + 1
            if new:
                taken += 1
                met[name] = taken
                self.names.updateValue((name,), (taken,))
            if r.rate > 0:
                rates = [*rates, r.rate][-anomaly.SAMPLES :]
        self.counts.update((flows, taken, hours))
        self.rates.update((rates,))
        frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in _OUT.split(", ")])
        yield frame.astype({"mean_rate": "float64"})

    def close(self) -> None:
        pass


def scored(flows: DataFrame, memory: int | None = None, forget_s: int | None = None) -> DataFrame:
    """The rows of `anomaly.scored` for a stream of flows; the session needs ROCKSDB. forget_s counts in processing time."""
    domain = F.when(F.col("sni") != "", F.col("sni")).otherwise(F.col("dns_domain"))
    rate = (F.col("bytes_up") + F.col("bytes_down")) / F.greatest(F.col("duration_ms") / 1000, F.lit(0.1))
    rows = flows.select("event_id", "timestamp", "src_ip", "src_mac", "bytes_up", "bytes_down", domain.alias("domain"), rate.alias("rate"))
    mode = "None" if forget_s is None else "ProcessingTime"
    return rows.groupBy("src_ip").transformWithStateInPandas(Behaviour(memory, forget_s), _OUT, "Append", mode)

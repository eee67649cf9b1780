"""Behaviour scores of flows against their device's own history, as window functions.

Each device's flows are taken in order of (timestamp, event_id). With n flows before: a new name scores 10 while n is
under WARM, then up to 35; a rate far over the mean of the last SAMPLES positive ones up to 25; a flow at an hour in
which the device is rarely seen up to 20. `alerts` keeps one alert of a kind in COOLDOWN_S seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.chunks import dealt, same
from flowlens.operators.sessions import session_starts
from flowlens.sources.shared import kept

WARM, SAMPLES, FULL_DOMAINS = 20, 60, 2000
#: Positive rates of a device that one task averages over; at least SAMPLES.
BLOCK = 65_536
THRESHOLD, COOLDOWN_S = 50, 300


def features(flows: DataFrame, block: int = BLOCK) -> DataFrame:
    """n, known (names met before), is_new, rate, mean_rate (of the last positive ones), hour_count.

    No window spans a device's history, as one device may hold a large share of all flows. Counts run within a device's
    clock hour and start from the totals of the hours before, which are aggregated first. Mean rates run within `block`
    positive rates, which get the last SAMPLES of the block before as well. Null domains are never new.
    """
    domain = F.when(F.col("sni") != "", F.col("sni")).otherwise(F.col("dns_domain"))
    rate = (F.col("bytes_up") + F.col("bytes_down")) / F.greatest(F.col("duration_ms") / 1000, F.lit(0.1))
    hour = F.hour("timestamp")
    slot = F.datediff(F.to_date("timestamp"), F.lit("1970-01-01")) * 24 + hour
    rows = flows.select("event_id", "timestamp", "src_ip", "src_mac", "bytes_up", "bytes_down", "duration_ms", domain.alias("domain"), hour.alias("hour"), rate.alias("rate"), slot.alias("slot"))
    positive = (F.col("rate") > 0).cast("long")

    first = rows.where("domain != ''").groupBy("src_ip", "domain").agg(F.min("slot").alias("slot"))
    slots = rows.groupBy("src_ip", "slot", "hour").agg(F.count("*").alias("flows"), F.sum(positive).alias("rates"))
    slots = same(slots, first.groupBy("src_ip", "slot").agg(F.count("*").alias("names")), ["src_ip", "slot"])
    past = Window.partitionBy("src_ip").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    hours = Window.partitionBy("src_ip", "hour").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    totals = [("flows", past, "n0"), ("names", past, "known0"), ("rates", past, "positives0"), ("flows", hours, "hour0")]
    slots = slots.select("src_ip", "slot", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(name) for c, w, name in totals])

    order = [F.col("timestamp"), F.col("event_id")]
    of_name = Window.partitionBy("src_ip", "slot", "domain").orderBy(*order)
    rows = same(rows.withColumn("nth", F.row_number().over(of_name)), first.withColumn("met", F.lit(True)), ["src_ip", "slot", "domain"])
    rows = rows.withColumn("is_new", F.coalesce(F.col("met") & (F.col("nth") == 1), F.lit(False))).drop("met", "nth")
    device = Window.partitionBy("src_ip", "slot").orderBy(*order)
    earlier = device.rowsBetween(Window.unboundedPreceding, -1)
    count = lambda x: F.coalesce(F.sum(x).over(earlier), F.lit(0))
    rows = rows.select("*", (F.row_number().over(device) - 1).alias("nth"), count(F.col("is_new").cast("long")).alias("names"), count(positive).alias("rates"))
    rows = same(rows, slots, ["src_ip", "slot"])
    rows = rows.select("*", (F.col("n0") + F.col("nth")).alias("n"), (F.col("known0") + F.col("names")).alias("known"), (F.col("positives0") + F.col("rates")).alias("positives"), (F.col("hour0") + F.col("nth")).alias("hour_count"))

    # positive samples only: their ranks make the frame
    own = F.floor(F.col("positives") / block)
    late = (F.col("rate") > 0) & (F.col("positives") % block >= block - SAMPLES)
    rows = rows.withColumn("block", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    ranked = Window.partitionBy("src_ip", "block").orderBy("positives").rangeBetween(-SAMPLES, -1)
    rows = rows.withColumn("mean_rate", F.avg(F.when(F.col("rate") > 0, F.col("rate"))).over(ranked)).where(F.col("block") == own)
    return rows.select("event_id", "timestamp", "src_ip", "src_mac", "bytes_up", "bytes_down", "duration_ms", "domain", "hour", "rate", "n", "is_new", "known", "positives", "mean_rate", "hour_count")


def scored(flows: DataFrame, block: int = BLOCK, memory: int | None = None) -> DataFrame:
    """features, scores and reasons. memory: how many names a device remembers (see `remembered`); all without it."""
    n, hour = F.col("n"), F.col("hour")
    total_bytes = F.col("bytes_up") + F.col("bytes_down")
    ratio = F.col("rate") / F.col("mean_rate")
    novelty = F.when(~F.col("is_new"), 0.0).when(n < WARM, 10.0).otherwise(10 + 25 * F.least(F.col("known") / FULL_DOMAINS, F.lit(1.0)))
    volume = (
        F.when((n < WARM) | F.col("mean_rate").isNull() | (F.col("mean_rate") < 1), 0.0)
        .when(ratio > 5, F.least(15 + 10 * F.least((ratio - 5) / 5, F.lit(1.0)), F.lit(25.0)))
        .when((ratio < 0.1) & (total_bytes > 100_000), 10.0)
        .otherwise(0.0)
    )
    share = F.col("hour_count") / F.greatest(n, F.lit(1))
    timing = (
        F.when(n < WARM, 0.0)
        .when((share < 1 / 240) & (n > 100), F.when((hour < 6) | (hour >= 23), 20.0).otherwise(10.0))
        .when((share < 1 / 48) & (F.col("hour_count") < 3), 8.0)
        .otherwise(0.0)
    )
    found = features(flows, block)
    if memory is not None:
        late = remembered(flows, memory).select("event_id", F.col("is_new").alias("_new"))
        found = found.join(late, "event_id", "left").withColumns({"is_new": F.coalesce("_new", "is_new"), "known": F.least("known", F.lit(memory))}).drop("_new")
    rows = found.select("*", novelty.alias("novelty"), volume.alias("volume"), timing.alias("timing"))
    score = F.least(F.greatest(F.col("novelty") + F.col("volume") + F.col("timing"), F.lit(0.0)), F.lit(100.0)).cast("int")
    reason = F.array_join(F.filter(F.array(F.when(F.col("novelty") > 15, F.concat(F.lit("new domain: "), "domain")), F.when(F.col("volume") > 15, F.lit("unusual traffic volume")), F.when(F.col("timing") > 15, F.lit("unusual time"))), lambda x: x.isNotNull()), "; ")
    return rows.withColumn("risk_score", score).withColumn("reason", F.when(reason == "", "behaviour deviates from the baseline").otherwise(reason))


def parts(n: int, is_new: bool, known: int, rate: float, mean: float | None, hour_count: int, hour: int, total_bytes: int) -> tuple[float, float, float]:
    """novelty, volume and timing of one flow, as `scored` has them; for streams."""
    novelty = 0.0 if not is_new else 10.0 if n < WARM else 10 + 25 * min(known / FULL_DOMAINS, 1.0)
    if n < WARM:
        return novelty, 0.0, 0.0
    volume, timing = 0.0, 0.0
    if mean is not None and mean >= 1:
        ratio = rate / mean
        if ratio > 5:
            volume = min(15 + 10 * min((ratio - 5) / 5, 1.0), 25.0)
        elif ratio < 0.1 and total_bytes > 100_000:
            volume = 10.0
    share = hour_count / n
    if share < 1 / 240 and n > 100:
        timing = 20.0 if hour < 6 or hour >= 23 else 10.0
    elif share < 1 / 48 and hour_count < 3:
        timing = 8.0
    return novelty, volume, timing


def reasons(novelty: float, volume: float, timing: float, domain: str | None) -> str:
    found = [f"new domain: {domain}"] * (novelty > 15) + ["unusual traffic volume"] * (volume > 15) + ["unusual time"] * (timing > 15)
    return "; ".join(found) or "behaviour deviates from the baseline"


def remembered(flows: DataFrame, memory: int = FULL_DOMAINS) -> DataFrame:
    """event_id, is_new of the named flows of devices with more than `memory` names, of which a device remembers so many and
    forgets the first taken in. For all other devices a name is new when it is first met.

    What is remembered depends on all that was taken in before, so these flows are taken in order, by a pass over sorted
    rows that holds the names of one device and no more, whatever its flows.
    """
    domain = F.when(F.col("sni") != "", F.col("sni")).otherwise(F.col("dns_domain"))
    rows = flows.select("event_id", "timestamp", "src_ip", domain.alias("domain")).where("domain <> '' and src_ip is not null")
    many = rows.groupBy("src_ip").agg(F.count_distinct("domain").alias("names")).where(F.col("names") > memory).select("src_ip")

    def in_order(batches):
        import pyarrow as pa

        device, numbers, taken = None, {}, 0
        for batch in batches:
            new = []
            for ip, name in zip(batch.column("src_ip").to_pylist(), batch.column("domain").to_pylist(), strict=True):
                if ip != device:
                    device, numbers, taken = ip, {}, 0
                new.append(name not in numbers or taken - numbers[name] >= memory)
                if new[-1]:
                    taken += 1
                    numbers[name] = taken
                    if len(numbers) > 2 * memory:
                        numbers = {k: v for k, v in numbers.items() if taken - v < memory}
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), pa.array(new, pa.bool_())], ["event_id", "is_new"])

    # `dealt`, as Spark would leave out a repartition by the key of the join
    ordered = dealt(rows.join(many, "src_ip", "left_semi"), ["src_ip"]).sortWithinPartitions("src_ip", "timestamp", "event_id")
    return ordered.select("src_ip", "event_id", "domain").mapInArrow(in_order, "event_id long, is_new boolean")


def alerts(rows: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Of the rows over the threshold (rows: a frame of `scored`) those that come COOLDOWN_S or more after the last one kept of
    their device and reason. What is kept begins a session of that length, so `session_starts` finds it by chunks of time."""
    found = rows.where(F.col("risk_score") >= threshold).select("event_id", "timestamp", "src_ip", "src_mac", "risk_score", "reason", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("_at"))
    found, keys = kept(found, "alerts"), ["src_ip", "reason"]
    starts = session_starts(found, keys, "_at", COOLDOWN_S * 10**6 - 1, COOLDOWN_S * 10**6 - 1)
    # of alerts at one time the first
    first = found.groupBy(*keys, "_at").agg(F.min_by(F.struct("event_id", "timestamp", "src_mac", "risk_score"), "event_id").alias("_row"))
    told = same(first, starts.select(*keys, "_at", F.lit(True).alias("_kept")), [*keys, "_at"]).where("_kept")
    return told.select("_row.event_id", "_row.timestamp", "src_ip", "_row.src_mac", "_row.risk_score", "reason")

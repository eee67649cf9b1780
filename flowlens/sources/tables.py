"""Readers and writers of the stored tables, and the JSON records' branches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import schema
from flowlens.functions import classify
from flowlens.operators.traffic import latest_version
from flowlens.timerange import parse_since, window


def read_flows(spark: SparkSession, path: str, as_of: datetime | None = None, since: str | None = None) -> DataFrame:
    """The flows table. With a window, months outside it are not even listed: the partition column is filtered too."""
    flows = spark.read.parquet(path)
    if as_of is None:
        return flows
    first = (as_of - parse_since(since)).strftime("%Y%m")
    return window(flows.where(F.col("yyyymm") >= int(first)), as_of, since)


def write_flows(flows: DataFrame, path: str, mode: str = "append") -> None:
    """By month; each month's rows meet in few tasks, so that a month has few files."""
    rows = flows.withColumn("yyyymm", F.date_format("timestamp", "yyyyMM").cast("int"))
    rows.hint("rebalance", "yyyymm").write.partitionBy("yyyymm").mode(mode).parquet(path)


def _paths(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def months(spark: SparkSession, path: str) -> list[int]:
    """The months that a table has partitions of, from its folders alone."""
    hadoop, files = _paths(spark, path)
    found = files.listStatus(hadoop) if files.exists(hadoop) else []
    return sorted(int(f.getPath().getName().removeprefix("yyyymm=")) for f in found if f.getPath().getName().startswith("yyyymm="))


def merged_batches(spark: SparkSession, path: str) -> set[str]:
    """The batches that merge_flows has taken into a table."""
    hadoop, files = _paths(spark, f"{path}/_merged")
    return {f.getPath().getName() for f in files.listStatus(hadoop)} if files.exists(hadoop) else set()


def _replace_months(spark: SparkSession, rows: DataFrame, path: str, name: str) -> None:
    """Puts rows (with yyyymm) in the place of their months; other months' files stay as they are. rows may read the table:
    they are written beside it first."""
    beside = f"{path}/_staged/{name}"
    rows.hint("rebalance", "yyyymm").write.mode("overwrite").partitionBy("yyyymm").parquet(beside)
    spark.read.parquet(beside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("yyyymm").parquet(path)
    hadoop, files = _paths(spark, beside)
    files.delete(hadoop, True)


def merge_flows(flows: DataFrame, path: str, batch: str) -> bool:
    """Takes a batch of flows into a table: of rows with one (timestamp, src_ip, first_seen) the one seen last stays.

    Only the months that the batch touches are read and replaced, each as a whole. A batch has an identity, and one that was
    taken in is not taken in again (False). One that failed before its mark was set can be: the rows that it had brought are
    versions that lose to themselves. Batches of one table are merged one after another, in any order.
    """
    spark = flows.sparkSession
    if batch in merged_batches(spark, path):
        return False
    new = flows.withColumn("yyyymm", F.date_format("timestamp", "yyyyMM").cast("int"))
    # a row for each month, whatever the batch holds
    touched = [r.yyyymm for r in new.select("yyyymm").distinct().collect()]
    if touched:
        there = [m for m in months(spark, path) if m in touched]
        if there:
            old = spark.read.parquet(path).where(F.col("yyyymm").isin(there))
            new = new.unionByName(old, allowMissingColumns=True)
        _replace_months(spark, latest_version(new), path, batch)
    hadoop, files = _paths(spark, f"{path}/_merged/{batch}")
    files.create(hadoop, True).close()
    return True


def expire(spark: SparkSession, path: str, as_of: datetime, days: int = 90) -> tuple[list[int], int | None]:
    """Deletes what is older than `days` days. Months that are past as a whole go with their folders, unread; the month of
    the boundary alone is written anew, and only if it has rows that are too old. Returns the months deleted and that one."""
    begin = as_of - parse_since(f"{days}d")
    first, gone = int(begin.strftime("%Y%m")), []
    for month in months(spark, path):
        if month < first:
            hadoop, files = _paths(spark, f"{path}/yyyymm={month}")
            files.delete(hadoop, True)
            gone.append(month)
    if first not in months(spark, path):
        return gone, None
    rows = spark.read.parquet(path).where(F.col("yyyymm") == first)
    old = F.col("timestamp") < F.lit(begin.isoformat(" ")).cast("timestamp_ntz")
    if rows.where(old).isEmpty():
        return gone, None
    kept = rows.where(~old)
    if kept.isEmpty():
        hadoop, files = _paths(spark, f"{path}/yyyymm={first}")
        files.delete(hadoop, True)
    else:
        _replace_months(spark, kept, path, f"expire-{first}")
    return gone, first


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Alerts without an address are left out."""
    rows = alerts.where("coalesce(src_ip, '') <> ''").withColumn("yyyymm", F.date_format("timestamp", "yyyyMM").cast("int"))
    rows.hint("rebalance", "yyyymm").write.partitionBy("yyyymm").mode("append").parquet(path)


def append_sessions(records: DataFrame, path: str) -> None:
    """Requests of the JSON source as rows of the sessions table."""
    rows = session_records(records).where("type = 'http_request'").drop("type").withColumn("yyyymm", F.date_format("timestamp", "yyyyMM").cast("int"))
    rows.hint("rebalance", "yyyymm").write.partitionBy("yyyymm").mode("append").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("quote", "").mode("overwrite").csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of the JSON source; unreadable lines are rows of nulls, which no branch takes."""
    return spark.read.schema(schema.UDP_JSON).json(path)


def stream_json(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema.UDP_JSON).option("maxFilesPerTrigger", files_per_trigger).json(path)


def _text(name: str):
    return F.coalesce(F.col(name), F.lit(""))


def _count(name: str):
    return F.coalesce(F.col(name), F.lit(0))


def flow_records(records: DataFrame) -> DataFrame:
    """Finished flows as flow rows. Times of 1e11 and more are nanoseconds, smaller ones seconds."""
    rows = records.where("type = 'flow_end'")
    nanos = lambda c: F.when(_count(c) >= 100_000_000_000, _count(c)).otherwise(_count(c) * 1_000_000_000)
    first, last = nanos("first_seen"), nanos("last_seen")
    sni, dns, port = _text("tls_sni"), _text("dns_domain"), _count("dst_port")
    app = classify.accepted(classify.weighted_vote(F.array(classify.rules_engine(sni, dns, port))))
    return rows.select(
        F.timestamp_seconds(F.coalesce("timestamp", F.lit(0.0))).cast("timestamp_ntz").alias("timestamp"), first.alias("first_seen"), last.alias("last_seen"), _text("src_ip").alias("src_ip"), _text("dst_ip").alias("dst_ip"),
        _count("src_port").alias("src_port"), port.alias("dst_port"), F.coalesce("protocol", F.lit("TCP")).alias("protocol"), sni.alias("sni"), dns.alias("dns_domain"), _text("http_host").alias("http_host"),
        _count("packets").alias("packets_up"), F.lit(0).cast("long").alias("packets_down"), _count("bytes").alias("bytes_up"), F.lit(0).cast("long").alias("bytes_down"),
        _text("src_mac").alias("src_mac"), _text("hostname").alias("device_hostname"), classify.manufacturer(sni, dns, _text("src_mac")).alias("device_manufacturer"), app.alias("_app"),
    ).withColumn("duration_ms", F.expr("greatest(last_seen - first_seen, 0) div 1000000")).select("*", "_app.*").drop("_app")


def device_records(records: DataFrame) -> DataFrame:
    rows = records.where("type = 'device_info' and coalesce(ip, '') <> ''")
    return rows.select("ip", _text("mac").alias("mac"), _text("hostname").alias("hostname"), _text("vendor_class").alias("vendor_class"), classify.vendor_of_device(F.col("vendor_class"), _text("mac")).alias("manufacturer"), F.coalesce("timestamp", F.lit(0.0)).cast("long").alias("first_seen"))


def session_records(records: DataFrame) -> DataFrame:
    """Proxy requests and responses; a response has a status code, a request 0."""
    rows = records.where("type in ('http_request', 'http_response') and not coalesce(host, '') like '%mitmproxy%'")
    response = F.col("type") == "http_response"
    return rows.select(
        "type", F.timestamp_seconds(F.coalesce("timestamp", F.lit(0.0))).cast("timestamp_ntz").alias("timestamp"), _text("host").alias("host"), F.substring(_text("path"), 1, F.when(response, 64).otherwise(128)).alias("path"), _text("method").alias("method"),
        F.substring(_text("user_agent"), 1, 128).alias("user_agent"), _text("content_type").alias("content_type"), _text("scheme").alias("scheme"), F.lit("mitmproxy").alias("src_ip"), _count("status_code").alias("status_code"), _count("content_length").alias("content_length"), _count("port").alias("port"),
    )

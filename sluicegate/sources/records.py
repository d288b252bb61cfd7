"""Raw record sources, ticks and heartbeats. Every source gives the columns of the Kafka source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "topic string, partition int, offset long, timestamp timestamp, key binary, value binary, headers array<struct<key:string,value:binary>>"


def kafka_stream(spark: SparkSession, client: dict[str, str], pattern: str | None = None, topics: list[str] | None = None, start: str = "latest") -> DataFrame:
    """The Kafka source (its connector must be on the class path); a pattern wins over a list."""
    reader = spark.readStream.format("kafka").option("includeHeaders", "true").option("startingOffsets", start)
    for k, v in client.items():
        reader = reader.option(f"kafka.{k}", v)
    reader = reader.option("subscribePattern", pattern) if pattern else reader.option("subscribe", ",".join(topics or []))
    return reader.load()


def file_stream(spark: SparkSession, path: str, schema: str = RAW, max_files: int = 100) -> DataFrame:
    """Files of raw records as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def tick_stream(spark: SparkSession, topics: list[str], rate: int = 1) -> DataFrame:
    """One synthetic row for each topic and tick: (topic, ingest_ts, synthetic)."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rate).load()
    return ticks.select(F.explode(F.array(*map(F.lit, topics))).alias("topic"), F.col("timestamp").alias("ingest_ts"), F.lit(True).alias("synthetic"))


def window_spine(windows: DataFrame, size_s: int, until=None) -> DataFrame:
    """Every window of each topic between its first and the last of all (or ``until``): (topic, window_start)."""
    last = F.lit(until).cast("timestamp") if until is not None else F.col("last_all")
    span = windows.groupBy("topic").agg(F.min("window_start").alias("first"))
    overall = windows.agg(F.max("window_start").alias("last_all"))
    return span.crossJoin(F.broadcast(overall)).select("topic", F.explode(F.sequence("first", last, F.expr(f"interval {size_s} seconds"))).alias("window_start"))


def heartbeats(ticks: DataFrame) -> DataFrame:
    """One heartbeat for each job and second; of repeats the earliest stays."""
    return ticks.groupBy("job_id", "ts").agg(F.min_by(F.struct("version", "kafka_status", "registry_status"), "seq").alias("_first")).select("job_id", "ts", "_first.*")

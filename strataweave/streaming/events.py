"""Structured Streaming operators over event tables (event_id, ts, user_id, event_type, value, props)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at the path, with their own schema and session-time timestamps."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, so that a single file may be the source
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName().startswith("timestamp")})


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a table of the shared folder, and read it.

    The sink's log makes each batch appear once even where a batch is run again.
    """
    base = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}-log").trigger(availableNow=True)
    writer.format("parquet").option("path", base).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(base)


def drain_batches(stream: DataFrame, name: str, apply: Callable[[DataFrame, int], DataFrame], mode: str = "append") -> DataFrame:
    """Run each batch through ``apply`` and write it under its batch id, so that a repeated batch replaces itself."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def work(batch: DataFrame, number: int) -> None:
        apply(batch, number).write.mode("overwrite").parquet(f"{base}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}-log").trigger(availableNow=True).foreachBatch(work).start().awaitTermination()
    return spark.read.parquet(base)


def route(events: DataFrame, schema: str, actions: list[str]) -> DataFrame:
    """Events with their payload parsed and a route: the action, or quarantine where action or payload is not understood."""
    payload = F.from_json("props", schema)
    bad = payload.isNull() | ~F.col("event_type").isin(*actions)
    return events.withColumn("payload", payload).withColumn("route", F.when(F.coalesce(bad, F.lit(True)), "quarantine").otherwise(F.col("event_type")))


def promotions(events: DataFrame, kinds: list[str], least: float) -> DataFrame:
    """Stateless filter: events of entities that qualify."""
    return events.filter(F.col("event_type").isin(*kinds) & (F.col("value") >= least))


def windowed_counts(events: DataFrame, key: str, length: str, late: str = "2 days") -> DataFrame:
    """Counts a key and window; windows close once the watermark passes them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), key).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def first_seen(events: DataFrame, keys: list[str], late: str = "30 days") -> DataFrame:
    """The first row of each key while it is within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, key: str, gap: str = "1 hour", late: str = "30 days") -> DataFrame:
    """Sessions of a key that a silence ends, with their first and last event; over a stream a session appears once the watermark has passed it."""
    ends = F.count("*").alias("events"), F.min("ts").alias("started"), F.max("ts").alias("ended")
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(*ends)


def rolling_success(outcomes: DataFrame, key: str, length: str = "7 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    """key, window, n, success_rate, confidence (mean) of (ts, success, confidence) in sliding windows, of a stream or a table."""
    rows = outcomes.withWatermark("ts", late).groupBy(F.window("ts", length, step), key)
    return rows.agg(F.count("*").alias("n"), F.avg(F.col("success").cast("int")).alias("success_rate"), F.avg("confidence").alias("confidence"))

"""Sources and sinks: directory scans, exports, the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def scan(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, category (the first directory under the root, else general), size; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    below = F.regexp_replace(F.col("path"), "^.*/" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    category = F.when(below.contains("/"), F.regexp_extract(below, "^([^/]+)/", 1)).otherwise("general")
    return files.select("path", category.alias("category"), F.col("length").alias("size"))


def export(rows: DataFrame, path: str, kind: str = "json") -> None:
    """JSON lines, or CSV with nested values as JSON and columns by name."""
    if kind == "json":
        rows.write.mode("overwrite").json(path)
        return
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in sorted(rows.schema, key=lambda f: f.name)]
    rows.select(*flat).write.mode("overwrite").option("header", True).option("escape", "\"").csv(path)


def append_log(events: DataFrame, path: str) -> None:
    """Append to an audit log partitioned by day."""
    events.withColumn("day", F.col("ts").cast("date")).write.mode("append").partitionBy("day").parquet(path)


def recent_log(spark: SparkSession, path: str, limit: int, kind: str | None = None) -> DataFrame:
    log = spark.read.parquet(path)
    return (log.filter(F.col("event_type") == kind) if kind else log).orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)

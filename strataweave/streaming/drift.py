"""Drift of outcomes on a stream: days that have closed are compared with all days before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COUNTS = ("n", "good", "sure", "sure_good")


def daily(outcomes: DataFrame, key: str, late: str = "2 days", sure: float = 0.8) -> DataFrame:
    """key, day, n, good, sure, sure_good of (ts, success, confidence), of a stream or a table; over a stream a day appears once the watermark has passed it."""
    ok, high = F.coalesce("success", F.lit(False)), F.coalesce(F.col("confidence") > sure, F.lit(False))
    rows = outcomes.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("_day"), key)
    counted = rows.agg(F.count("*").alias("n"), F.count_if(ok).alias("good"), F.count_if(high).alias("sure"), F.count_if(high & ok).alias("sure_good"))
    return counted.select(key, F.col("_day.start").cast("date").alias("day"), *COUNTS)


def drift(days: DataFrame, key: str, window: int = 7, least: int = 10, limit: float = 0.15) -> DataFrame:
    """key, day, recent, before, success_drop, sure_drop, score, drifted, advice: the window that ends with each day against all days before the window.

    Rises count as no drop; a share of nothing is 0. Score and drops are null where either side has fewer than ``least`` outcomes. A key's rows are its days, so a window is small.
    """
    order = Window.partitionBy(key).orderBy(F.unix_date("day"))
    now, past = order.rangeBetween(1 - window, 0), order.rangeBetween(Window.unboundedPreceding, -window)
    total = {f"{side}_{c}": F.coalesce(F.sum(c).over(span), F.lit(0)) for side, span in (("now", now), ("past", past)) for c in COUNTS}
    rows = days.groupBy(key, "day").agg(*(F.sum(c).alias(c) for c in COUNTS)).select(key, "day", *(v.alias(n) for n, v in total.items()))
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    enough = (F.col("now_n") >= least) & (F.col("past_n") >= least)
    fall = lambda a, b: F.when(enough, F.greatest(F.lit(0.0), share(f"past_{a}", f"past_{b}") - share(f"now_{a}", f"now_{b}")))
    rows = rows.select(key, "day", F.col("now_n").alias("recent"), F.col("past_n").alias("before"), fall("good", "n").alias("success_drop"), fall("sure_good", "sure").alias("sure_drop"))
    rows = rows.withColumn("score", F.round(0.6 * F.col("success_drop") + 0.4 * F.col("sure_drop"), 6)).withColumn("drifted", F.coalesce(F.col("score") > limit, F.lit(False)))
    advice = F.array_compact(F.array(F.when(F.col("success_drop") > 0.1, "retrain"), F.when(F.col("sure_drop") > 0.1, "recalibrate")))
    return rows.withColumns({"success_drop": F.round("success_drop", 6), "sure_drop": F.round("sure_drop", 6), "advice": F.when(F.col("drifted"), advice).otherwise(F.array().cast("array<string>"))})


def run(outcomes: DataFrame, key: str, folder: str, log: str, late: str = "2 days", every: str | None = None, **settings):
    """A streaming query that keeps the counts of closed days and writes each batch's newly closed days with their drift; read both with ``closed`` and ``found``.

    Both are written under the batch's number, so that a batch that is run again replaces itself.
    """
    days = daily(outcomes, key, late)

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/days/batch={number}")
        held = spark.read.schema(days.schema.add("batch", "long")).option("basePath", f"{folder}/days").parquet(f"{folder}/days").filter(F.col("batch") <= number)
        new = held.filter(F.col("batch") == number).select(key, "day").distinct()
        drift(held.drop("batch"), key, **settings).join(new, [key, "day"], "left_semi").write.mode("overwrite").parquet(f"{folder}/drift/batch={number}")

    writer = days.writeStream.outputMode("append").option("checkpointLocation", log).foreachBatch(work)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def found(spark, folder: str) -> DataFrame:
    """What ``run`` has written of all closed days."""
    return spark.read.option("basePath", f"{folder}/drift").parquet(f"{folder}/drift").drop("batch")

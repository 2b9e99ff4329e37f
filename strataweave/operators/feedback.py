"""Feedback, predictions, sessions and messages: statistics, trends, training rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import rules
from .graph import banded


def statistics(feedback: DataFrame) -> DataFrame:
    """One row: total, mean rating, a count for each rating, corrections, positives, negatives, types (``type:n``, most frequent first; null left out)."""
    one = feedback.agg(
        F.count("*").alias("total"), F.round(F.avg("rating"), 6).alias("mean_rating"), *(F.count_if(F.col("rating") == r).alias(f"rating_{r}") for r in range(1, 6)),
        F.count("correction_text").alias("corrections"), F.count_if(F.col("rating") >= 4).alias("positives"), F.count_if(F.col("rating") <= 2).alias("negatives"),
    )
    kinds = feedback.filter("feedback_type is not null").groupBy("feedback_type").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "feedback_type"))).alias("t"))  # a row a type
    return one.join(kinds.select(F.array_join(F.transform("t", lambda x: F.concat(x["feedback_type"], F.lit(":"), (-x["n"]).cast("string"))), ",").alias("types")), F.lit(True))


def layer_performance(feedback: DataFrame, top: int = 5) -> DataFrame:
    """layer, total, mean_rating, negative_rate, failures (the most frequent types of its negative feedback), suggestions (by the table of rules, in order, joined by ``; ``)."""
    rows = feedback.select(F.explode("layers").alias("layer"), "rating", "feedback_type")
    base = rows.groupBy("layer").agg(F.count("*").alias("total"), F.avg("rating").alias("_mean"), F.round(F.avg("rating"), 6).alias("mean_rating"), F.round(F.avg((F.col("rating") <= 2).cast("int")), 6).alias("negative_rate"))
    failed = rows.filter("rating <= 2").groupBy("layer", "feedback_type").count()
    rank = F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("count"), "feedback_type"))
    names = failed.withColumn("rank", rank).filter(F.col("rank") <= top).groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("rank", "feedback_type"))).alias("f"))
    holds = lambda layer, what: ((F.col("layer") == layer) | F.lit(layer == "*")) & (F.col("_mean") < what if isinstance(what, float) else F.array_contains("f.feedback_type", what))
    suggested = F.concat_ws("; ", *(F.when(holds(layer, what), F.replace(F.lit(text), F.lit("{layer}"), F.col("layer"))) for layer, what, text in rules.LAYER_SUGGESTIONS))
    rows = base.join(names, "layer", "left").select("*", suggested.alias("suggestions"))
    return rows.select("layer", "total", "mean_rating", "negative_rate", F.array_join(F.transform("f", lambda x: x["feedback_type"]), ",").alias("failures"), "suggestions")


def operations(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("operation_type").agg(F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def calibration(predictions: DataFrame, bins: int = 5) -> DataFrame:
    """bin, n, mean_confidence, accuracy, error by equal-width confidence bins."""
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    rows = predictions.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg(F.col("success").cast("int")).alias("a"))
    return rows.select("bin", "n", F.round("c", 6).alias("mean_confidence"), F.round("a", 6).alias("accuracy"), F.round(F.abs(F.col("c") - F.col("a")), 6).alias("error"))


def calibration_quality(predictions: DataFrame, bins: int = 5) -> DataFrame:
    """weighted_error over bins, and its band."""
    error = calibration(predictions, bins).agg(F.round(F.sum(F.col("error") * F.col("n")) / F.sum("n"), 4).alias("weighted_error"))
    return error.withColumn("quality", F.when(F.col("weighted_error") < 0.05, "good").when(F.col("weighted_error") < 0.15, "fair").otherwise("poor"))


def drift(predictions: DataFrame, ref: str, days: int = 7, least: int = 10, limit: float = 0.15) -> DataFrame:
    """One row: 0.6 of the fall of success and 0.4 of the fall of success above a confidence of 0.8 in the last days against before; null below ``least`` rows.

    Rises count as no fall, and a side without confident rows has a success of 0.
    """
    recent = F.col("ts") >= F.lit(ref).cast("timestamp") - F.expr(f"interval {days} days")
    ok, sure = F.col("success").cast("int"), F.col("confidence") > 0.8
    rate = lambda side, more=F.lit(True): F.coalesce(F.avg(F.when(side & more, ok)), F.lit(0.0))
    one = predictions.agg(
        F.count_if(recent).alias("recent"), F.count_if(~recent).alias("before"), F.greatest(F.lit(0.0), rate(~recent) - rate(recent)).alias("d1"), F.greatest(F.lit(0.0), rate(~recent, sure) - rate(recent, sure)).alias("d2"))
    score = F.when((F.col("recent") >= least) & (F.col("before") >= least), F.round(0.6 * F.col("d1") + 0.4 * F.col("d2"), 6))
    return one.select("recent", "before", score.alias("score")).withColumn("drifted", F.col("score") > limit)


def patterns(predictions: DataFrame, support: int = 5, share: float = 0.85, confidence: float = 0.8) -> DataFrame:
    """Pattern keys (third word of the action) of confident actions: support and share of successes."""
    rows = predictions.filter(F.col("confidence") >= confidence).groupBy(F.split("action", " ")[2].alias("pattern"))
    rows = rows.agg(F.count("*").alias("support"), F.round(F.avg(F.col("success").cast("int")), 6).alias("share"))
    return rows.filter((F.col("support") >= support) & (F.col("share") >= share))


def aggregate_confidence(scores: DataFrame, key: str, score: str = "confidence", weight: Column | None = None) -> DataFrame:
    """min, max, average, weighted, product and noisy-or of the scores of a key."""
    w = F.lit(1.0) if weight is None else weight
    s = F.col(score)
    return scores.groupBy(key).agg(
        F.min(s).alias("least"), F.max(s).alias("most"), F.avg(s).alias("average"), (F.sum(w * s) / F.sum(w)).alias("weighted"), F.product(s).alias("product"), (1 - F.product(1 - s)).alias("noisy_or"),
    )


def rating_trend(feedback: DataFrame, key: str, size: int = 10, gap: float = 0.2) -> DataFrame:
    """Mean of the last ratings against the ones before them: improving, declining, stable or insufficient."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("feedback_id")))
    rows = feedback.withColumn("rank", rank).filter(F.col("rank") <= 2 * size)
    means = rows.groupBy(key).agg(F.avg(F.when(F.col("rank") <= size, F.col("rating"))).alias("last"), F.avg(F.when(F.col("rank") > size, F.col("rating"))).alias("previous"))
    change = F.col("last") - F.col("previous")
    trend = F.when(change.isNull(), "insufficient").when(change > gap, "improving").when(change < -gap, "declining").otherwise("stable")
    return means.select(key, F.round("last", 6).alias("last"), F.round("previous", 6).alias("previous"), trend.alias("trend"))


def confidence_trend(predictions: DataFrame, key: str, size: int = 5, share: float = 0.1) -> DataFrame:
    """First against last of the latest confidences: up or down by more than the share, else stable."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("operation_id")))
    rows = predictions.withColumn("rank", rank).filter(F.col("rank") <= size)
    ends = rows.groupBy(key).agg(F.max_by("confidence", "rank").alias("first"), F.min_by("confidence", "rank").alias("last"))
    trend = F.when(F.col("last") > F.col("first") * (1 + share), "up").when(F.col("last") < F.col("first") * (1 - share), "down").otherwise("stable")
    return ends.select(key, F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), trend.alias("trend"))


def clamped_sums(steps: DataFrame, key: str, order: list[str], step: str, start: float, low: float, high: float) -> DataFrame:
    """key, value: the final value a key of a sum that is clamped after every step, in order.

    A run of steps maps x to min(max(x + add, least), most), and such maps compose to one. So rows are sorted by key and order over all
    tasks, a task folds each key's run into one map, and only these, one a key and task, are put together: a key with most rows is spread.
    """
    rows = steps.select(key, *order, F.col(step).cast("double").alias("_step"))
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    kind = steps.schema[key].dataType.simpleString()

    def fold(frames):
        part, held = TaskContext.get().partitionId(), None
        for frame in frames:
            for who, step in zip(frame[key], frame["_step"], strict=True):
                if held is None or held[0] != who:
                    if held is not None:
                        yield pd.DataFrame([held], columns=[key, "_part", "_add", "_least", "_most"])
                    held = (who, part, 0.0, -math.inf, math.inf)
                held = (who, part, held[2] + step, min(max(held[3] + step, low), high), min(max(held[4] + step, low), high))
        if held is not None:
            yield pd.DataFrame([held], columns=[key, "_part", "_add", "_least", "_most"])

    runs = ranged.mapInPandas(fold, f"{key} {kind}, _part int, _add double, _least double, _most double")
    ordered = F.array_sort(F.collect_list(F.struct("_part", "_add", "_least", "_most")))
    value = F.aggregate(ordered, F.lit(float(start)), lambda x, m: F.least(F.greatest(x + m["_add"], m["_least"]), m["_most"]))
    return runs.groupBy(key).agg(value.alias("value"))


def propagated(feedback: DataFrame, entity: str, order: list[str], decay: float = 0.05, boost: float = 0.02, start: float = 0.5, low: float = 0.1, high: float = 1.0) -> DataFrame:
    """entity, value, feedbacks, negative, positive: ratings up to 2 lower an entity's confidence (twice where critical), from 4 on they raise it, within bounds after each."""
    bad, good = F.col("rating") <= 2, F.col("rating") >= 4
    step = F.when(bad, -decay * F.when(F.col("severity") == "critical", 2).otherwise(1)).when(good, boost).otherwise(0.0)
    counts = feedback.groupBy(entity).agg(F.count("*").alias("feedbacks"), F.count_if(bad).alias("negative"), F.count_if(good).alias("positive"))
    return clamped_sums(feedback.withColumn("_step", step), entity, order, "_step", start, low, high).join(counts, entity)


def demotions(nodes: DataFrame, feedback: DataFrame, entity: str = "entity", least: int = 5, negatives: int = 3, drop: float = 0.2, above: float = 0.3, floor: float = 0.1, layers: Mapping[str, str] = rules.DEMOTION) -> DataFrame:
    """Nodes that enough feedback, and enough of it negative, moves a layer down: id, layer, previous_layer, confidence, feedbacks, negatives.

    Confidence above ``above`` falls by ``drop``, any other becomes ``floor``, also where there was none. Nodes of the lowest or of no known layer stay.
    ``storage.upsert`` or a graph store's commit takes the rows.
    """
    rows = feedback.groupBy(F.col(entity).alias("id")).agg(F.count("*").alias("feedbacks"), F.count_if(F.col("rating") <= 2).alias("negatives"))
    rows = rows.filter((F.col("feedbacks") >= least) & (F.col("negatives") >= negatives))
    lower = F.coalesce(*(F.when(F.col("layer") == k, v) for k, v in layers.items()))
    lowered = F.when(F.col("confidence") > above, F.col("confidence") - drop).otherwise(F.lit(floor))
    moved = nodes.join(rows, "id").withColumn("lower", lower).filter("lower is not null")
    return moved.select("id", F.col("lower").alias("layer"), F.col("layer").alias("previous_layer"), lowered.alias("confidence"), "feedbacks", "negatives")


def review_needed(confidences: DataFrame, key: str = "key", layers: Sequence[str] = rules.LAYERS, spread: float = 0.5, inverted: float = 0.2) -> DataFrame:
    """key, review of (key, layer, confidence): the best confidences of layers lie further apart than ``spread``, or a lower layer's passes a higher one's by more than ``inverted``."""
    from itertools import combinations

    rows = confidences.filter(F.col("layer").isin(*layers)).groupBy(key).pivot("layer", list(layers)).agg(F.max("confidence"))
    review = F.round(F.greatest(*layers) - F.least(*layers), 9) > spread
    for low, high in combinations(layers, 2):
        review = review | F.coalesce(F.round(F.col(low) - F.col(high), 9) > inverted, F.lit(False))
    return rows.select(key, review.alias("review"))


def rating_pairs(feedback: DataFrame, gap: int = 2, limit: int = 1000) -> DataFrame:
    """Preference pairs of one query text whose ratings differ by at least ``gap`` and whose answers differ; the ``limit`` widest, then by ids.

    A row that another answer with such a rating stands beside is in one pair at least, so the pairs are of the first ``limit`` of these rows, by gap and id. They meet, of a query text and rating, the first
    2 * ``limit`` rows by id once each answer is there ``limit`` times at most: of these, ``limit`` or all differ from any one answer.
    """
    f = feedback.select("query_text", "rating", "response_text", "feedback_id").filter("query_text is not null and rating is not null and response_text is not null")
    chosen, rejected = f.toDF("query_text", "chosen_rating", "chosen", "chosen_id"), f.toDF("query_text", "rejected_rating", "rejected", "rejected_id")
    by = ["query_text", "rejected_rating"]
    ends = rejected.groupBy(*by).agg(F.min("rejected").alias("_least"), F.max("rejected").alias("_most"))
    wide = chosen.join(ends, "query_text").withColumn("gap", F.col("chosen_rating") - F.col("rejected_rating")).filter((F.col("gap") >= gap) & ((F.col("_least") != F.col("chosen")) | (F.col("_most") != F.col("chosen"))))
    wide = F.broadcast(materialize(wide.drop("_least", "_most").orderBy(F.desc("gap"), "chosen_id").limit(limit), "widest"))  # ``limit`` rows
    first = lambda rows, most, *own: rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, *own).orderBy("rejected_id"))).filter(F.col("_rank") <= most).drop("_rank")
    met = first(rejected.join(wide, by, "left_semi"), limit, "rejected")
    met = first(first(met.withColumn("_part", F.pmod(F.xxhash64("rejected_id"), F.lit(64))), 2 * limit, "_part"), 2 * limit)  # in parts, so that no task sorts a query text whole
    return met.join(wide, by).filter("chosen <> rejected").drop("_part").orderBy(F.desc("gap"), "chosen_id", "rejected_id").limit(limit)


def correction_pairs(feedback: DataFrame, most: int = 3) -> DataFrame:
    """Corrections of answers rated at most ``most``: the correction is chosen, the answer rejected."""
    return feedback.filter(F.col("correction_text").isNotNull() & (F.col("rating") <= most)).select("feedback_id", F.col("query_text").alias("prompt"), F.col("correction_text").alias("chosen"), F.col("response_text").alias("rejected"))


def dedup_examples(examples: DataFrame, text: Column, order: list[str]) -> DataFrame:
    """The first example, in order, of each lower-cased trimmed text."""
    rank = F.row_number().over(Window.partitionBy(F.md5(F.lower(F.trim(text)).cast("binary"))).orderBy(*order))
    return examples.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def first_messages(messages: DataFrame) -> DataFrame:
    """The earliest message of each session, role and content."""
    rank = F.row_number().over(Window.partitionBy("session_id", "role", "content").orderBy("ts", "seq"))
    return messages.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def session_overview(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with their number of messages and the last message's time; without messages 0 and the start."""
    counts = messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.max("ts").alias("last"))
    joined = sessions.join(counts, "session_id", "left")
    return joined.withColumns({"messages": F.coalesce("messages", F.lit(0)), "last": F.coalesce("last", "started")})


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """All rows of a key that are first in the order; ties stay."""
    return rows.withColumn("_rank", F.rank().over(Window.partitionBy(key).orderBy(*order))).filter("_rank = 1").drop("_rank")


def split(rows: DataFrame, key: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """Adds ``split``: bands of a hash of the key, so that a row stays in its part when others come and go."""
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    low, bands = 0.0, []
    for name, share in shares.items():
        bands.append((low, name))
        low += share
    return rows.withColumn("split", banded(digest, bands[::-1], bands[0][1]))

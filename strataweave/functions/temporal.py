"""Time-dependent relevance and confidence arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import rules


def lookup(key: Column, values: Mapping[str, float], default: float) -> Column:
    out = None
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)) if out is None else out.when(key == name, F.lit(value))
    return out.otherwise(F.lit(default))


def decay_rate(entity_type: Column) -> Column:
    """Of the half-life: ln 2 over its hours."""
    return F.log(F.lit(2.0)) / lookup(entity_type, {k: v[0] for k, v in rules.DECAY.items()}, rules.DEFAULT_DECAY[0])


def decay_floor(entity_type: Column) -> Column:
    """Least score of a type, however old."""
    return lookup(entity_type, {k: v[1] for k, v in rules.DECAY.items()}, rules.DEFAULT_DECAY[1])


def hours_since(ts: Column, ref: str | datetime) -> Column:
    return (F.lit(ref).cast("timestamp").cast("double") - ts.cast("timestamp").cast("double")) / 3600


def relevance(entity_type: Column, last: Column, count: Column, ref: str, boost: float = 0.3, most_boost: float = 1.0) -> Column:
    """max(floor, exp(-rate * hours)) * (1 + min(boost * ln(count + 1), most_boost)), at most 1; times after the reference count as now."""
    decayed = F.greatest(F.exp(-decay_rate(entity_type) * F.greatest(hours_since(last, ref), F.lit(0.0))), decay_floor(entity_type))
    return F.least(decayed * (1 + F.least(boost * F.log1p(count), F.lit(most_boost))), F.lit(1.0))


def relevance_category(score: Column) -> Column:
    return F.when(score >= 0.8, "current").when(score >= 0.5, "recent").when(score >= 0.2, "fading").otherwise("stale")


def hours_until(entity_type: Column, target: float) -> Column:
    """Hours after which decay alone reaches the target; infinity where the type's floor is not below it."""
    return F.when(decay_floor(entity_type) >= target, F.lit(float("inf"))).otherwise(-F.log(F.lit(target)) / decay_rate(entity_type))


def freshness(ts: Column, ref: str, days: int = 7) -> Column:
    """recent or stale; null and unparsable times are stale."""
    return F.when(hours_since(F.try_to_timestamp(ts.cast("string")), ref) <= days * 24, "recent").otherwise("stale")


def decayed_confidence(confidence: Column, steps: Column, rate: float = 0.9, floor: float = 0.1) -> Column:
    """After so many propagation steps, not below the floor."""
    return F.greatest(confidence * F.pow(F.lit(rate), steps), F.lit(floor))


def blended(neural: Column, symbolic: Column, weight: float) -> Column:
    return F.coalesce(neural * weight + symbolic * (1 - weight), neural, symbolic)


def layer_adjusted(confidence: Column, layer: Column) -> Column:
    return confidence * lookup(layer, rules.LAYER_WEIGHTS, 0.5)


def resolve_layers(a_layer: Column, a: Column, b_layer: Column, b: Column, gap: float = 0.3) -> Column:
    """Which of two layers' answers holds: with a gap the higher adjusted confidence, else the higher layer."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, rules.LAYERS)), c)
    x, y = layer_adjusted(a, a_layer), layer_adjusted(b, b_layer)
    return F.when(F.abs(x - y) > gap, F.when(x > y, a_layer).otherwise(b_layer)).otherwise(F.when(rank(a_layer) >= rank(b_layer), a_layer).otherwise(b_layer))


def day_bucket(last: Column, now: Column) -> Column:
    """today, yesterday, this_week or older, by calendar days; null is older."""
    gap = F.datediff(now.cast("date"), last.cast("date"))
    return F.when(gap <= 0, "today").when(gap <= 1, "yesterday").when(gap <= 7, "this_week").otherwise("older")


def elapsed_bucket(last: Column, now: Column) -> Column:
    """today, yesterday, this_week, this_month or older, by whole days that have passed; what lies ahead is this_week, null is older."""
    days = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / 86_400_000_000)
    return F.when(days == 0, "today").when(days == 1, "yesterday").when(days <= 7, "this_week").when(days <= 30, "this_month").otherwise("older")

"""Rules over subject records (subject_id, arrays of medications, conditions, allergies, symptoms), by joins with rule tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules


def _terms(subjects: DataFrame, column: str, name: str) -> DataFrame:
    return subjects.select("subject_id", F.explode(F.transform(column, F.lower)).alias(name)).distinct()


def _table(subjects: DataFrame, rows: Sequence, schema: str) -> DataFrame:
    return F.broadcast(subjects.sparkSession.createDataFrame(list(rows), schema))  # rule tables are fixed


def alerts(subjects: DataFrame) -> DataFrame:
    """subject_id, rule, detail, severity, confidence: drug pairs, drugs with conditions, cross reactions, symptom patterns, in any case."""
    drugs = _terms(subjects, "medications", "drug")
    pair = _table(subjects, rules.DRUG_PAIRS, "drug string, other string, severity string")
    pairs = drugs.join(pair, "drug").join(drugs.withColumnRenamed("drug", "other"), ["subject_id", "other"]).select("subject_id", F.lit("drug_pair").alias("rule"), F.concat_ws("+", "drug", "other").alias("detail"), "severity", F.lit(1.0).alias("confidence"))
    condition = _table(subjects, rules.DRUG_CONDITIONS, "drug string, condition string, severity string")
    conditions = drugs.join(condition, "drug").join(_terms(subjects, "conditions", "condition"), ["subject_id", "condition"]).select("subject_id", F.lit("drug_condition"), F.concat_ws("+", "drug", "condition"), "severity", F.lit(1.0))
    reaction = _table(subjects, rules.CROSS_REACTIONS, "allergen string, drug string, severity string")
    reactions = _terms(subjects, "allergies", "allergen").join(reaction, "allergen").join(drugs, ["subject_id", "drug"]).select("subject_id", F.lit("cross_reaction"), F.concat_ws("+", "allergen", "drug"), "severity", F.lit(1.0))
    pattern = _table(subjects, [(name, severity, x, len(s), least) for name, severity, s, least in rules.SYMPTOM_PATTERNS for x in s], "pattern string, severity string, symptom string, size int, least int")
    told = _terms(subjects, "symptoms", "told").join(pattern, F.expr("contains(told, symptom)"))  # a rule's words inside what was told
    hits = told.groupBy("subject_id", "pattern", "severity", "size", "least").agg(F.count_distinct("symptom").alias("n"))
    patterns = hits.filter("n >= least").select("subject_id", F.lit("symptom_pattern"), "pattern", "severity", F.round(F.least(F.lit(1.0), F.col("n") / F.col("size")), 6))
    return pairs.union(conditions).union(reactions).union(patterns)


def contraindications(subjects: DataFrame, known: Sequence[tuple[str, str]] = rules.CONTRAINDICATED) -> DataFrame:
    """subject_id, kind, detail: a medication that contains an allergy's name, and known pairs in either order."""
    drugs = _terms(subjects, "medications", "drug")
    allergic = drugs.join(_terms(subjects, "allergies", "allergy"), "subject_id").filter("contains(lower(drug), lower(allergy))").select("subject_id", F.lit("allergy").alias("kind"), F.col("drug").alias("detail"))
    pair = _table(subjects, [tuple(sorted(p)) for p in known], "a string, b string")
    both = drugs.toDF("subject_id", "a").join(pair, "a").join(drugs.toDF("subject_id", "b"), ["subject_id", "b"]).select("subject_id", F.lit("pair"), F.concat_ws("+", "a", "b"))
    return allergic.union(both)


def subject_view(subjects: DataFrame, key: str, satellites: Mapping[str, DataFrame], ref: str, days: int = 30) -> DataFrame:
    """One row a subject, with a struct for each satellite (key, name, status, at): sorted names that are active (no status, active or chronic),
    resolved, and seen within ``days`` before the reference time (recent) or not (historical).

    Each satellite is gathered by itself first, so that nothing is multiplied. A subject's names are bounded by its own records.
    """
    out = subjects.select(key).distinct()
    since = F.lit(ref).cast("timestamp") - F.expr(f"interval {days} days")
    names = lambda condition: F.array_sort(F.collect_set(F.when(condition, F.col("name"))))
    none = F.array().cast("array<string>")
    for name, rows in satellites.items():
        active = F.col("status").isNull() | F.col("status").isin("active", "chronic")
        recent = F.coalesce(F.col("at").cast("timestamp") >= since, F.lit(False))
        one = rows.groupBy(F.col(key).alias("_key")).agg(F.struct(names(active).alias("active"), names(F.col("status") == "resolved").alias("resolved"), names(recent).alias("recent"), names(~recent).alias("historical")).alias(name))
        out = out.join(one, F.col(key) == F.col("_key"), "left").drop("_key")
        empty = F.struct(*(none.alias(x) for x in ("active", "resolved", "recent", "historical")))
        out = out.withColumn(name, F.coalesce(F.col(name), empty))
    return out


def rule_table(spark: SparkSession) -> DataFrame:
    """The two-sided rules as a table (rule, category, a, b, severity, active), to add to, to switch and to list by category."""
    parts = (("drug_pair", rules.DRUG_PAIRS), ("drug_condition", rules.DRUG_CONDITIONS), ("cross_reaction", rules.CROSS_REACTIONS))
    rows = [(f"{a}+{b}", category, a, b, severity, True) for category, table in parts for a, b, severity in table]
    return spark.createDataFrame(rows, "rule string, category string, a string, b string, severity string, active boolean")


def with_rule(table: DataFrame, a: str, b: str, category: str, severity: str) -> DataFrame:
    """A rule table with one more rule; one of the same name is replaced."""
    one = table.sparkSession.createDataFrame([(f"{a}+{b}", category, a.lower(), b.lower(), severity, True)], table.schema)
    return table.filter(F.col("rule") != f"{a}+{b}").union(one)


def switched(table: DataFrame, names: Sequence[str], active: bool) -> DataFrame:
    return table.withColumn("active", F.when(F.col("rule").isin(*names), active).otherwise(F.col("active")))


def drug_alerts(subjects: DataFrame, table: DataFrame) -> DataFrame:
    """subject_id, rule of the active drug pairs that a subject takes."""
    drugs = _terms(subjects, "medications", "drug")
    pairs = F.broadcast(table.filter("active and category = 'drug_pair'").select("rule", "a", "b"))  # rule tables are fixed
    return drugs.toDF("subject_id", "a").join(pairs, "a").join(drugs.toDF("subject_id", "b"), ["subject_id", "b"]).select("subject_id", "rule")

"""Filters and flags over nodes: projections that Spark pushes to the scan, and rule joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules


def literal_map(values: Mapping[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def has_label(labels: Sequence[str], column: str = "labels") -> Column:
    return F.arrays_overlap(column, F.array(*map(F.lit, labels)))


def is_structural(labels: Sequence[str] = rules.STRUCTURAL_LABELS) -> Column:
    return F.coalesce(has_label(labels), F.lit(False))


def mark_structural(nodes: DataFrame, labels: Sequence[str] = rules.STRUCTURAL_LABELS) -> DataFrame:
    """Adds ``is_structural``: any label is in the set."""
    return nodes.withColumn("is_structural", is_structural(labels))


def structural_counts(nodes: DataFrame, labels: Sequence[str] = rules.STRUCTURAL_LABELS) -> DataFrame:
    """Dry run: structural nodes by each of their structural labels."""
    return nodes.filter(is_structural(labels)).select(F.explode("labels").alias("label")).filter(F.col("label").isin(*labels)).groupBy("label").count()


def noise_reason(stopwords: Sequence[str] = rules.STOPWORDS, least: int = 3) -> Column:
    """Why a name is noise, or null: too short wins over being a stopword."""
    name = F.coalesce("name", F.lit(""))
    return F.when(F.length(name) < least, "short_name").when(F.lower(F.trim(name)).isin(*stopwords), "stopword")


def mark_noise(nodes: DataFrame, **settings) -> DataFrame:
    """Adds ``noise_reason`` to nodes that are not structural."""
    return nodes.withColumn("noise_reason", F.when(~is_structural(), noise_reason(**settings)))


def reset_flags(nodes: DataFrame, *flags: str) -> DataFrame:
    return nodes.withColumns({f: F.lit(None).cast(nodes.schema[f].dataType) for f in flags})


def knowledge(nodes: DataFrame, labels: Sequence[str] = tuple(x for x in rules.STRUCTURAL_LABELS if x != "ExtractedEntity")) -> DataFrame:
    """Nodes that are knowledge: neither excluded nor structural by a flag (is_structural, exclude_from_ontology, where the table has them) or by a label; extracted entities are knowledge."""
    marked = [F.coalesce(c, F.lit(False)) for c in ("is_structural", "exclude_from_ontology") if c in nodes.columns]
    return nodes.filter(~reduce(lambda a, b: a | b, marked, is_structural(labels)))


def invalid_layers(nodes: DataFrame, layers: Sequence[str] = rules.LAYERS) -> DataFrame:
    return nodes.filter(F.col("layer").isNotNull() & ~F.col("layer").isin(*layers))


def missing_type_or_layer(nodes: DataFrame) -> DataFrame:
    """Nodes without type, and nodes with a type but no layer, with what they miss."""
    missing = F.when(F.col("type").isNull(), "type").when(F.col("layer").isNull(), "layer")
    return nodes.withColumn("missing", missing).filter("missing is not null")


def low_confidence(nodes: DataFrame, least: Mapping[str, float] = rules.LAYER_MIN_CONFIDENCE) -> DataFrame:
    """Nodes below their layer's least confidence."""
    limits = F.coalesce(*(F.when(F.col("layer") == layer, limit) for layer, limit in least.items()))
    return nodes.withColumn("min_confidence", limits).filter("confidence < min_confidence")


def _rule_matches(nodes: DataFrame, table: Sequence[tuple], excluded: Mapping[str, Sequence[str]]) -> DataFrame:
    """(id, layer, priority, step, canonical_type, target_layer) of each rule that a node's type or one of its labels meets."""
    spark = nodes.sparkSession
    rows = [(i, step, kind, v, canonical, layer, list(excluded.get(step, ()))) for i, (step, canonical, layer, types, labels) in enumerate(table, 1) for kind, values in (("type", types), ("label", labels)) for v in values]
    known = F.broadcast(spark.createDataFrame(rows, "priority int, step string, kind string, value string, canonical_type string, target_layer string, _not array<string>"))
    values = F.array(F.struct(F.lit("type").alias("kind"), F.col("type").alias("value")))
    values = F.concat(values, F.transform("labels", lambda x: F.struct(F.lit("label").alias("kind"), x.alias("value"))))
    found = nodes.select("id", "layer", "labels", F.explode(values).alias("v")).select("id", "layer", "labels", "v.*").join(known, ["kind", "value"])
    return found.filter(~F.arrays_overlap("labels", "_not"))


def canonicalize(nodes: DataFrame, table: Sequence[tuple] = rules.CANONICAL_TYPES, excluded: Mapping[str, Sequence[str]] = rules.NOT_CANONICAL) -> DataFrame:
    """id, step, canonical_type, layer by the first matching rule: one pass in place of one update a rule. A layer that is set stays."""
    best = _rule_matches(nodes, table, excluded).groupBy("id").agg(F.min(F.struct("priority", "step", "canonical_type", F.coalesce("layer", "target_layer").alias("layer"))).alias("r"))
    return best.select("id", "r.step", "r.canonical_type", "r.layer")


def canonicalize_dry_run(nodes: DataFrame, edges: DataFrame, table: Sequence[tuple] = rules.CANONICAL_TYPES, excluded: Mapping[str, Sequence[str]] = rules.NOT_CANONICAL) -> DataFrame:
    """step, n: nodes that each step alone would touch on the graph as it is, not first-match; 0 where a step finds none.

    Beside the rules: conversations to mark as structural, types to infer from labels, reviews to ask for, orphans to flag.
    """
    spark = nodes.sparkSession
    plain = ~is_structural()
    review = plain & noise_reason().isNull()
    touched = F.explode(F.array_compact(F.array(
        F.when(has_label(rules.CONVERSATION_LABELS), "conversation_structural"), F.when(F.col("type").isNull() & plain & has_label(rules.INFERRING_LABELS), "null_type_inference"),
        F.when(F.col("type").isNull() & review, "null_type_review"), F.when(F.col("type").isin("Unknown", "unknown") & review, "unknown_type_review"),
    )))
    linked = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    orphans = nodes.filter(plain & F.col("id").isNotNull()).join(linked, "id", "left_anti").select("id", F.lit("orphan_flagging").alias("step"))
    found = _rule_matches(nodes, table, excluded).select("id", "step").union(nodes.select("id", touched.alias("step"))).union(orphans)
    steps = [*(r[0] for r in table), "conversation_structural", "null_type_inference", "null_type_review", "unknown_type_review", "orphan_flagging"]
    counts = found.groupBy("step").agg(F.count_distinct("id").alias("n"))
    return F.broadcast(spark.createDataFrame([(x,) for x in steps], "step string")).join(counts, "step", "left").fillna(0, ["n"])


def infer_type(nodes: DataFrame, labels: Sequence[str]) -> DataFrame:
    """For nodes without type: the first of their labels that is known, lower-cased."""
    known = F.array(*map(F.lit, labels))
    first = F.try_element_at(F.filter("labels", lambda x: F.array_contains(known, x)), F.lit(1))
    return nodes.filter("type is null").withColumn("inferred_type", F.lower(first))


def review_reasons(nodes: DataFrame) -> DataFrame:
    """Nodes to review: no type, or type Unknown."""
    reason = F.when(F.col("type").isNull(), "null_type").when(F.lower("type") == "unknown", "unknown_type")
    return nodes.withColumn("review_reason", reason).filter("review_reason is not null")


def normalized_type(kind: Column, aliases: Mapping[str, str] = rules.TYPE_ALIASES) -> Column:
    """A type lower-cased with blanks and hyphens as underscores, or what that is an alias of."""
    plain = F.lower(F.trim(F.translate(kind, "- ", "__")))
    return F.coalesce(F.try_element_at(literal_map(aliases), plain), plain)


def normalize_types(mapped: DataFrame, aliases: Mapping[str, str] = rules.TYPE_ALIASES) -> DataFrame:
    """Rows (type, canonical_type, ..) whose canonical type is not their type's normalized form, with that form in its place."""
    fixed = normalized_type(F.col("type"), aliases)
    return mapped.filter(F.col("type").isNotNull() & F.col("canonical_type").isNotNull() & (fixed != F.col("canonical_type"))).withColumn("canonical_type", fixed)


def dismiss(nodes: DataFrame, ids: DataFrame, undo: bool = False) -> DataFrame:
    """Adds ``dismissed``: set, or with undo unset, for the listed ids."""
    marked = nodes.join(ids.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left")
    return marked.withColumn("dismissed", F.col("_id").isNotNull() & F.lit(not undo)).drop("_id")


def search(nodes: DataFrame, text: str, types: Sequence[str] | None = None, limit: int = 50) -> DataFrame:
    """Nodes whose name, or description where there is such a column, contains the text in any case; the first by name and id."""
    said = F.concat_ws("\n", *(F.lower(c) for c in ("name", "description") if c in nodes.columns))
    found = nodes.filter(said.contains(text.lower()))
    if types:
        found = found.filter(F.col("type").isin(*types))
    return found.orderBy("name", "id").limit(limit)


def text_tags(text: Column) -> Column:
    """Tags that a text's words suggest, in fixed order."""
    t = F.lower(text)
    return F.array_compact(F.array(
        F.when(t.rlike("email|phone|ssn|password|address"), "PII"), F.when(t.rlike("patient|health|medical|disease"), "HEALTH"), F.when(t.rlike("customer|client|order"), "CUSTOMER"),
    ))


def violations(table: DataFrame, governance: Sequence[tuple[str, str, str]], id_column: str = "id") -> DataFrame:
    """(id, rule, message) for each rule (name, SQL condition that must hold, message) that a row breaks, in one pass."""
    checks = F.array(*(F.when(~F.coalesce(F.expr(condition), F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(message).alias("message"))) for name, condition, message in governance))
    return table.select(id_column, F.explode(F.array_compact(checks)).alias("v")).select(id_column, "v.*")


def erase_subject(nodes: DataFrame, edges: DataFrame, subject: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the subject, its direct neighbours, and their edges."""
    touched = edges.filter((F.col("src") == subject) | (F.col("dst") == subject))
    gone = touched.select(F.explode(F.array("src", "dst")).alias("id")).union(nodes.filter(F.col("id") == subject).select("id")).distinct()
    return nodes.join(gone, "id", "left_anti"), edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti")


def drop_layer(nodes: DataFrame, labels: Sequence[str]) -> DataFrame:
    return nodes.withColumn("layer", F.when(~has_label(labels), F.col("layer")))


def promotion_candidates(nodes: DataFrame, edges: DataFrame, confidence: float = 0.9, references: int = 5, limit: int | None = None) -> DataFrame:
    """Nodes of the two lower layers that qualify for the next one, with the trigger; best confidence first."""
    degree = edges.groupBy(F.col("dst").alias("_dst")).agg(F.count("*").alias("references"))
    joined = nodes.join(degree, F.col("id") == F.col("_dst"), "left").withColumn("references", F.coalesce("references", F.lit(0)).cast("long"))
    low, middle = F.col("layer") == "PERCEPTION", F.col("layer") == "SEMANTIC"
    trigger = F.when(low & (F.col("confidence") >= confidence), "confidence").when(low & (F.col("observation_count") >= 10), "observations").when(middle & (F.col("references") >= references), "references")
    found = joined.withColumn("trigger", trigger).filter("trigger is not null").drop("_dst")
    return found.orderBy(F.desc("confidence"), "id").limit(limit) if limit else found


def unmapped(nodes: DataFrame, known: Sequence[str]) -> DataFrame:
    """Types of nodes without any known label, with counts."""
    return nodes.filter(~has_label(known)).groupBy("type").agg(F.count("*").alias("n"))


def active(records: DataFrame, states: Sequence[str] = ("active", "chronic")) -> DataFrame:
    return records.filter(F.col("status").isNull() | F.col("status").isin(*states))


def required_flags(nodes: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows that miss a required column, with one flag for each."""
    flagged = nodes.withColumns({f"has_{c}": F.col(c).isNotNull() for c in required})
    return flagged.filter(reduce(lambda a, b: a | b, (~F.col(f"has_{c}") for c in required)))


def training_batch(feedback: DataFrame, limit: int, batch_id: str) -> DataFrame:
    """The oldest feedback rows that no training has used, stamped with a batch id."""
    unused = feedback.filter(~F.coalesce("used_for_training", F.lit(False)))
    return unused.orderBy("created_at", "feedback_id").limit(limit).withColumn("batch_id", F.lit(batch_id))


def search_sessions(sessions: DataFrame, messages: DataFrame, text: str, exact: bool = False, limit: int | None = None) -> DataFrame:
    """Sessions (session_id, title, last_activity) whose title or any message contains the text, with matches and message_count.

    In any case, latest activity first; ``exact``: letter by letter, most matches first, and sessions without messages stay out. A title that contains the text makes every message of the session a match.
    Ties go to the smaller id. Messages are counted a session before the join.
    """
    held = lambda c: F.coalesce(F.contains(c, F.lit(text)) if exact else F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    counts = messages.groupBy("session_id").agg(F.count("*").alias("message_count"), F.count_if(held(F.col("content"))).alias("_hits"))
    rows = sessions.join(counts, "session_id", "inner" if exact else "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))
    rows = rows.filter(held(F.col("title")) | (F.col("_hits") > 0))
    rows = rows.withColumn("matches", F.when(held(F.col("title")), F.col("message_count")).otherwise(F.col("_hits"))).drop("_hits")
    return rows if limit is None else rows.orderBy(F.desc("matches" if exact else "last_activity"), "session_id").limit(limit)

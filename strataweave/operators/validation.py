"""Validation of entities, relationships and layer transitions; promotion between layers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules


def validate_entities(entities: DataFrame, layers: Sequence[str] = rules.LAYERS, longest_id: int = 100, longest_value: int = 1000) -> DataFrame:
    """id, errors, warnings (comma-separated codes), is_valid of (id, labels, layer, properties as a map of texts).

    Errors: a missing id, a missing or unknown layer. Warnings: ids that are long, hold blanks or special characters or stand for nothing;
    blank, reserved, null and oversized properties; another layer than the labels suggest; what a layer's nodes should have.
    """
    key, props = F.coalesce("id", F.lit("")), F.coalesce("properties", F.create_map().cast("map<string,string>"))
    keys, values = F.map_keys(props), F.map_values(props)
    has = lambda names: F.arrays_overlap(keys, F.array(*map(F.lit, names)))
    expected = F.get(F.filter(F.transform("labels", lambda x: F.coalesce(*(F.when(x.isin(*names), layer) for layer, names in rules.LAYER_LABELS.items()))), lambda x: x.isNotNull()), F.lit(0))
    confidence, layer = F.try_element_at(props, F.lit("confidence")).try_cast("double"), F.col("layer")
    errors = F.array_compact(F.array(
        F.when(key == "", "missing_id"), F.when(F.coalesce("layer", F.lit("")) == "", "no_layer").when(~layer.isin(*layers), "bad_layer"),
    ))
    warnings = F.array_compact(F.array(
        F.when(F.length(key) > longest_id, "long_id"), F.when(key.contains(" "), "blank_in_id"), F.when(F.lower(key).isin(*rules.EMPTY_IDS), "empty_id"), F.when(key.rlike(r"[<>\"'&|;()\[\]{}]"), "special_in_id"),
        F.when(F.exists(keys, lambda k: F.trim(k) == ""), "blank_property"), F.when(F.exists(keys, lambda k: F.lower(k).isin(*rules.RESERVED_PROPERTIES)), "reserved_property"),
        F.when(F.exists(values, lambda v: v.isNull()), "null_property"), F.when(F.exists(values, lambda v: F.length(v) > longest_value), "large_property"),
        F.when(layer.isin(*layers) & (layer != expected), "unusual_layer"),
        F.when(layer == "REASONING", F.when(confidence.isNull(), "no_confidence").when(~confidence.between(0, 1), "bad_confidence")),
        *(F.when((layer == x) & ~has(names), f"no_{names[0]}") for x, names in rules.LAYER_PROPERTIES.items()),
    ))
    return entities.select("id", F.array_join(errors, ",").alias("errors"), F.array_join(warnings, ",").alias("warnings"), (F.size(errors) == 0).alias("is_valid"))


def validate_relationships(edges: DataFrame, permissions: Mapping[str, Sequence[str]], role: str) -> DataFrame:
    """src, rel_type, dst, errors, is_valid for what a role may write."""
    errors = F.array_compact(F.array(
        F.when(F.col("src").isNull() | F.col("dst").isNull(), "missing_end"), F.when(~F.col("rel_type").rlike("^[A-Z][A-Z_]*$"), "bad_type"),
        F.when(~F.col("rel_type").isin(*permissions.get(role, ())), "not_permitted"), F.when(F.col("src") == F.col("dst"), "self_loop"),
    ))
    return edges.select("src", "rel_type", "dst", F.array_join(errors, ",").alias("errors"), (F.size(errors) == 0).alias("is_valid"))


def summary(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"))


def pass_rates(rows: DataFrame, checks: Mapping[str, str]) -> DataFrame:
    """rule, passed share of each SQL condition, null as failed: one scan."""
    one = rows.agg(*(F.round(F.avg(F.coalesce(F.expr(c), F.lit(False)).cast("int")), 6).alias(name) for name, c in checks.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("passed")) for n in checks))).alias("r")).select("r.*")


def transition_errors(transitions: DataFrame, layers: Sequence[str] = rules.LAYERS, required: Mapping[str, Sequence[str]] = rules.LAYER_REQUIREMENTS) -> DataFrame:
    """Adds errors to (from_layer, to_layer, properties as a map of texts, ..): downward moves, properties that the target layer needs, confidence out of range."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, layers)), F.col(c))
    value = lambda name: F.coalesce(F.try_element_at("properties", F.lit(name)), F.lit(""))
    missing = [F.when((F.col("to_layer") == layer) & (value(name) == ""), f"missing_{name}") for layer, names in required.items() for name in names]
    confidence = value("confidence").try_cast("double")
    errors = F.array_compact(F.array(F.when(rank("to_layer") < rank("from_layer"), "downward"), *missing, F.when((F.col("to_layer") == "REASONING") & ~confidence.between(0, 1), "bad_confidence")))
    return transitions.withColumn("errors", F.array_join(errors, ","))


def hierarchy_problems(hierarchy: DataFrame) -> DataFrame:
    """id, problem of (child, parent): a concept that is its own parent, or whose name starts no capital."""
    problem = F.when(F.col("child") == F.col("parent"), "self").when(F.col("child") == F.lower("child"), "lower_case")
    return hierarchy.select(F.col("child").alias("id"), problem.alias("problem")).filter("problem is not null")


def ontology_match(name: Column, entity_type: Column, names: Sequence[str] = rules.ONTOLOGY_NAMES, types: Sequence[str] = rules.ONTOLOGY_TYPES) -> Column:
    """exact, partial (one name holds the other), semantic (by type alone) or none."""
    known, plain = F.array(*map(F.lit, names)), F.lower(F.coalesce(name, F.lit("")))
    return F.when(F.array_contains(known, plain), "exact").when(F.exists(known, lambda k: F.contains(plain, k) | F.contains(k, plain)), "partial").when(entity_type.isin(*types), "semantic").otherwise("none")


def risk_level(entity_type: Column) -> Column:
    return F.when(entity_type.isin(*rules.LOW_RISK), "low").when(entity_type.isin(*rules.HIGH_RISK), "high").otherwise("medium")


def promotion_gate(candidates: DataFrame, table: Sequence[tuple] = rules.PROMOTION, least_sources: int = rules.LEAST_SOURCES) -> DataFrame:
    """id, risk, decision, failed of (id, name, entity_type, layer, target_layer, confidence, observation_count, first_observed, last_observed, sources).

    Each transition has criteria of its own. All passed: approved, or pending_review where the type is risky and the transition asks for it; else rejected
    with the criteria that failed. Other transitions are rejected as invalid. Nulls: confidence 0, one observation, no stability, one source.
    """
    spark = candidates.sparkSession
    known = F.broadcast(spark.createDataFrame([tuple(r) for r in table], "_from string, _to string, _confidence double, _observations int, _hours double, _sources boolean, _review boolean"))
    joined = candidates.join(known, (F.col("layer") == F.col("_from")) & (F.col("target_layer") == F.col("_to")), "left")
    stable = (F.col("last_observed").cast("timestamp").cast("double") - F.col("first_observed").cast("timestamp").cast("double")) / 3600
    failed = F.array_compact(F.array(
        F.when(F.col("_from").isNull(), "transition"), F.when(F.coalesce("confidence", F.lit(0.0)) < F.col("_confidence"), "confidence"), F.when(F.coalesce("observation_count", F.lit(1)) < F.col("_observations"), "observation_count"),
        F.when((F.col("_hours") > 0) & ~F.coalesce(stable >= F.col("_hours"), F.lit(False)), "temporal_stability"), F.when(F.col("_sources") & (F.coalesce("sources", F.lit(1)) < least_sources), "multi_source"),
        F.when(F.col("_from").isNotNull() & (ontology_match(F.col("name"), F.col("entity_type")) == "none"), "ontology_match"),
    ))
    risk = risk_level(F.col("entity_type"))
    decision = F.when(F.size(failed) > 0, "rejected").when((risk == "high") & F.col("_review"), "pending_review").otherwise("approved")
    return joined.select("id", risk.alias("risk"), decision.alias("decision"), F.array_join(failed, ",").alias("failed"))


def automatic_target(thresholds: Mapping[str, tuple[float, int]] = rules.AUTOMATIC_PROMOTION) -> Column:
    """The layer that an entity rises to by itself, or null, of (layer, confidence, validation_count, ontology_codes, inference_rules, reference_count).

    Perception rises by confidence, validations or any ontology code; semantic by confidence, any inference rule that fired or references. One of them is enough; nulls count as nothing.
    """
    (sure, validations), (surer, references) = thresholds["PERCEPTION"], thresholds["SEMANTIC"]
    value = lambda c: F.coalesce(F.col(c), F.lit(0))
    some = lambda c: F.coalesce(F.size(F.col(c)) > 0, F.lit(False))
    seen = (value("confidence") >= sure) | (value("validation_count") >= validations) | some("ontology_codes")
    meant = (value("confidence") >= surer) | some("inference_rules") | (value("reference_count") >= references)
    return F.when((F.col("layer") == "PERCEPTION") & seen, "SEMANTIC").when((F.col("layer") == "SEMANTIC") & meant, "REASONING")


def promote(nodes: DataFrame, approved: DataFrame, layers: Sequence[str] = rules.LAYERS, defaults: Mapping[str, Mapping[str, str]] = rules.LAYER_DEFAULTS) -> DataFrame:
    """Nodes (id, name, layer, properties as a map of texts, ..) with approved ids one layer up: version 2, the old layer kept in promoted_from.

    A promoted node gets what the new layer's nodes have by default where it has nothing; in the semantic layer its name describes it.
    """
    ids = approved.select(F.col("id").alias("_id")).distinct()
    following = F.coalesce(*(F.when(F.col("layer") == a, b) for a, b in zip(layers, layers[1:])))
    hit = F.col("_id").isNotNull() & following.isNotNull()
    joined = nodes.join(ids, F.col("id") == F.col("_id"), "left")
    fill = None
    for layer, values in defaults.items():
        given = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
        if layer == "SEMANTIC":
            given = F.map_concat(given, F.create_map(F.lit("description"), F.coalesce("name", F.lit("Auto-promoted entity"))))
        fill = F.when(following == layer, given) if fill is None else fill.when(following == layer, given)
    own = F.coalesce("properties", F.create_map().cast("map<string,string>"))
    filled = F.map_concat(own, F.map_filter(fill, lambda k, v: ~F.array_contains(F.map_keys(own), k)))
    return joined.withColumns({
        "properties": F.when(hit, filled).otherwise(own), "promoted_from": F.when(hit, F.col("layer")), "layer": F.when(hit, following).otherwise(F.col("layer")), "version": F.when(hit, 2).otherwise(1),
    }).drop("_id")


def transitions(promoted: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Edges (src, rel_type, dst) from each promoted node's old version to the new one, and records (id, from_layer, to_layer, at)."""
    moved = promoted.filter("promoted_from is not null")
    edges = moved.select("id", F.lit("PROMOTED_TO").alias("rel_type"), F.concat_ws(":v", "id", "version").alias("dst")).withColumnRenamed("id", "src")
    return edges, moved.select("id", F.col("promoted_from").alias("from_layer"), F.col("layer").alias("to_layer"), F.lit(at).cast("timestamp").alias("at"))


def decide(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reviews with the state that decisions (id, approve) give them; others stay pending."""
    d = decisions.groupBy("id").agg(F.min("approve").alias("approve"))
    return reviews.join(d, "id", "left").withColumn("state", F.when(F.col("approve"), "approved").when(~F.col("approve"), "rejected").otherwise("pending")).drop("approve")


def alias_usage(aliases: DataFrame) -> DataFrame:
    """concept, alias (lower-cased), usage: repeated aliases of a concept count up."""
    return aliases.groupBy("concept", F.lower(F.trim("alias")).alias("alias")).agg(F.sum("usage").alias("usage"))


def merge_concepts(aliases: DataFrame, merges: DataFrame) -> DataFrame:
    """concept, alias, usage after merges (source, target): aliases and their usage move, equal ones are added up."""
    moves = merges.groupBy(F.col("source").alias("concept")).agg(F.min("target").alias("_target"))
    moved = aliases.join(moves, "concept", "left").withColumn("concept", F.coalesce("_target", "concept"))
    return alias_usage(moved)


def concept_states(concepts: DataFrame, merges: DataFrame) -> DataFrame:
    """concept, state (active or deprecated), replaced_by."""
    moves = merges.groupBy(F.col("source").alias("concept")).agg(F.min("target").alias("replaced_by"))
    return concepts.select("concept").distinct().join(moves, "concept", "left").withColumn("state", F.when(F.col("replaced_by").isNull(), "active").otherwise("deprecated"))


def registry_statistics(nodes: DataFrame, table: Sequence[tuple] = rules.CANONICAL_TYPES, aliases: Mapping[str, str] = rules.TYPE_ALIASES) -> DataFrame:
    """layer, types, aliases, used: the registry's types by layer, with their aliases and the nodes that have them as they are."""
    spark = nodes.sparkSession
    registry = spark.createDataFrame([(r[1], r[2]) for r in {x[1]: x for x in table}.values()], "canonical string, layer string")
    named = spark.createDataFrame(list(aliases.items()), "alias string, canonical string").groupBy("canonical").agg(F.count("*").alias("aliases"))
    used = nodes.filter("type is not null").groupBy(F.lower("type").alias("canonical")).agg(F.count("*").alias("used"))
    joined = registry.join(named, "canonical", "left").join(used, "canonical", "left").fillna(0, ["aliases", "used"])
    return joined.groupBy("layer").agg(F.count("*").alias("types"), F.sum("aliases").alias("aliases"), F.sum("used").alias("used"))

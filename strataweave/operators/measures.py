"""Measures of a graph's taxonomy, names, transitions and assessed documents; named views; layers by label; copies of sessions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ABBREVIATIONS, SYNONYMS, normalized_name
from . import rules
from .flags import is_structural
from .graph import hierarchy_depth, with_ends

#: Averages that ``quality_statistics`` gives.
QUALITY_SCORES = ("overall_score", "context_precision", "context_recall", "topic_coverage", "signal_to_noise", "entity_extraction_rate", "retrieval_quality")


def _column(rows: DataFrame, name: str, otherwise: Column) -> Column:
    return F.coalesce(F.col(name), otherwise) if name in rows.columns else otherwise


def valid_hierarchy(child: Column, parent: Column, pairs: Sequence[tuple[str, str]] = rules.HIERARCHY_PAIRS) -> Column:
    """Whether labels of a child and its parent share one or hold a pair of the table; false for null labels."""
    held = [F.array_contains(child, a) & F.array_contains(parent, b) for a, b in pairs]
    found = F.arrays_overlap(child, parent)
    for pair in held:
        found = found | pair
    return F.coalesce(found, F.lit(False))


def hierarchy_edges(edges: DataFrame, types: Sequence[str] = rules.HIERARCHY_TYPES) -> DataFrame:
    return edges.filter(F.col("rel_type").isin(*types) & F.col("src").isNotNull() & F.col("dst").isNotNull())


def taxonomy(nodes: DataFrame, edges: DataFrame, types: Sequence[str] = rules.HIERARCHY_TYPES) -> DataFrame:
    """One row: relationships, valid, invalid, coherence, orphans and their breakdown, max_depth, avg_depth, cyclic.

    Nodes are (id, labels), edges (src, rel_type, dst); an end that is no node has no labels, so its edge is not valid. Without a hierarchy coherence is 1. Orphans are nodes that are no structure: where a column ``is_orphan`` has values, the nodes that it marks, by ``orphan_source``
    (episodic, knowledge or else unclassified); otherwise the nodes without any edge. Depths are the longest way up of nodes that have a parent; nodes on or below a cycle have none and are counted as ``cyclic``.
    """
    links = hierarchy_edges(edges, types)
    ok = valid_hierarchy(F.col("_child"), F.col("_parent"))
    labelled = links.join(nodes.select(F.col("id").alias("src"), F.col("labels").alias("_child")), "src", "left").join(nodes.select(F.col("id").alias("dst"), F.col("labels").alias("_parent")), "dst", "left")
    counted = labelled.agg(F.count("*").alias("relationships"), F.count_if(ok).alias("valid"))
    depths = hierarchy_depth(links.select(F.col("src").alias("child"), F.col("dst").alias("parent")))
    deep = F.when(F.col("depth") > 0, F.col("depth"))
    measured = depths.agg(F.coalesce(F.max(deep), F.lit(0)).alias("max_depth"), F.round(F.coalesce(F.avg(deep), F.lit(0.0)), 6).alias("avg_depth"), F.count_if("cyclic").alias("cyclic"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("_linked", F.lit(True))
    flagged = _column(nodes, "is_orphan", F.lit(None).cast("boolean"))
    source = _column(nodes, "orphan_source", F.lit("unclassified"))
    rows = nodes.select("id", F.coalesce(is_structural(), F.lit(False)).alias("_structural"), (F.col("is_orphan") if "is_orphan" in nodes.columns else flagged).alias("_flag"), source.alias("_source"))
    rows = rows.join(ends, "id", "left").withColumn("_free", F.col("_linked").isNull() & F.col("id").isNotNull())
    mark = F.coalesce(F.col("_flag"), F.lit(False)) & ~F.col("_structural")
    known = F.col("_source").isin("episodic", "knowledge")
    orphans = rows.agg(
        F.count("_flag").alias("flags"), F.count_if(mark & (F.col("_source") == "episodic")).alias("e"), F.count_if(mark & (F.col("_source") == "knowledge")).alias("k"), F.count_if(mark & ~known).alias("u"),
        F.count_if(F.col("_free") & ~F.col("_structural")).alias("free"))
    either = lambda marked, free: F.when(F.col("flags") > 0, marked).otherwise(free)
    one = counted.join(measured, F.lit(True)).join(orphans, F.lit(True))  # a row each
    return one.select(
        "relationships", "valid", (F.col("relationships") - F.col("valid")).alias("invalid"), F.round(F.coalesce(F.try_divide("valid", "relationships"), F.lit(1.0)), 6).alias("coherence"),
        either(F.col("e") + F.col("k") + F.col("u"), F.col("free")).alias("orphans"), either(F.col("e"), F.lit(0)).alias("episodic"), either(F.col("k"), F.lit(0)).alias("knowledge"),
        either(F.col("u"), F.col("free")).alias("unclassified"), "max_depth", "avg_depth", "cyclic")


def _duplicate_keys(entities: DataFrame) -> DataFrame:
    """(key, n): simple forms of the names of typed entities that are no structure, not merged and not set aside."""
    kept = ~_column(entities, "dedup_skip", F.lit(False)) & (_column(entities, "merged_into", F.lit("")) == "") & ~_column(entities, "is_structural", F.lit(False))
    kept = kept & ~F.coalesce(is_structural(), F.lit(False)) & (F.coalesce("type", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != "")
    key = F.replace(F.replace(F.regexp_replace(F.lower("name"), r"(?U)^\s+|\s+$", ""), F.lit(" "), F.lit("_")), F.lit("-"), F.lit(""))
    return entities.filter(kept).groupBy(key.alias("key")).agg(F.count("*").alias("n"))


def duplicate_names(entities: DataFrame) -> DataFrame:
    """canonical_form, n of the simple forms (case, spaces and hyphens alone) that several entities share; counts alone, so a form of any size is one row."""
    return _duplicate_keys(entities).filter("n > 1").withColumnRenamed("key", "canonical_form")


def normalization(entities: DataFrame, abbreviations: Mapping[str, str] = ABBREVIATIONS, synonyms: Mapping[str, str] = SYNONYMS) -> DataFrame:
    """One row: total, canonical (names already in their form), normalized (others), abbreviation_hits, synonym_hits, rate, duplicates.

    Hits are names that hold a key of the table anywhere, in any case. Null and empty names count in ``total`` alone. Duplicates as in ``duplicate_names``.
    """
    name, low = F.coalesce("name", F.lit("")), F.lower("name")
    there, same = name != "", normalized_name(F.col("name"), abbreviations, synonyms) == F.replace(low, F.lit(" "), F.lit("_"))
    holds = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    one = entities.agg(
        F.count("*").alias("total"), F.count_if(there & same).alias("canonical"), F.count_if(there & ~same).alias("normalized"), F.count_if(there & holds(abbreviations)).alias("abbreviation_hits"),
        F.count_if(there & holds(synonyms)).alias("synonym_hits"))
    one = one.withColumn("rate", F.round(F.coalesce(F.try_divide(F.col("canonical") + F.col("normalized"), "total"), F.lit(0.0)), 6))
    return one.join(duplicate_names(entities).agg(F.count("*").alias("duplicates")), F.lit(True))


def transition_statistics(transitions: DataFrame) -> DataFrame:
    """kind, key, value: the number of transitions in all and by status, of completed ones by path, and their mean seconds from request to completion (0 without any).

    Rows are (from_layer, to_layer, status, requested_at, completed_at). Statuses that do not occur have 0; other statuses count in the total alone.
    """
    done = F.col("status") == "completed"
    seconds = F.when(done & F.col("completed_at").isNotNull(), F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("requested_at").cast("timestamp")))
    statuses = ("completed", "pending", "rejected", "failed")
    one = transitions.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in statuses), F.coalesce(F.avg(seconds) / 1e6, F.lit(0.0)).alias("mean_seconds"))
    row = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("key"), F.round(F.col(c).cast("double"), 6).alias("value"))
    fixed = one.select(F.explode(F.array(*(row("count", c) for c in ("total", *statuses)), row("mean", "mean_seconds"))).alias("r")).select("r.*")
    path = F.concat("from_layer", F.lit(" → "), "to_layer")
    return fixed.union(transitions.filter(done).groupBy(path.alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit("path"), "key", "value"))


def quality_statistics(assessments: DataFrame, scores: Sequence[str] = QUALITY_SCORES) -> DataFrame:
    """kind, key, value: assessments by level (null left out), the mean of each score (0 without any), and the number of documents."""
    one = assessments.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in scores), F.count_distinct("doc_id").alias("documents"))
    row = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("key"), F.round(F.col(c).cast("double"), 6).alias("value"))
    fixed = one.select(F.explode(F.array(*(row("average", c) for c in scores), row("count", "documents"))).alias("r")).select("r.*")
    levels = assessments.filter("level is not null").groupBy("level").agg(F.count("*").cast("double").alias("value"))
    return fixed.union(levels.select(F.lit("level"), "level", "value"))


def named_views(columns: DataFrame, nodes: DataFrame, edges: DataFrame, lineage: Sequence[str] = ("FLOWS_TO", "TRANSFORMS_INTO")) -> dict[str, DataFrame]:
    """pii_data: columns (name, table_name, classification, is_pii) that are personal; lineage: names along such edges; domain_summary: sets of labels in SEMANTIC with their number."""
    personal = columns.filter(F.coalesce(F.col("is_pii"), F.lit(False)) | F.coalesce(F.col("classification") == "PII", F.lit(False)))
    return {
        "pii_data": personal.select("name", "table_name", "classification"),
        "lineage": with_ends(edges.filter(F.col("rel_type").isin(*lineage)), nodes, "name").select(F.col("src_name").alias("source"), "rel_type", F.col("dst_name").alias("target")),
        "domain_summary": nodes.filter("layer = 'SEMANTIC'").groupBy(F.col("labels").alias("type")).agg(F.count("*").alias("n")),
    }


def migrate_layers(nodes: DataFrame, table: Mapping[str, Sequence[str]] = rules.LAYER_ASSIGNMENTS) -> DataFrame:
    """Nodes with layer, status, confidence and ``layer_assignment_method``: those without a layer get that of the first entry of the table that one of their labels is in, else PERCEPTION.

    By label, a missing confidence becomes 0.7 in PERCEPTION and 0.9 elsewhere; by default it stays. Nodes that have a layer are unchanged, and their method is null.
    """
    by_label = F.coalesce(*(F.when(F.arrays_overlap("labels", F.array(*map(F.lit, labels))), F.lit(layer)) for layer, labels in table.items()))
    bare, low = F.col("layer").isNull(), F.coalesce(F.col("_by"), F.lit("PERCEPTION")) == "PERCEPTION"
    rows = nodes.withColumn("_by", by_label)
    return rows.withColumns({
        "status": F.when(~bare, F.col("status")).otherwise(F.when(low, "pending_validation").otherwise("validated")),
        "confidence": F.when(bare & F.col("_by").isNotNull(), F.coalesce("confidence", F.when(low, 0.7).otherwise(0.9))).otherwise(F.col("confidence")),
        "layer_assignment_method": F.when(bare, F.when(F.col("_by").isNotNull(), "migration_by_label").otherwise("migration_default")),
        "layer": F.coalesce("layer", "_by", F.lit("PERCEPTION")),
    }).drop("_by")


_UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


def copy_sessions(sessions: DataFrame, messages: DataFrame, there: DataFrame, messages_there: DataFrame, full: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of sessions (session_id) and messages (message_id, session_id) to write into another store, and a summary (data, copied, known, bad_id, without_session).

    Ids that are no UUIDs are left out, and so are messages whose session neither is in the other store nor comes with this copy. A full copy writes known rows again, an incremental one leaves them out.
    """

    def judged(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
        marked = rows.join(known.select(F.col(key).alias("_key"), F.lit(True).alias("_known")).distinct(), F.col(key) == F.col("_key"), "left").drop("_key")
        bad = ~F.coalesce(F.col(key).rlike(_UUID), F.lit(False))
        return marked.withColumn("_state", F.when(bad, "bad_id").when(F.col("_known").isNotNull() & F.lit(not full), "known").otherwise("copied")).drop("_known")

    first = judged(sessions, "session_id", there)
    able = first.filter("_state = 'copied'").select("session_id").union(there.select("session_id")).distinct().select(F.col("session_id").alias("_session"), F.lit(True).alias("_able"))
    second = judged(messages, "message_id", messages_there).join(able, F.col("session_id") == F.col("_session"), "left")
    second = second.withColumn("_state", F.when((F.col("_state") != "bad_id") & F.col("_able").isNull(), "without_session").otherwise(F.col("_state"))).drop("_session", "_able")
    count = lambda rows, name: rows.agg(*(F.count_if(F.col("_state") == s).alias(s) for s in ("copied", "known", "bad_id", "without_session"))).select(F.lit(name).alias("data"), "*")
    chosen = lambda rows: rows.filter("_state = 'copied'").drop("_state")
    return chosen(first), chosen(second), count(first, "sessions").union(count(second, "messages"))

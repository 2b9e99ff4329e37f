"""Audit and quality measures of a graph, each in one pass where one pass is enough."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import ontology, rules
from .flags import has_label, is_structural, noise_reason
from .graph import banded, endpoints


def distribution(rows: DataFrame, value: Column, name: str = "value") -> DataFrame:
    return rows.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def display_type() -> Column:
    return F.coalesce("type", F.try_element_at("labels", F.lit(1)), F.lit("Unknown"))


def connection_by(nodes: DataFrame, edges: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Per key: nodes with and without edges."""
    ends = endpoints(edges).withColumn("_linked", F.lit(True))
    joined = nodes.join(ends, "id", "left")
    linked = F.col("_linked").isNotNull()
    return joined.groupBy(key.alias(name)).agg(F.count_if(linked).alias("connected"), F.count_if(~linked).alias("orphans"))


def shares(rows: DataFrame, key: str, top: int = 30) -> DataFrame:
    """The most frequent keys with their percent of what is listed."""
    listed = rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(top)
    return listed.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def top_degrees(edges: DataFrame, top: int = 50) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(top)


def directed_degrees(edges: DataFrame, top: int = 10) -> DataFrame:
    """id, outgoing, incoming, total: each side counted alone."""
    out, into = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("outgoing")), edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("incoming"))
    both = out.join(into, "id", "full_outer").select("id", F.coalesce("outgoing", F.lit(0)).alias("outgoing"), F.coalesce("incoming", F.lit(0)).alias("incoming"))
    return both.withColumn("total", F.col("outgoing") + F.col("incoming")).orderBy(F.desc("total"), "id").limit(top)


def advice(metrics: DataFrame, table: Sequence[tuple[str, str]]) -> DataFrame:
    """One row for each rule (SQL condition on the one-row metrics, advice) that holds, in order."""
    found = F.array_compact(F.array(*(F.when(F.expr(c), F.struct(F.lit(i).alias("rank"), F.lit(text).alias("advice"))) for i, (c, text) in enumerate(table))))
    return metrics.select(F.explode(found).alias("a")).select("a.*")


def findings(nodes: DataFrame, edges: DataFrame, source: str = "source_id") -> DataFrame:
    """kind (cause or recommendation), rank, code, value, detail: what is behind the orphans of nodes (id, type, source) and what to do, in order.

    Ratios are compared unrounded and given to six places. Coverage is the share of nodes whose type the registry knows; the five most frequent unknown types and the worst document are named in ``detail``.
    An empty graph has no cause and only the advice that always holds.
    """
    spark = nodes.sparkSession
    linked = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("_degree"))
    met = nodes.select("id", F.col(source).alias("source_id"), F.lit(True).alias("_own")).join(linked, "id", "full")  # ends without a node count for the highest degree alone
    sources = met.groupBy("source_id").agg(F.count("_own").alias("total_entities"), F.count_if(F.col("_own").isNotNull() & F.col("_degree").isNull()).alias("orphan_count"), F.max("_degree").alias("degree"))
    sources = materialize(sources, "orphans-by-source")  # one pass over edges and nodes; a row a document
    types = ontology.resolved(nodes.groupBy("type").agg(F.count("*").alias("n")))
    parts = (
        sources.agg(F.coalesce(F.sum("total_entities"), F.lit(0)).alias("entities"), F.coalesce(F.sum("orphan_count"), F.lit(0)).alias("orphans"), F.max("degree").alias("degree")),
        edges.agg(F.count("*").alias("relationships")), types.agg(F.sum(F.when(F.col("is_known"), F.col("n")).otherwise(0)).alias("known")),
        ontology.unknown_types(nodes).limit(5).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "type"))).alias("unknown")),
        _worst_sources(sources.filter("source_id is not null and total_entities > 0"), 20).agg(
            F.count_if(F.col("orphan_count") / F.col("total_entities") > 0.8).alias("failing"), F.min(F.struct((-F.col("orphan_count") / F.col("total_entities")).alias("r"), F.col("source_id").alias("d"))).alias("worst")),
    )
    one = spark.range(1).select()
    for part in parts:  # a row each
        one = one.join(part, F.lit(True))
    rate, covered = F.try_divide("orphans", "entities"), F.try_divide("known", "entities")
    none = F.lit(None).cast("string")
    rules_ = (
        ("cause", "critical_orphans", rate >= 0.9, rate, none), ("cause", "high_orphans", (rate >= 0.5) & (rate < 0.9), rate, none),
        ("cause", "concentrated", (F.col("degree") > 100) & (F.col("relationships") > 1000), F.col("degree"), none), ("cause", "low_ontology_coverage", covered < 0.5, covered, none),
        ("cause", "unmapped_types", F.size("unknown") > 0, F.size("unknown"), F.array_join(F.col("unknown.type"), ",")), ("cause", "failing_documents", F.col("failing") > 0, F.col("failing"), none),
        ("recommendation", "write_atomically", rate >= 0.8, rate, none), ("recommendation", "block_orphans", rate >= 0.8, rate, none), ("recommendation", "extend_ontology", covered < 0.8, covered, none),
        ("recommendation", "extract_facts_first", rate > 0.3, rate, none), ("recommendation", "link_orphans", F.col("orphans") > 1000, F.col("orphans"), none),
        ("recommendation", "monitor_documents", F.lit(True), F.lit(None), none), ("recommendation", "inspect_document", -F.col("worst.r") > 0.9, -F.col("worst.r"), F.col("worst.d")),
    )
    found = F.array_compact(F.array(*(F.when(holds, F.struct(
        F.lit(kind).alias("kind"), F.lit(i).alias("rank"), F.lit(code).alias("code"), F.round(value.cast("double"), 6).alias("value"), detail.alias("detail"))) for i, (kind, code, holds, value, detail) in enumerate(rules_))))
    return one.select(F.explode(found).alias("f")).select("f.*")


def coverage(nodes: DataFrame, known: Sequence[str]) -> DataFrame:
    """entities, mapped, coverage, knowledge, knowledge_mapped, knowledge_coverage."""
    mapped, own = has_label(known), ~is_structural() & noise_reason().isNull()
    one = nodes.agg(F.count("*").alias("entities"), F.count_if(mapped).alias("mapped"), F.count_if(own).alias("knowledge"), F.count_if(own & mapped).alias("knowledge_mapped"))
    ratio = lambda a, b: F.coalesce(F.round(F.try_divide(a, b), 6), F.lit(0.0))
    return one.withColumns({"coverage": ratio("mapped", "entities"), "knowledge_coverage": ratio("knowledge_mapped", "knowledge")})


def compliance(nodes: DataFrame, schemas: Mapping[str, Sequence[str]]) -> DataFrame:
    """class, full, partial (at most half missing), violating: by the required columns of each node's first label with a schema."""
    cases, missing = None, None
    for label, required in schemas.items():
        lacking = sum((F.col(c).isNull().cast("int") for c in required), F.lit(0))
        has = F.array_contains("labels", label)
        cases = F.when(has, F.lit(label)) if cases is None else cases.when(has, F.lit(label))
        share = lacking / float(max(1, len(required)))
        missing = F.when(has, share) if missing is None else missing.when(has, share)
    rows = nodes.select(cases.alias("class"), missing.alias("share")).filter("class is not null")
    return rows.groupBy("class").agg(F.count_if(F.col("share") == 0).alias("full"), F.count_if((F.col("share") > 0) & (F.col("share") <= 0.5)).alias("partial"), F.count_if(F.col("share") > 0.5).alias("violating"))


def mapping_consistency(nodes: DataFrame) -> DataFrame:
    """types, consistent (types with one class only), share."""
    kinds = nodes.filter("type is not null").groupBy("type").agg(F.count_distinct(F.col("labels")[0]).alias("classes"))
    return kinds.agg(F.count("*").alias("types"), F.count_if(F.col("classes") == 1).alias("consistent"), F.round(F.avg((F.col("classes") == 1).cast("int")), 6).alias("share"))


def weighted_score(metrics: DataFrame, weights: Mapping[str, float], bands=((0.9, "excellent"), (0.75, "good"), (0.5, "acceptable"), (0.25, "poor"))) -> DataFrame:
    """Adds score (weighted mean of columns, null as 0) and level."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return metrics.withColumn("score", F.round(total, 6)).withColumn("level", banded(F.col("score"), bands, "critical"))


def layer_counts(nodes: DataFrame, layers: Sequence[str] = rules.LAYERS) -> DataFrame:
    """layer, n, percent for every layer, and for nodes without one; empty layers show 0."""
    dimension = nodes.sparkSession.createDataFrame([(x,) for x in [*layers, "unassigned"]], "layer string")
    counts = nodes.groupBy(F.coalesce("layer", F.lit("unassigned")).alias("layer")).agg(F.count("*").alias("n"))
    joined = dimension.join(counts, "layer", "left")
    joined = joined.withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def completeness(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per key, such as a type of relationship, the number of rows, and of those with and without a value in each column."""
    with_without = [e for c in columns for e in (F.count(c).alias(f"with_{c}"), (F.count("*") - F.count(c)).alias(f"without_{c}"))]
    return rows.groupBy(key).agg(F.count("*").alias("rows"), *with_without)


def _worst_sources(counted: DataFrame, top: int) -> DataFrame:
    return counted.orderBy(F.desc(F.col("orphan_count") / F.col("total_entities")), "source_id").limit(top)


def documents_with_orphans(nodes: DataFrame, edges: DataFrame, source: str = "source_id", top: int = 20) -> DataFrame:
    """source_id, total_entities, orphan_count, orphan_rate of the documents whose nodes are most often without an edge; nodes without a document stay out."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("linked", F.lit(True))
    rows = nodes.filter(F.col(source).isNotNull()).select("id", F.col(source).alias("source_id")).join(ends, "id", "left")
    counted = rows.groupBy("source_id").agg(F.count("*").alias("total_entities"), F.count_if(F.col("linked").isNull()).alias("orphan_count"))
    return _worst_sources(counted, top).withColumn("orphan_rate", F.round(F.col("orphan_count") / F.col("total_entities"), 6))


def interoperability(entities: DataFrame, types: Sequence[str] = tuple(dict.fromkeys(rules.SCHEMA_ORG.values())), properties: Sequence[str] = rules.STANDARD_PROPERTIES) -> DataFrame:
    """One row of (labels, properties as a map): entities, schema_coverage (labels of schema.org), property_coverage (a standard property is there), readiness (0.6 and 0.4 of them), linked_data_ready, rdf_exportable."""
    share = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0.0))
    named = F.arrays_overlap(F.map_keys("properties"), F.array(*map(F.lit, properties)))
    one = entities.agg(F.count("*").alias("entities"), share(has_label(types)).alias("c"), share(named).alias("p"))
    return one.select(
        "entities", F.round("c", 6).alias("schema_coverage"), F.round("p", 6).alias("property_coverage"), F.round(F.col("c") * 0.6 + F.col("p") * 0.4, 6).alias("readiness"),
        (F.col("c") >= 0.5).alias("linked_data_ready"), (F.col("c") >= 0.7).alias("rdf_exportable"))


def ontology_score(metrics: DataFrame) -> DataFrame:
    """Adds score and level to one-row metrics: coverage, compliance, taxonomy, consistency, normalization, cross_reference, interoperability, each 0 to 1."""
    return weighted_score(metrics, rules.ONTOLOGY_WEIGHTS, rules.ONTOLOGY_LEVELS)


def ontology_advice(metrics: DataFrame) -> DataFrame:
    """rank, advice: what the metrics of ``ontology_score`` call for, in order; critical coverage comes first."""
    return advice(metrics, rules.ONTOLOGY_ADVICE)


def profile(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, rows, nulls, distinct, least, most (as text): one scan for all columns."""
    aggregates = [F.count("*").alias("rows")]
    for c in columns:
        aggregates += [F.count_if(F.col(c).isNull()).alias(f"{c}|nulls"), F.count_distinct(c).alias(f"{c}|distinct"), F.min(c).cast("string").alias(f"{c}|least"), F.max(c).cast("string").alias(f"{c}|most")]
    one = rows.agg(*aggregates)
    parts = F.array(*(F.struct(F.lit(c).alias("column"), F.col("rows"), *(F.col(f"`{c}|{m}`").alias(m) for m in ("nulls", "distinct", "least", "most"))) for c in columns))
    return one.select(F.explode(parts).alias("p")).select("p.*")


def outliers(rows: DataFrame, column: str, key: str, factor: float = 1.5) -> DataFrame:
    """Rows outside the quartiles by ``factor`` interquartile ranges; quartiles by linear interpolation."""
    q = rows.agg(F.percentile(column, F.lit(0.25)).alias("q1"), F.percentile(column, F.lit(0.75)).alias("q3"))
    bounds = q.select((F.col("q1") - factor * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + factor * (F.col("q3") - F.col("q1"))).alias("high"))
    return rows.join(F.broadcast(bounds), (F.col(column) < F.col("low")) | (F.col(column) > F.col("high"))).select(key, column)


def correlations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """x, y, r for each pair of columns, in one scan."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = rows.agg(*(F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.round(f"_{i}", 6).alias("r")) for i, (a, b) in enumerate(pairs)))).alias("p")).select("p.*")


def store_sync(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """data, left, right, missing, status: synced to 5 percent missing, minor_drift to 20, else out_of_sync."""
    left, right = a.agg(F.count("*").alias("left")), b.agg(F.count("*").alias("right"))
    one = left.join(right, F.lit(True)).withColumn("missing", F.greatest(F.col("left") - F.col("right"), F.lit(0)))
    share = F.coalesce(F.try_divide("missing", "left"), F.lit(0.0))
    return one.select(F.lit(name).alias("data"), "left", "right", "missing", F.when(share <= 0.05, "synced").when(share <= 0.2, "minor_drift").otherwise("out_of_sync").alias("status"))


def snapshot_difference(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, change (added, removed, modified), field, old, new: one row a changed field; added and removed rows have none."""
    left = old.select(F.col(key).alias("_o"), *(F.col(c).cast("string").alias(f"o_{c}") for c in columns))
    right = new.select(F.col(key).alias("_n"), *(F.col(c).cast("string").alias(f"n_{c}") for c in columns))
    joined = left.join(right, F.col("_o") == F.col("_n"), "full_outer")
    none = F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))
    fields = F.array_compact(F.array(*(F.when(~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), F.struct(F.lit(c).alias("field"), F.col(f"o_{c}").alias("old"), F.col(f"n_{c}").alias("new"))) for c in columns)))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("modified")
    rows = joined.select(F.coalesce("_n", "_o").alias(key), change.alias("change"), F.explode(F.when(change == "modified", fields).otherwise(F.array(none))).alias("f"))
    return rows.select(key, "change", "f.*")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """common, only_left, only_right, percent of the union."""
    both = a.select(key).distinct().withColumn("_l", F.lit(1)).join(b.select(key).distinct().withColumn("_r", F.lit(1)), key, "full_outer")
    one = both.agg(F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("common"), F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"))
    return one.withColumn("percent", F.round(100 * F.try_divide(F.col("common"), F.col("common") + F.col("only_left") + F.col("only_right")), 4))

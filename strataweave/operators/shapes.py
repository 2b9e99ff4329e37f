"""Shape constraints over a graph: one constraint table, one plan a kind of constraint, one table of violations.

A graph is given as ``nodes`` (id, labels) and ``statements`` (id, path, value, datatype), where a value may be the id of a node. Constraints are few and
fixed, so they are broadcast; nodes and statements meet by their ids and paths alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# The shapes of the model. (shape, classes, path, kind, value); several values are separated by |, a path that has to be there follows the value after >.
SHAPES: tuple[tuple[str, tuple[str, ...], str, str, str], ...] = (
    ("DataEntity", ("DataEntity",), "name", "min_count", "1"), ("DataEntity", ("DataEntity",), "name", "datatype", "string"), ("DataEntity", ("DataEntity",), "origin", "min_count", "1"),
    ("InformationAsset", ("InformationAsset",), "derivedFrom", "min_count", "1"), ("InformationAsset", ("InformationAsset",), "derivedFrom", "class", "DataEntity"),
    ("BusinessConcept", ("BusinessConcept",), "description", "min_count", "1"),
    ("Column", ("Column",), "name", "min_count", "1"), ("Column", ("Column",), "name", "datatype", "string"), ("Column", ("Column",), "belongsTo", "min_count", "1"), ("Column", ("Column",), "belongsTo", "max_count", "1"),
    ("Column", ("Column",), "belongsTo", "class", "Table"), ("Column", ("Column",), "hasDataType", "min_count", "1"), ("Column", ("Column",), "hasDataType", "max_count", "1"),
    ("Column", ("Column",), "layer", "in", "PERCEPTION|SEMANTIC|REASONING|APPLICATION"),
    ("Table", ("Table",), "name", "min_count", "1"), ("Table", ("Table",), "name", "datatype", "string"), ("Table", ("Table",), "belongsTo", "min_count", "1"), ("Table", ("Table",), "belongsTo", "max_count", "1"),
    ("Table", ("Table",), "belongsTo", "class", "Schema"), ("Table", ("Table",), "hasColumn", "min_count", "1"), ("Table", ("Table",), "hasColumn", "class", "Column"), ("Table", ("Table",), "layer", "has_value", "PERCEPTION"),
    ("Constraint", ("Constraint",), "name", "min_count", "1"), ("Constraint", ("Constraint",), "name", "datatype", "string"), ("Constraint", ("Constraint",), "constraintType", "min_count", "1"),
    ("Constraint", ("Constraint",), "constraintType", "in", "PRIMARY_KEY|FOREIGN_KEY|UNIQUE|NOT_NULL|CHECK|DEFAULT"), ("Constraint", ("Constraint",), "appliesTo", "min_count", "1"),
    ("Constraint", ("Constraint",), "appliesTo", "class", "Column"),
    ("ForeignKeyConstraint", ("Constraint",), "constraintType", "needs", "FOREIGN_KEY>referencesColumn"),
    ("Relationship", ("Relationship",), "source", "min_count", "1"), ("Relationship", ("Relationship",), "source", "max_count", "1"), ("Relationship", ("Relationship",), "source", "node_kind", "iri"),
    ("Relationship", ("Relationship",), "target", "min_count", "1"), ("Relationship", ("Relationship",), "target", "max_count", "1"), ("Relationship", ("Relationship",), "target", "node_kind", "iri"),
    ("Relationship", ("Relationship",), "relationshipType", "min_count", "1"), ("Relationship", ("Relationship",), "relationshipType", "datatype", "string"),
    ("Domain", ("Domain",), "name", "min_count", "1"), ("Domain", ("Domain",), "name", "datatype", "string"), ("Domain", ("Domain",), "description", "min_count", "1"),
    ("Domain", ("Domain",), "description", "datatype", "string"), ("Domain", ("Domain",), "layer", "has_value", "SEMANTIC"),
    ("TypeAssignment", ("TypeAssignment",), "column", "min_count", "1"), ("TypeAssignment", ("TypeAssignment",), "column", "max_count", "1"), ("TypeAssignment", ("TypeAssignment",), "column", "class", "Column"),
    ("TypeAssignment", ("TypeAssignment",), "dataType", "min_count", "1"), ("TypeAssignment", ("TypeAssignment",), "dataType", "max_count", "1"), ("TypeAssignment", ("TypeAssignment",), "dataType", "class", "DataType"),
    ("TypeAssignment", ("TypeAssignment",), "layer", "has_value", "PERCEPTION"),
    ("Schema", ("Schema",), "name", "min_count", "1"), ("Schema", ("Schema",), "name", "datatype", "string"), ("Schema", ("Schema",), "belongsTo", "min_count", "1"), ("Schema", ("Schema",), "belongsTo", "max_count", "1"),
    ("Schema", ("Schema",), "belongsTo", "class", "Catalog"), ("Schema", ("Schema",), "layer", "has_value", "PERCEPTION"),
    ("Catalog", ("Catalog",), "name", "min_count", "1"), ("Catalog", ("Catalog",), "name", "datatype", "string"), ("Catalog", ("Catalog",), "layer", "has_value", "PERCEPTION"),
    ("DataQualityRule", ("DataQualityRule",), "name", "min_count", "1"), ("DataQualityRule", ("DataQualityRule",), "name", "datatype", "string"), ("DataQualityRule", ("DataQualityRule",), "expression", "min_count", "1"),
    ("DataQualityRule", ("DataQualityRule",), "expression", "datatype", "string"), ("DataQualityRule", ("DataQualityRule",), "dimension", "min_count", "1"),
    ("DataQualityRule", ("DataQualityRule",), "dimension", "in", "COMPLETENESS|ACCURACY|CONSISTENCY|TIMELINESS|VALIDITY"), ("DataQualityRule", ("DataQualityRule",), "layer", "has_value", "REASONING"),
    ("LayerHierarchy", ("Relationship",), "source>target", "layer_order", "REASONING>PERCEPTION|REASONING>SEMANTIC|APPLICATION>PERCEPTION|APPLICATION>SEMANTIC|APPLICATION>REASONING"),
    ("ConfidenceScore", ("BusinessConcept", "InformationAsset"), "confidence", "min_inclusive", "0.0"), ("ConfidenceScore", ("BusinessConcept", "InformationAsset"), "confidence", "max_inclusive", "1.0"),
    ("ConfidenceScore", ("BusinessConcept", "InformationAsset"), "confidence", "datatype", "decimal"),
    ("ReasoningLayer", ("Entity",), "layer", "needs", "REASONING>confidence"),
)
#: What one violation is about: a node and path, a single value, or two nodes.
KINDS = ("min_count", "max_count", "has_value", "datatype", "in", "min_inclusive", "max_inclusive", "node_kind", "class", "needs", "layer_order")
_OUT = ("id", "shape", "path", "kind", "expected", "value")


def violations(nodes: DataFrame, statements: DataFrame, shapes: Sequence[tuple[str, Sequence[str], str, str, str]] = SHAPES) -> DataFrame:
    """id, shape, path, kind, expected, value: a row for each node that breaks a constraint, and each value that does.

    ``value`` is the offending value, the number of values for min_count and max_count, and null for has_value and needs. Repeated statements count once; null values are none. A node
    of several classes is held against the constraints of each, of one shape once. Values that are no numbers break a range. A class is met by a node that has the label; a value that is
    no node has none. Kinds that the table does not use are not planned.
    """
    unknown = {kind for *_, kind, _ in shapes} - {*KINDS}
    if unknown:
        raise ValueError(f"unknown kinds of constraint: {sorted(unknown)}")
    spark = nodes.sparkSession
    table = spark.createDataFrame([(shape, label, path, kind, value) for shape, labels, path, kind, value in shapes for label in labels], "shape string, label string, path string, kind string, expected string")
    paths = sorted({p for _, _, path, kind, expected in shapes for p in (*path.split(">"), *(expected.split(">")[1:] if kind == "needs" else ()), *(("layer",) if kind == "layer_order" else ()))})
    # Datatypes are only held against those of the table: a flag for each says whether the value is given with another one, so that values are told apart once and counted as rows.
    wanted = sorted({expected for *_, kind, expected in shapes if kind in ("datatype", "node_kind")})
    others = [F.max(F.coalesce(F.col("datatype") != d, F.lit(True))).alias(f"_other{i}") for i, d in enumerate(wanted)]
    facts = statements.filter(F.col("path").isin(paths) & F.col("value").isNotNull()).groupBy("id", "path", "value").agg(F.count("*").alias("_given"), *others).drop("_given")
    facts = materialize(facts, "shape-facts")  # every kind reads them
    labels = nodes.select("id", F.explode("labels").alias("label"))
    used = {kind for *_, kind, _ in shapes}
    rules_of = lambda *kinds: F.broadcast(table.filter(F.col("kind").isin(*kinds)))
    of = lambda *kinds: labels.join(rules_of(*kinds), "label")
    about = lambda *which: facts.filter(F.col("path").isin(*which))
    paths_of = lambda *kinds: sorted({path for *_, path, kind, _ in shapes if kind in kinds})
    parts = []

    if used & {"min_count", "max_count"}:
        kinds = ("min_count", "max_count")
        counts = about(*paths_of(*kinds)).groupBy("id", "path").agg(F.count("*").alias("n"))
        bounds = table.filter(F.col("kind").isin(*kinds)).groupBy("label", "path").agg(F.collect_list(F.struct("shape", "kind", "expected")).alias("_bounds"))
        asked = labels.join(F.broadcast(bounds), "label").join(counts, ["id", "path"], "left")
        n, bound = F.coalesce("n", F.lit(0)), lambda r: r["expected"].try_cast("long")
        bad = F.filter("_bounds", lambda r: ((r["kind"] == "min_count") & (n < bound(r))) | ((r["kind"] == "max_count") & (n > bound(r))))
        parts.append(asked.select("id", "path", n.cast("string").alias("value"), F.explode(bad).alias("_r")).select("id", "path", "value", "_r.*"))
    if "has_value" in used:
        held = about(*paths_of("has_value")).select("id", "path", F.col("value").alias("expected")).join(rules_of("has_value"), ["path", "expected"], "left_semi")
        parts.append(of("has_value").join(held, ["id", "path", "expected"], "left_anti").withColumn("value", F.lit(None).cast("string")))
    # A value that breaks a constraint does so whatever its node is: bad ones are found first, by the path alone, and only they are joined with the labels.
    kinds = ("datatype", "in", "min_inclusive", "max_inclusive", "node_kind")
    if used & set(kinds):
        number, bound = F.col("value").try_cast("double"), F.col("expected").try_cast("double")
        bad = (
            F.when(F.col("kind").isin("datatype", "node_kind"), F.array_contains(F.filter(F.array(*(F.when(F.col(f"_other{i}"), F.lit(d)) for i, d in enumerate(wanted)), F.lit(None).cast("string")), lambda d: d.isNotNull()), F.col("expected")))
            .when(F.col("kind") == "in", ~F.array_contains(F.split("expected", r"\|"), F.col("value")))
            .when(F.col("kind") == "min_inclusive", F.coalesce(number < bound, F.lit(True)))
            .when(F.col("kind") == "max_inclusive", F.coalesce(number > bound, F.lit(True)))
        )
        parts.append(about(*paths_of(*kinds)).join(rules_of(*kinds), "path").filter(bad).join(labels, ["id", "label"]))
    if "class" in used:
        targets = about(*paths_of("class")).join(rules_of("class"), "path")
        parts.append(targets.join(labels.toDF("value", "expected"), ["value", "expected"], "left_anti").join(labels, ["id", "label"]))
    if "needs" in used:
        given = [(path, expected.split(">")) for *_, path, kind, expected in shapes if kind == "needs"]
        rows = of("needs").withColumns({"given": F.split_part("expected", F.lit(">"), F.lit(1)), "other": F.split_part("expected", F.lit(">"), F.lit(2))})
        said = about(*(path for path, _ in given)).filter(F.col("value").isin(*(value for _, (value, *_) in given)))
        rows = rows.join(said.select("id", "path", F.col("value").alias("given")), ["id", "path", "given"], "left_semi")
        others = about(*(other for _, (_, other) in given))
        parts.append(rows.join(others.select("id", F.col("path").alias("other")), ["id", "other"], "left_anti").withColumn("value", F.lit(None).cast("string")))
    if "layer_order" in used:
        layers = about("layer").select("id", F.col("value").alias("layer"))
        one, two = F.split_part("path", F.lit(">"), F.lit(1)), F.split_part("path", F.lit(">"), F.lit(2))
        ends = about(*(p for path in paths_of("layer_order") for p in path.split(">")))
        rows = of("layer_order").withColumns({"one": one, "two": two})
        rows = rows.join(ends.select("id", F.col("path").alias("one"), F.col("value").alias("a")), ["id", "one"]).join(ends.select("id", F.col("path").alias("two"), F.col("value").alias("b")), ["id", "two"])
        rows = rows.join(layers.toDF("a", "from"), "a").join(layers.toDF("b", "to"), "b")
        rows = rows.filter(F.array_contains(F.split("expected", r"\|"), F.concat_ws(">", "from", "to")))
        parts.append(rows.withColumn("value", F.concat_ws(">", "from", "to")))
    if not parts:
        return of().withColumn("value", F.lit(None).cast("string")).filter("false").select(*_OUT)
    return reduce(DataFrame.unionByName, [p.select(*_OUT) for p in parts]).distinct()


def summary(found: DataFrame) -> DataFrame:
    """shape, kind, violations, nodes of what ``violations`` has found."""
    return found.groupBy("shape", "kind").agg(F.count("*").alias("violations"), F.count_distinct("id").alias("nodes"))

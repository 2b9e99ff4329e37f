"""Metadata catalogs over attribute rows (schema, table, position, column, rule): hierarchy, keys, types, constraints, lineage, policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.messages import holds

# Name parts that tell a type, in the order in which they are tried.
TYPE_PARTS = (
    ("BIGINT", ("id", "key")), ("TIMESTAMP", ("timestamp", "created_at", "updated_at")), ("DATE", ("date", "time")), ("VARCHAR", ("email",)),
    ("DECIMAL", ("amount", "price", "cost", "revenue", "budget", "value", "total")), ("INTEGER", ("count", "number", "quantity", "num_", "qty")),
    ("BOOLEAN", ("is_", "has_", "can_", "should_", "active", "enabled", "status")),
)
LENGTHS = ((50, ("id",)), (255, ("email",)), (100, ("name",)), (500, ("description", "text")))
BASES = {"VARCHAR": "STRING", "INTEGER": "NUMERIC", "BIGINT": "NUMERIC", "DECIMAL": "NUMERIC", "DATE": "TEMPORAL", "TIMESTAMP": "TEMPORAL", "BOOLEAN": "BOOLEAN"}


def from_tables(spark: SparkSession, tables: dict[str, DataFrame], schema: str = "main") -> DataFrame:
    """Attribute rows of given tables; rows follow their number of columns."""
    rows = [(schema, name, i, f.name, None) for name, df in sorted(tables.items()) for i, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "schema string, table string, position int, column string, rule string")


def attribute_type(name: Column) -> Column:
    """A struct of type, precision, scale, base from an attribute's name; the first type with a part in the name, else VARCHAR."""
    t = F.lower(name)
    kind = F.coalesce(*(F.when(holds(t, parts), k) for k, parts in TYPE_PARTS), F.lit("VARCHAR"))
    length = F.coalesce(*(F.when(holds(t, parts), n) for n, parts in LENGTHS), F.lit(100))
    precision = F.when(kind == "VARCHAR", length).when(kind == "DECIMAL", 10)
    money, share = holds(t, ("amount", "price", "cost", "revenue", "budget")), holds(t, ("percentage", "rate", "ratio"))
    scale = F.when(kind == "DECIMAL", F.when(~money & share, 4).otherwise(2))
    base = F.coalesce(*(F.when(kind == k, b) for k, b in BASES.items()))
    return F.struct(kind.alias("type"), precision.alias("precision"), scale.alias("scale"), base.alias("base"))


def constraint(rule: Column, table: Column, column: Column) -> Column:
    """A struct of kind and name of the constraint that a business rule states; null if it states none."""
    t = F.lower(rule)
    kind = F.when(t.contains("unique"), "UNIQUE").when(t.contains("cannot be null") | t.contains("must be present"), "NOT_NULL").when(t.contains("must be") & t.contains("format"), "CHECK")
    prefix = F.when(kind == "UNIQUE", "uk").when(kind == "NOT_NULL", "nn").otherwise("chk")
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.concat_ws("_", prefix, table, column).alias("name")))


def overview(catalog: DataFrame) -> DataFrame:
    """schema, tables, columns, types: the hierarchy's counts."""
    return catalog.groupBy("schema").agg(F.count_distinct("table").alias("tables"), F.count("*").alias("columns"), F.count_distinct(attribute_type(F.col("column"))["type"]).alias("types"))


def foreign_keys(catalog: DataFrame) -> DataFrame:
    """schema, table, column, target: key columns (beyond the first place) and the first table of the schema whose primary key (its first column) ends in their name.

    Ends are taken at underscores, so that keys meet by an equi-join, never all with all.
    """
    words = F.split(F.lower("column"), "_")
    ends = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), "_"))
    keys = catalog.filter("position = 0").select("schema", F.col("table").alias("target"), F.explode(ends).alias("end")).distinct()
    uses = catalog.filter("position > 0").select("schema", "table", "column", F.lower("column").alias("end")).filter("end like '%id'").distinct()
    found = uses.join(keys, ["schema", "end"]).filter("table <> target")
    return found.groupBy("schema", "table", "column").agg(F.min("target").alias("target"))


def graph_nodes(catalog: DataFrame) -> DataFrame:
    """(id, kind) of schemas, tables, columns, types, constraints and source files."""
    return _parts(catalog)[0]


def graph_edges(catalog: DataFrame) -> DataFrame:
    """(src, rel_type, dst): HAS_TABLE, HAS_COLUMN, HAS_TYPE, HAS_CONSTRAINT, and TRANSFORMS_INTO from source files and from raw tables to dim and fact tables of one name."""
    return _parts(catalog)[1]


def _parts(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = catalog.select(
        F.concat(F.lit("schema:"), "schema").alias("s"), F.concat_ws(".", F.concat(F.lit("table:"), "schema"), "table").alias("t"), F.concat_ws(".", F.concat(F.lit("column:"), "schema"), "table", "column").alias("c"),
        F.concat(F.lit("type:"), attribute_type(F.col("column"))["type"]).alias("k"), F.concat(F.lit("constraint:"), "schema", F.lit("."), constraint(F.col("rule"), F.col("table"), F.col("column"))["name"]).alias("r"),
        F.concat(F.lit("file:"), "schema", F.lit(".raw_"), "table", F.lit(".csv")).alias("f"), "schema", "table",
    )
    tables = rows.select("schema", "table", "t").distinct()
    made = tables.filter(F.col("table").rlike("^(dim|fact)_")).select("schema", F.concat(F.lit("raw_"), F.regexp_replace("table", "^(dim|fact)_", "")).alias("raw"), "t")
    derived = made.join(tables.select("schema", F.col("table").alias("raw"), F.col("t").alias("src")), ["schema", "raw"])
    pair = lambda a, name, b: F.struct(F.col(a).alias("src"), F.lit(name).alias("rel_type"), F.col(b).alias("dst"))
    kinds = F.array(*(F.struct(F.col(c).alias("id"), F.lit(kind).alias("kind")) for c, kind in (("s", "Schema"), ("t", "Table"), ("c", "Column"), ("k", "Type"), ("r", "Constraint"), ("f", "File"))))
    nodes = rows.select(F.explode(kinds).alias("n")).select("n.*").filter("id is not null").distinct()
    links = F.array(pair("s", "HAS_TABLE", "t"), pair("t", "HAS_COLUMN", "c"), pair("c", "HAS_TYPE", "k"), pair("c", "HAS_CONSTRAINT", "r"), pair("f", "TRANSFORMS_INTO", "t"))
    edges = rows.select(F.explode(links).alias("e")).select("e.*").filter("dst is not null")
    return nodes, edges.union(derived.select("src", F.lit("TRANSFORMS_INTO"), "t")).distinct()


def policies_by_asset(policies: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets with the policies (policy, applies_to array) that name them."""
    flat = policies.select("policy", F.explode("applies_to").alias("id"))
    return assets.select("id").join(flat.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("policy")), ",").alias("policies")), "id", "left")

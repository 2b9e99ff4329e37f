"""Markdown data specs as five tables, by column expressions over their lines.

A line belongs to the last heading above it: ``## Section`` and, inside sections, ``### Name``. Items of an entity belong to the last of its
``- **Key Attributes**:`` and ``- **Business Rules**:`` lines. Files are spread over tasks, each file's lines are put in order by one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What the sections and lines of a spec are called.
CONTEXT, ENTITIES, RELATIONSHIPS = "Business Context", "Data Entities", "Relationships"
DESCRIPTION, ATTRIBUTES, RULES = "- **Description**:", "- **Key Attributes**:", "- **Business Rules**:"
PRIMARY, FOREIGN = "(Primary Key)", "(Foreign Key)"
DOMAIN = (r"\*\*Domain\*\*:\s*(.+)", r"Domain:\s*(.+)", r"# Domain:\s*(.+)", r"#\s*Domain\s*\n(.+)")
LINK = r"\*\*([^*]+)\*\*\s*→\s*\*\*([^*]+)\*\*\s*\(([^)]+)\)"


def _found(pattern: str, text: str = "text") -> Column:
    """What the first match captures, trimmed; null without one."""
    return F.when(F.col(text).rlike(pattern), F.trim(F.regexp_extract(text, pattern, 1)))


def _item(line: Column) -> Column:
    return F.trim(F.replace(line, F.lit("- "), F.lit("")))


def lines(files: DataFrame) -> DataFrame:
    """file, at, line (trimmed), section, name (the entity's or part's heading, null above the first), part (line of that heading) of (file, text)."""
    rows = files.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("at", "raw")).withColumn("line", F.trim("raw"))
    two, three = F.regexp_extract("raw", r"^##\s+(.*\S)\s*$", 1), F.regexp_extract("raw", r"^###\s+(.*\S)\s*$", 1)
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c, what: F.last(F.when(c != "", what), ignorenulls=True).over(before)
    rows = rows.withColumns({"section": last(two, two), "section_at": last(two, F.col("at")), "name": last(three, three), "part": last(three, F.col("at"))})
    inside = F.col("part") > F.coalesce("section_at", F.lit(-1))
    return rows.select("file", "at", "line", "section", F.when(inside, F.col("name")).alias("name"), F.when(inside, F.col("part")).alias("part"))


def parse(files: DataFrame) -> dict[str, DataFrame]:
    """Tables of (file, text): domains, entities, attributes, rules, relationships.

    domains: file, domain (null where the spec names none), stakeholders, data_owner, effective_date, business_context. entities: file, entity, position, description, primary_key,
    foreign_keys. attributes and rules: file, entity, position, and the item. relationships: file, position, source, target, type, description. Positions are lines. All parts of the section of relationships are read.
    """
    rows = lines(files)
    head = F.coalesce(*(_found(f"(?i){p}") for p in DOMAIN))
    people = F.transform(F.split(_found(r"\*\*Stakeholders\*\*:\s*(.+)"), ","), lambda x: F.trim(x))
    facts = files.select(
        "file", head.alias("domain"), F.coalesce(people, F.array().cast("array<string>")).alias("stakeholders"), F.coalesce(_found(r"\*\*Data Owner\*\*:\s*(.+)"), F.lit("Unknown")).alias("data_owner"),
        _found(r"\*\*Effective Date\*\*:\s*(\d{4}-\d{2}-\d{2})").try_cast("date").alias("effective_date"))
    context = rows.filter((F.col("section") == CONTEXT) & F.col("part").isNull() & ~F.col("line").startswith("##")).groupBy("file").agg(
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n"), F.lit(" \n")).alias("business_context"))
    domains = facts.join(context, "file", "left").withColumn("business_context", F.coalesce("business_context", F.lit("No business context provided")))

    own = rows.filter((F.col("section") == ENTITIES) & F.col("part").isNotNull())
    kind = F.when(F.col("line").startswith(ATTRIBUTES), "attribute").when(F.col("line").startswith(RULES), "rule")
    inside = Window.partitionBy("file", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marked = own.withColumns({"kind": F.last(kind, ignorenulls=True).over(inside), "marker": kind.isNotNull() | F.col("line").startswith(DESCRIPTION)})
    items = marked.filter(~F.col("marker") & F.col("line").startswith("- ") & (_item(F.col("line")) != "")).select("file", "part", F.col("name").alias("entity"), F.col("at").alias("position"), "kind", _item(F.col("line")).alias("item"))
    attributes = items.filter("kind = 'attribute'").withColumnRenamed("item", "attribute").drop("kind")
    key = F.trim(F.substring_index("attribute", "(", 1))
    keyed = attributes.groupBy("file", "part").agg(
        F.min_by(key, F.when(F.contains("attribute", F.lit(PRIMARY)), F.col("position"))).alias("primary_key"),
        F.transform(F.array_sort(F.collect_list(F.when(F.contains("attribute", F.lit(FOREIGN)), F.struct("position", key.alias("key"))))), lambda x: x["key"]).alias("foreign_keys"))
    described = F.trim(F.replace("line", F.lit(DESCRIPTION), F.lit("")))
    entities = own.groupBy("file", "part").agg(F.first("name").alias("entity"), F.max_by(described, F.when(F.col("line").startswith(DESCRIPTION), F.col("at"))).alias("description"))
    entities = entities.join(keyed, ["file", "part"], "left").select(
        "file", "entity", F.col("part").alias("position"), F.coalesce("description", F.lit("")).alias("description"), "primary_key", F.coalesce("foreign_keys", F.array().cast("array<string>")).alias("foreign_keys"))

    section = rows.filter(F.col("section") == RELATIONSHIPS)
    links = section.withColumn("link", F.col("line").rlike(LINK))
    after = Window.partitionBy("file").orderBy("at").rowsBetween(1, 4)
    told = F.first(F.when(F.col("line").startswith("- ") & ~F.col("line").startswith("- **"), F.substring("line", 3, 1 << 30)), ignorenulls=True).over(after)
    part = lambda i: F.trim(F.regexp_extract("line", LINK, i))
    relationships = links.withColumn("description", F.coalesce(told, F.lit(""))).filter("link").select("file", F.col("at").alias("position"), part(1).alias("source"), part(2).alias("target"), part(3).alias("type"), "description")
    return {"domains": domains, "entities": entities, "attributes": attributes.drop("part"), "rules": items.filter("kind = 'rule'").withColumnRenamed("item", "rule").drop("kind", "part"), "relationships": relationships}


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of ``parse`` for the Markdown files at a path."""
    return parse(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))

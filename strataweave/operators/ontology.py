"""Ontology registry: spellings of entity types, what the registry says of a type, and types that it does not know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import free_name

# Type, class, layer, least confidence, path from the root type, schema.org type.
DATA_TYPES = (
    ("table", "DataEntity", "PERCEPTION", 0.7, ("data_entity", "table"), "Dataset"),
    ("file", "DataEntity", "PERCEPTION", 0.7, ("data_entity", "file"), "Dataset"),
    ("column", "Attribute", "PERCEPTION", 0.7, ("attribute", "column"), "Property"),
    ("field", "Attribute", "PERCEPTION", 0.7, ("attribute", "field"), "Property"),
    ("database", "DataEntity", "PERCEPTION", 0.7, ("data_entity", "database"), "Dataset"),
    ("schema", "DataEntity", "PERCEPTION", 0.7, ("data_entity", "schema"), "Dataset"),
    ("system", "DataEntity", "PERCEPTION", 0.7, ("data_entity", "system"), "SoftwareApplication"),
    ("report", "InformationAsset", "SEMANTIC", 0.85, ("information_asset", "report"), "Article"),
    ("dashboard", "InformationAsset", "SEMANTIC", 0.85, ("information_asset", "dashboard"), "Article"),
    ("domain", "Domain", "SEMANTIC", 0.85, ("domain",), "Organization"),
    ("data_product", "InformationAsset", "SEMANTIC", 0.85, ("information_asset", "data_product"), "Dataset"),
    ("person", "Domain", "SEMANTIC", 0.85, ("stakeholder", "person"), "Person"),
    ("team", "Domain", "SEMANTIC", 0.85, ("stakeholder", "team"), "Organization"),
    ("concept", "BusinessConcept", "REASONING", 0.9, ("business_concept", "concept"), "DefinedTerm"),
    ("business_concept", "BusinessConcept", "REASONING", 0.9, ("business_concept",), "DefinedTerm"),
    ("rule", "DataQualityRule", "REASONING", 0.9, ("quality_rule", "rule"), None),
    ("data_quality_rule", "DataQualityRule", "REASONING", 0.9, ("quality_rule",), None),
    ("process", "BusinessConcept", "REASONING", 0.9, ("business_concept", "process"), "Action"),
    ("pipeline", "BusinessConcept", "REASONING", 0.9, ("business_concept", "pipeline"), None),
    ("workflow", "BusinessConcept", "REASONING", 0.9, ("business_concept", "workflow"), None),
    ("score", "DataQualityScore", "APPLICATION", 0.95, ("quality_score", "score"), None),
    ("usage", "UsageStats", "APPLICATION", 0.95, ("usage_stats", "usage"), None),
    ("decision", "Decision", "APPLICATION", 0.95, ("decision",), None),
    ("metric", "DataQualityScore", "APPLICATION", 0.95, ("quality_score", "metric"), None),
    ("kpi", "DataQualityScore", "APPLICATION", 0.95, ("quality_score", "kpi"), None),
    ("policy", "DataQualityRule", "APPLICATION", 0.95, ("governance", "policy"), None),
    ("sla", "DataQualityRule", "APPLICATION", 0.95, ("governance", "sla"), None),
)
MEDICAL_TYPES = (
    ("symptom", "Symptom", "PERCEPTION", 0.7, ("clinical_observation", "symptom"), None),
    ("test", "Test", "PERCEPTION", 0.7, ("clinical_observation", "test"), None),
    ("observation", "Observation", "PERCEPTION", 0.6, ("clinical_observation", "observation"), None),
    ("measurement", "Measurement", "PERCEPTION", 0.7, ("clinical_observation", "measurement"), None),
    ("disease", "Disease", "SEMANTIC", 0.85, ("clinical_concept", "disease"), None),
    ("condition", "Condition", "SEMANTIC", 0.85, ("clinical_concept", "condition"), None),
    ("drug", "Drug", "SEMANTIC", 0.85, ("therapeutic_agent", "drug"), None),
    ("treatment", "Treatment", "SEMANTIC", 0.85, ("therapeutic_agent", "treatment"), None),
    ("anatomy", "Anatomy", "SEMANTIC", 0.9, ("clinical_concept", "anatomy"), None),
    ("pathway", "Pathway", "REASONING", 0.9, ("biological_mechanism", "pathway"), None),
    ("gene", "Gene", "REASONING", 0.9, ("biological_mechanism", "gene"), None),
    ("mechanism", "Mechanism", "REASONING", 0.9, ("biological_mechanism", "mechanism"), None),
    ("interaction", "Interaction", "REASONING", 0.85, ("biological_mechanism", "interaction"), None),
    ("guideline", "Guideline", "APPLICATION", 0.95, ("clinical_knowledge", "guideline"), None),
    ("protocol", "Protocol", "APPLICATION", 0.95, ("clinical_knowledge", "protocol"), None),
    ("study", "Study", "APPLICATION", 0.9, ("clinical_knowledge", "study"), None),
    ("organization", "Organization", "APPLICATION", 0.85, ("clinical_knowledge", "organization"), None),
    ("biomarker", "Biomarker", "PERCEPTION", 0.7, ("clinical_observation", "biomarker"), None),
    ("protein", "Protein", "SEMANTIC", 0.85, ("biological_entity", "protein"), None),
    ("organism", "Organism", "SEMANTIC", 0.85, ("biological_entity", "organism"), None),
    ("virus", "Virus", "SEMANTIC", 0.85, ("biological_entity", "virus"), None),
    ("cell_type", "CellType", "SEMANTIC", 0.85, ("biological_entity", "cell_type"), None),
    ("food_component", "FoodComponent", "SEMANTIC", 0.85, ("biological_entity", "food_component"), None),
)
# Other spellings of a type, as they are once lower-cased and joined by underscores.
SPELLINGS = {
    "table": "tables dataentity data_entity entity entities", "file": "files", "column": "columns", "field": "fields attribute attributes", "database": "databases db", "schema": "schemas",
    "system": "systems application applications service services", "report": "reports", "dashboard": "dashboards", "domain": "domains business_domain businessdomain",
    "data_product": "dataproduct product products data_products", "person": "people persons user users owner owners stakeholder stakeholders steward stewards data_owner data_steward",
    "team": "teams group groups department departments", "concept": "concepts", "business_concept": "businessconcept business_concepts businessconcepts", "process": "processes etl job jobs task tasks",
    "pipeline": "pipelines data_pipeline datapipeline", "workflow": "workflows flow flows", "rule": "rules", "data_quality_rule": "qualityrule quality_rule validation_rule validationrule",
    "score": "scores qualityscore quality_score", "metric": "metrics measure measures", "kpi": "kpis indicator indicators", "usage": "usagestats usage_stats statistics", "decision": "decisions",
    "policy": "policies governance", "sla": "slas agreement agreements",
    "disease": "diseases medical_condition disorder syndrome illness", "condition": "conditions health_state", "drug": "drugs medication medications compound pharmaceutical medicine chemical chemicals",
    "treatment": "treatments therapy procedure intervention", "symptom": "symptoms sign signs manifestation", "test": "tests diagnostic_test", "gene": "genes genetic_marker", "pathway": "pathways biological_pathway",
    "study": "studies clinical_trial research_study trial", "organization": "organizations institution research_institution university hospital", "biomarker": "biomarkers biological_marker",
    "protein": "proteins enzyme enzymes cytokine cytokines", "organism": "organisms species pathogen pathogens bacterium bacteria genus model_organism", "virus": "viruses viral_agent",
    "cell_type": "cell_types celltype", "food_component": "food_components nutrient nutrients dietary_substance vitamin vitamins",
}
#: A type outside the registry that has a class nevertheless.
OTHER_CLASSES = {"lineage": "transformsInto"}


def registry(spark) -> DataFrame:
    """canonical, class, type_layer, threshold, hierarchy, schema_type, ontology_domain: a row a registered type."""
    rows = [(*r, "data_architecture") for r in DATA_TYPES] + [(*r, "medical") for r in MEDICAL_TYPES]
    return spark.createDataFrame(rows, "canonical string, class string, type_layer string, threshold double, hierarchy array<string>, schema_type string, ontology_domain string")


def spellings(spark) -> DataFrame:
    """spelling, canonical: each registered type and its other spellings, once."""
    own = [(r[0], r[0]) for r in (*DATA_TYPES, *MEDICAL_TYPES)]
    return spark.createDataFrame(own + [(s, kind) for kind, names in SPELLINGS.items() for s in names.split()], "spelling string, canonical string")


def spelled(kind: Column) -> Column:
    """Lower case, joined by single underscores, letters and digits alone; null and what has none of these: unknown."""
    joined = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(kind, F.lit(""))), "[- ]", "_"), r"[^\p{L}\p{N}_]", "")
    plain = F.regexp_replace(F.regexp_replace(joined, "_+", "_"), "^_|_$", "")
    return F.when(plain == "", "unknown").otherwise(plain)


def resolved(rows: DataFrame, kind: str = "type") -> DataFrame:
    """Adds ``canonical`` and ``is_known``: the type as it is spelled, else without a plural s, else without _entity, _concept or _type.

    A type that none of these names keeps its spelling and is not known. Each form is one join with the spellings, which are of fixed size. Columns of these names are replaced.
    """
    rows = rows.drop("canonical", "is_known")
    form = spelled(F.col(kind))
    forms = [form, F.when(form.endswith("s") & (F.length(form) > 2), F.regexp_replace(form, "s$", "")), F.when(form.rlike("_(entity|concept|type)$"), F.regexp_replace(form, "_(entity|concept|type)$", ""))]
    fresh = lambda name: free_name(name, rows.columns)
    keys, found = [fresh(f"form_{i}") for i in range(3)], [fresh(f"found_{i}") for i in range(3)]
    out = rows.withColumns(dict(zip(keys, forms)))
    for key, name in zip(keys, found):
        out = out.join(F.broadcast(spellings(rows.sparkSession).toDF(key, name)), key, "left")  # some 200 rows
    hit = F.coalesce(*found)
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), F.coalesce(hit, keys[0]).alias("canonical"), hit.isNotNull().alias("is_known"))


def mapped(entities: DataFrame) -> DataFrame:
    """id, ontology_labels, canonical, ontology_mapped, ontology_domain, layer, hierarchy, threshold of (id, type, layer).

    Labels: the type's class, its schema.org type and the type as it is written, without blanks and hyphens and with a capital. A layer that the entity has stays; else the type's.
    Unmapped types have the domain unknown, no path, a threshold of 0.7 and their own spelling; a null or empty type has no labels.
    """
    rows = resolved(entities.select("id", "type", "layer")).join(F.broadcast(registry(entities.sparkSession)), "canonical", "left")  # 50 rows
    written = F.regexp_replace(F.coalesce("type", F.lit("")), "[ -]", "")
    initial = F.substring(written, 1, 1)
    own = F.when(initial.rlike(r"^\p{L}"), F.concat(F.upper(initial), F.substring(written, 2, 1 << 30))).when(written != "", written)
    other = F.create_map(*(F.lit(x) for kv in OTHER_CLASSES.items() for x in kv))
    first = F.coalesce("class", F.try_element_at(other, F.lower("type")))
    return rows.select(
        "id", F.array_distinct(F.array_compact(F.array(first, "schema_type", own))).alias("ontology_labels"), "canonical", F.col("is_known").alias("ontology_mapped"),
        F.coalesce("ontology_domain", F.lit("unknown")).alias("ontology_domain"), F.coalesce("layer", "type_layer").alias("layer"),
        F.coalesce("hierarchy", F.array().cast("array<string>")).alias("hierarchy"), F.coalesce("threshold", F.lit(0.7)).alias("threshold"),
    )


def unknown_types(entities: DataFrame) -> DataFrame:
    """type, n: types (as they are written) that the registry does not know, the most frequent first. Types are resolved once each, after counting; null is no type."""
    counted = entities.filter("type is not null").groupBy("type").agg(F.count("*").alias("n"))
    return resolved(counted).filter(~F.col("is_known")).select("type", "n").orderBy(F.desc("n"), "type")


def by_ancestor(entities: DataFrame) -> DataFrame:
    """ancestor, n: known entities under each type of the hierarchy, the type itself included."""
    counted = resolved(entities.groupBy("type").agg(F.count("*").alias("n"))).filter("is_known").groupBy("canonical").agg(F.sum("n").alias("n"))
    held = counted.join(F.broadcast(registry(entities.sparkSession)), "canonical")
    return held.select(F.explode("hierarchy").alias("ancestor"), "n").groupBy("ancestor").agg(F.sum("n").alias("n"))

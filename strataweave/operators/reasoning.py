"""Rules that suggest types, concepts, domains, quality rules and concerns from names, property keys, questions and treatments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.messages import first_of, holds

# Fixed values of the rules.
KEYWORDS = (
    "pain", "knee", "back", "head", "headache", "fever", "cough", "medication", "treatment", "diagnosis", "ibuprofen", "aspirin", "therapy", "physical therapy", "exercise", "diet", "allergy", "symptom",
    "condition", "prescription",
)
CONCEPT_COLUMNS = {
    "Customer": ("customer_id", "customer_name", "email", "phone"), "Order": ("order_id", "order_date", "order_total", "order_status"), "Product": ("product_id", "product_name", "price", "sku"),
    "Employee": ("employee_id", "first_name", "last_name", "hire_date"), "Transaction": ("transaction_id", "transaction_date", "amount"), "Address": ("address_id", "street", "city", "state", "zip_code"),
    "Payment": ("payment_id", "payment_method", "payment_date", "amount"),
}
DOMAINS = {
    "financial": ("amount", "price", "cost", "balance", "payment", "revenue"), "temporal": ("date", "time", "timestamp", "created_at", "updated_at"), "identity": ("id", "key", "uuid", "identifier"),
    "contact": ("email", "phone", "address", "contact"), "analytics": ("count", "sum", "avg", "total", "score", "metric"),
}
QUALITY_RULES = {
    "Customer": ("email_required", "unique_email", "phone_format"), "Order": ("order_date_not_future", "total_positive", "status_valid"), "Product": ("price_positive", "sku_unique", "category_required"),
    "Transaction": ("amount_non_zero", "timestamp_required", "balance_consistency"),
}
DRUG_CLASSES = {
    "biologic": ("humira", "remicade", "adalimumab", "infliximab", "enbrel"), "immunosuppressant": ("azathioprine", "methotrexate", "6-mp"), "corticosteroid": ("prednisone", "budesonide", "cortisone"),
}
ADVICE_WORDS = ("should i take", "should i use", "recommend", "prescribe", "best treatment", "what medication", "which drug", "how to treat", "cure for")
TAKEN = ("took", "taking", "started", "using", "on schedule")
MISSED = ("missed", "forgot", "skip", "stopped", "discontinued", "ran out")
SIDE_EFFECTS = ("side effect", "reaction", "feeling worse", "nausea from", "tired from")


def keywords(text: Column) -> Column:
    """The known words that a text holds, then its "<word> pain" phrases."""
    t = F.lower(F.coalesce(text, F.lit("")))
    pains = F.transform(F.regexp_extract_all(t, F.lit(r"(\w+)\s+pain"), 1), lambda w: F.concat(w, F.lit(" pain")))
    return F.concat(F.filter(F.array(*map(F.lit, KEYWORDS)), lambda w: F.contains(t, w)), pains)


def suggestions(entities: DataFrame) -> DataFrame:
    """id, kind (property, class or relationship), suggestion for each rule that an entity (id, properties as a map) meets by its id or property keys."""
    t = F.lower(F.coalesce("id", F.lit("")))
    keys = F.map_keys(F.coalesce("properties", F.create_map().cast("map<string,string>")))
    has = lambda *names: F.arrays_overlap(keys, F.array(*map(F.lit, names)))
    rules = (
        ("property", "identifier", t.endswith("id")), ("property", "person", holds(t, ("user", "customer", "person"))), ("property", "transaction", holds(t, ("order", "transaction", "purchase"))),
        ("property", "has_contact_info", has("email")), ("property", "is_temporal", has("created_date")), ("class", "person", has("name") & has("email")), ("class", "financial", has("amount", "price")),
        ("class", "process", has("status") & has("created_date")), ("relationship", "HAS_EMAIL", has("email")), ("relationship", "CREATED_ON", has("created_date")),
    )
    found = F.array_compact(F.array(*(F.when(condition, F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("suggestion"))) for kind, name, condition in rules)))
    return entities.select("id", F.explode(found).alias("s")).select("id", "s.*")


def table_concepts(catalog: DataFrame, least: float = 0.4, concepts: Mapping[str, Sequence[str]] = CONCEPT_COLUMNS) -> DataFrame:
    """schema, table, concept, share: the concepts of whose columns a table (schema, table, column) holds at least the share, each column inside some name."""
    rows = [(c, x, len(columns)) for c, columns in concepts.items() for x in columns]
    known = F.broadcast(catalog.sparkSession.createDataFrame(rows, "concept string, part string, size int"))  # a rule table
    hits = catalog.join(known, F.expr("contains(lower(`column`), part)")).groupBy("schema", "table", "concept", "size").agg(F.count_distinct("part").alias("n"))
    return hits.withColumn("share", F.round(F.col("n") / F.col("size"), 6)).filter(F.col("n") >= least * F.col("size")).select("schema", "table", "concept", "share")


def column_domain(name: Column) -> Column:
    """The first domain with a word in the name, else null."""
    return first_of(F.lower(name), DOMAINS, None)


def quality_rules(concepts: DataFrame, rules: Mapping[str, Sequence[str]] = QUALITY_RULES) -> DataFrame:
    """``concepts`` (concept, ..) with each quality rule that a concept brings."""
    known = F.broadcast(concepts.sparkSession.createDataFrame([(c, r) for c, names in rules.items() for r in names], "concept string, rule string"))
    return concepts.join(known, "concept")


def treatment_patterns(subjects: DataFrame, chronic: Sequence[str]) -> DataFrame:
    """subject_id, pattern of (subject_id, medications, conditions): biologic therapy, several drugs with a steroid, chronic conditions."""
    meds = F.transform("medications", lambda m: first_of(F.lower(m), DRUG_CLASSES, None))
    long_ = F.exists("conditions", lambda c: holds(F.lower(c), chronic))
    found = F.array_compact(F.array(
        F.when(F.array_contains(meds, "biologic"), "on_biologic_therapy"), F.when(F.array_contains(meds, "corticosteroid") & (F.size("medications") > 2), "multi_drug_regimen"), F.when(long_, "chronic_condition_management"),
    ))
    return subjects.select("subject_id", F.explode(found).alias("pattern"))


def concerns(question: Column) -> Column:
    """What a question says about taking medication: missed or taken, and side effects."""
    t = F.lower(F.coalesce(question, F.lit("")))
    return F.array_compact(F.array(F.when(holds(t, MISSED), "adherence_concern").when(holds(t, TAKEN), "adherence_positive"), F.when(holds(t, SIDE_EFFECTS), "side_effect_concern")))


def asks_for_advice(question: Column) -> Column:
    """Whether a question asks which treatment to take."""
    return holds(F.lower(F.coalesce(question, F.lit(""))), ADVICE_WORDS)


def entity_state(confidence: Column, high: float = 0.8, low: float = 0.6) -> Column:
    """valid, warn or review by the confidence of an extracted entity (null: 0)."""
    c = F.coalesce(confidence, F.lit(0.0))
    return F.when(c >= high, "valid").when(c < low, "warn").otherwise("review")

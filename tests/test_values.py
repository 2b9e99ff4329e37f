"""Names, specs, facts, scores and demotions on worked examples."""

import pytest
from pyspark.sql import functions as F

from strataweave.functions import text
from strataweave.operators import audit, facts, feedback, flags, graph, linking, rules
from strataweave.sources import specs

SPEC = """# Agreement - Sales Domain

## Document Information
- **Domain**: Sales
- **Stakeholders**: A Team , B Team
- **Effective Date**: 2024-01-15

## Business Context
Why it is.

More of it.

## Data Entities

### Customer
- **Description**: Who buys
- **Key Attributes**:
  - Customer ID (Primary Key)
  - First Name, Last Name
  - Region ID (Foreign Key)

  - Team ID (Foreign Key, optional) (Foreign Key)
- **Business Rules**:
  - Customer ID must be unique

### Empty

## Relationships

### Own
- **Customer** → **Order** (1:N)
  - A customer has orders
  - Each order has one

### Others
- **Order**→**Item** (M:N through Line)

## Access Patterns
### Common
- **Key Attributes**:
  - not one
"""


def test_spec(spark):
    made = specs.parse(spark.createDataFrame([("a", SPEC), ("b", "nothing here"), ("c", "domain: Lower\r\n## Data Entities\r\n### X\r\n- **Key Attributes**:\r\n- y"), ("d", None)], "file string, text string"))
    domains = {r.file: r for r in made["domains"].collect()}
    a = domains["a"]
    assert (a.domain, a.stakeholders, a.data_owner, str(a.effective_date), a.business_context) == ("Sales", ["A Team", "B Team"], "Unknown", "2024-01-15", "Why it is.\n\nMore of it.")
    assert domains["b"].domain is None and domains["b"].business_context == "No business context provided" and domains["c"].domain == "Lower"
    entities = {(r.file, r.entity): r for r in made["entities"].collect()}
    assert set(entities) == {("a", "Customer"), ("a", "Empty"), ("c", "X")}
    customer = entities["a", "Customer"]
    assert (customer.description, customer.primary_key, customer.foreign_keys) == ("Who buys", "Customer ID", ["Region ID", "Team ID"]) and entities["a", "Empty"].primary_key is None
    assert [r.attribute for r in made["attributes"].orderBy("file", "position").collect()] == ["Customer ID (Primary Key)", "First Name, Last Name", "Region ID (Foreign Key)", "Team ID (Foreign Key, optional) (Foreign Key)", "y"]
    assert [(r.entity, r.rule) for r in made["rules"].collect()] == [("Customer", "Customer ID must be unique")]
    assert [(r.source, r.target, r.type, r.description) for r in made["relationships"].orderBy("position").collect()] == [("Customer", "Order", "1:N", "A customer has orders"), ("Order", "Item", "M:N through Line", "")]


@pytest.mark.parametrize("name,form", [
    ("CustAddr", "customer_address"), ("cust_id", "customer_identifier"), ("client", "customer"), ("Order  Qty-No#", "order_qtyno"), ("pk", "primary_key"), ("dx", "medical_diagnosis"), ("num", "numeric"), ("vendor", "vendor"),
    ("itemDesc_", "product_description"), ("__a__b", "a_b"), ("", ""), (None, None),
])
def test_normalized_names(spark, name, form):
    row = spark.createDataFrame([(name,)], "n string").select(text.normalized_name(F.col("n")).alias("f"), text.trace(F.col("n")).alias("t")).first()
    assert row.f == form and (not name or (row.t[0], row.t[-1]) == (f"Original: {name}", f"Final: {form}"))


def test_entity_names_and_types(spark):
    rows = spark.createDataFrame([("  HTN ", "medicine"), ("Type  2", "Lab Result"), (None, None), ("x", "data-asset x2y")], "n string, k string")
    got = [(r.n, r.k) for r in rows.select(text.entity_name(F.col("n"), rules.MEDICAL_ABBREVIATIONS).alias("n"), text.entity_type(F.col("k"), rules.ENTITY_TYPES).alias("k")).collect()]
    assert got == [("hypertension", "Medication"), ("type 2", "LabResult"), ("", "Entity"), ("x", "Data-Asset X2Y")]


def test_fact_types(spark):
    of = {"a": ["Drug", "Medication"], "b": ["Drug", "Disease"], "c": ["Drug", "Drug"], "d": ["Person", "Drug"], "e": ["Effect", "Drug"], "f": ["Treatment", "Disease", "Cause"]}
    mentions = spark.createDataFrame([(c, f"e{i}", kind, 0.8) for c, kinds in of.items() for i, kind in enumerate(kinds)], "chunk_id string, entity string, type string, confidence double")
    texts = spark.createDataFrame([("d", "Smoking CAUSES harm"), ("d", "causes"), ("z", "causes")], "chunk_id string, text string")
    got = {r.chunk_id: r.fact_type for r in facts.build(mentions, texts).collect()}
    assert got == {"a": "treatment", "b": "association", "c": "hierarchical", "d": "causation", "e": "causation", "f": "treatment"}


def test_concepts(spark):
    rows = spark.createDataFrame([("Patient_Visits",), ("sales order",), ("plain_name x",), ("lab_order",), (" ",), (None,)], "n string")
    got = [r.c and (r.c.concept, r.c.confidence) for r in rows.select(linking.inferred_concept(F.col("n")).alias("c")).collect()]
    assert got == [("Patient", 0.95), ("Sales", 0.6), ("PlainName", 0.6), ("SalesOrder", 0.9), None, None]


def test_demotion(spark):
    nodes = spark.createDataFrame([("a", "APPLICATION", 0.9), ("b", "SEMANTIC", 0.3), ("c", "PERCEPTION", 0.9), ("d", "REASONING", None), ("e", "REASONING", 0.9)], "id string, layer string, confidence double")
    ratings = [(i, r) for i in "abcd" for r in (1, 2, 1, 5, 4)] + [("e", 1)] * 4
    got = {r.id: (r.previous_layer, r.layer, round(r.confidence, 6)) for r in feedback.demotions(nodes, spark.createDataFrame(ratings, "entity string, rating int")).collect()}
    assert got == {"a": ("APPLICATION", "REASONING", 0.7), "b": ("SEMANTIC", "PERCEPTION", 0.1), "d": ("REASONING", "SEMANTIC", 0.1)}


def test_search_score_and_explanation(spark):
    nodes = spark.createDataFrame([("a", "A", "BusinessConcept", ["X"], "p", "q", "r", "s"), ("b", None, "Other", ["X"], None, None, None, None), ("c", None, None, None, None, None, None, None)],
                                  "id string, name string, type string, labels array<string>, p string, q string, r string, s string")
    edges = spark.createDataFrame([("a", f"n{i}") for i in range(12)] * 2 + [("b", "b")], "src string, dst string")
    matches = spark.createDataFrame([("a", 0.9), ("b", 0.5), ("c", 0.1)], "id string, match double")
    got = [(r.id, round(r.score, 6), r.explanation) for r in linking.hybrid_search(matches, nodes, edges).collect()]
    assert got == [("a", 0.93, "High semantic similarity (0.90); Well-connected in graph (12 neighbors)"), ("b", 0.395, "Low confidence match (vector=0.50, graph=0.15)")]


def test_flags_and_edges(spark):
    nodes = spark.createDataFrame([("a", "However", ["ExtractedEntity", "Concept"], "PERCEPTION"), ("b", " which ", ["X"], "DATA"), ("c", "ab", ["Message"], "APPLICATION"), ("d", None, None, None)], "id string, name string, labels array<string>, layer string")
    assert {r.id: r.noise_reason for r in flags.mark_noise(nodes).collect()} == {"a": None, "b": "stopword", "c": None, "d": "short_name"}
    assert {r.label: r["count"] for r in flags.structural_counts(nodes).collect()} == {"ExtractedEntity": 1, "Message": 1}
    assert sorted(r.id for r in flags.knowledge(nodes).collect()) == ["a", "b", "d"] and [r.id for r in flags.invalid_layers(nodes).collect()] == ["b"]
    edges = spark.createDataFrame([("a", "owned_by", "b"), ("a", "hasAttribute", "b"), ("b", "belongsToDomain", "gone"), ("b", "odd", "c"), ("b", "relatedTo", "gone")], "src string, rel_type string, dst string")
    assert ("b", "owner_of", "a") in {tuple(r) for r in graph.inverse_edges(edges).collect()} and graph.inverse_edges(edges).count() == 6
    valid = {r.rel_type: r.valid for r in graph.cross_reference_validity(edges, nodes).collect()}
    assert valid == {"owned_by": True, "hasAttribute": False, "belongsToDomain": False, "odd": True, "relatedTo": True}


def test_scores_of_empty_tables(spark):
    none = spark.createDataFrame([], "labels array<string>, properties map<string,string>")
    assert audit.interoperability(none).first().readiness == 0.0
    metrics = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0), (0.4, 0.0, 0.0, None, 0.0, 0.0, 0.0)], "coverage double, compliance double, taxonomy double, consistency double, normalization double, cross_reference double, interoperability double")
    assert [(r.score, r.level) for r in audit.ontology_score(metrics).collect()] == [(0.95, "excellent"), (0.1, "critical")]


def test_type_pairs_of_many_types_and_entities_of_two(spark):
    import random
    from collections import Counter

    random.seed(2)
    rows = [(f"c{random.randrange(60)}", f"e{random.randrange(40)}", random.choice([None, *(f"t{i}" for i in range(5))])) for _ in range(900)] + [("wide", f"e{i}", f"w{i}") for i in range(1200)]
    kept = {r for r in rows if r[2] is not None}
    by_chunk = {}
    for c, e, k in kept:
        by_chunk.setdefault(c, []).append((e, k))
    expected = Counter((x, y) for c, held in by_chunk.items() if c != "wide" for a, x in held for b, y in held if a < b)
    got = facts.type_pairs(spark.createDataFrame(rows, "chunk_id string, entity string, type string"), 5, 1000).collect()
    assert {(r.type_a, r.type_b): r.n for r in got} == {k: n for k, n in expected.items() if n > 5}


def test_findings_of_an_orphaned_graph(spark):
    nodes = [(f"n{i}", "table" if i < 3 else f"odd{i % 2}", "d1" if i < 12 else "d2") for i in range(20)]
    edges = [("n12", "n13"), ("n12", "n14")]
    frame = spark.createDataFrame(nodes, "id string, type string, source_id string")
    got = {r.code: (r.kind, r.value, r.detail) for r in audit.findings(frame, spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {
        "high_orphans": ("cause", 0.85, None), "low_ontology_coverage": ("cause", 0.15, None), "unmapped_types": ("cause", 2.0, "odd1,odd0"), "failing_documents": ("cause", 1.0, None), "write_atomically": ("recommendation", 0.85, None),
        "block_orphans": ("recommendation", 0.85, None), "extend_ontology": ("recommendation", 0.15, None), "extract_facts_first": ("recommendation", 0.85, None), "monitor_documents": ("recommendation", None, None),
        "inspect_document": ("recommendation", 1.0, "d1"),
    }
    empty = audit.findings(frame.limit(0), spark.createDataFrame([], "src string, dst string"))
    assert [r.code for r in empty.collect()] == ["monitor_documents"]


def test_findings_shuffle_edges_once(spark, monkeypatch):
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans = []
    write = getattr(audit, "materialize", lambda df, name: df)
    monkeypatch.setattr(audit, "materialize", lambda df, name: plans.append(df) or write(df, name), raising=False)
    nodes = own.createDataFrame([("a", "table", "d1"), ("b", "table", None), (None, "odd", "d1")], "id string, type string, source_id string")
    made = audit.findings(nodes, own.createDataFrame([("a", "gone"), ("gone", None), ("gone", "a")], "src string, dst string"))
    assert sum(df._jdf.queryExecution().executedPlan().toString().count("Generate explode(array(src") for df in (*plans, made)) == 1
    got = {r.code: r.value for r in made.collect()}
    assert got["high_orphans"] == round(2 / 3, 6) and got["monitor_documents"] is None

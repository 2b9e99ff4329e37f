"""Ontology registry: spellings, mapping, unknown types."""

from strataweave.operators import ontology

TYPES = "id string, type string, layer string"


def test_spellings_resolve_in_order(spark):
    given = {"Medical Condition": "disease", "tables": "table", "BusinessConcepts": "business_concept", "data_entity": "table", "Genes": "gene", "drug_entity": "drug",
             "therapy_type": "treatment", "  __KPI__ ": "kpi", "viruses": "virus", "Policies": "policy", "Clinical Trial": "study"}
    rows = spark.createDataFrame(list(given.items()), "type string, expected string")
    got = {r.type: (r.canonical, r.is_known) for r in ontology.resolved(rows).collect()}
    assert got == {k: (v, True) for k, v in given.items()}
    odd = ontology.resolved(spark.createDataFrame([(None,), ("",), ("!?",), ("s",), ("Unheard Of",), ("InformationAsset",)], "type string"))
    assert [(r.canonical, r.is_known) for r in odd.collect()] == [("unknown", False)] * 3 + [("s", False), ("unheard_of", False), ("informationasset", False)]


def test_all_types_are_their_own_spelling(spark):
    names = ontology.registry(spark).select("canonical").withColumnRenamed("canonical", "type")
    assert names.count() == 50 and ontology.resolved(names).filter("canonical <> type or not is_known").isEmpty()
    spelled = ontology.spellings(spark)
    assert spelled.count() == spelled.select("spelling").distinct().count()
    assert ontology.resolved(spelled.select("spelling", spelled.canonical.alias("expected")), "spelling").filter("canonical <> expected").isEmpty()


def test_mapping_keeps_a_layer_and_names_the_unmapped(spark):
    rows = [("a", "table", None), ("b", "Drug", "APPLICATION"), ("c", "Lineage", None), ("d", "odd-type x", None), ("e", None, None), ("f", "People", None)]
    got = {r.id: r for r in ontology.mapped(spark.createDataFrame(rows, TYPES)).collect()}
    assert got["a"].ontology_labels == ["DataEntity", "Dataset", "Table"] and got["a"].layer == "PERCEPTION" and got["a"].hierarchy == ["data_entity", "table"] and got["a"].ontology_domain == "data_architecture"
    assert got["b"].ontology_labels == ["Drug"] and got["b"].layer == "APPLICATION" and got["b"].threshold == 0.85 and got["b"].ontology_domain == "medical"
    assert got["c"].ontology_labels == ["transformsInto", "Lineage"] and not got["c"].ontology_mapped and got["c"].layer is None
    assert got["d"].ontology_labels == ["Oddtypex"] and got["d"].ontology_domain == "unknown" and got["d"].hierarchy == []
    assert got["e"].ontology_labels == [] and got["e"].canonical == "unknown"
    assert got["f"].ontology_labels == ["Domain", "Person", "People"]


def test_unknown_types_and_ancestors(spark):
    rows = [(str(i), k, None) for i, k in enumerate(["x", "x", "y", "Tables", "file", "domain", None])]
    frame = spark.createDataFrame(rows, TYPES)
    assert [tuple(r) for r in ontology.unknown_types(frame).collect()] == [("x", 2), ("y", 1)]
    assert {r.ancestor: r.n for r in ontology.by_ancestor(frame).collect()} == {"data_entity": 2, "table": 1, "file": 1, "domain": 1}
    empty = spark.createDataFrame([], TYPES)
    assert ontology.mapped(empty).isEmpty() and ontology.unknown_types(empty).isEmpty()


def test_clashing_columns_stay(spark):
    row = ontology.resolved(spark.createDataFrame([("drug", 1, 2)], "type string, form_0 int, FOUND_1 int")).first()
    assert (row.form_0, row.FOUND_1, row.canonical) == (1, 2, "drug")

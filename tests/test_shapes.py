"""Every kind of shape constraint, broken and met."""

import pytest

from strataweave.operators import shapes

NODES = [("a", ["A"]), ("b", ["A", "B"]), ("c", ["C"]), ("link", ["L"]), (None, ["A"]), ("bare", None)]


def found(spark, statements, *table):
    nodes = spark.createDataFrame(NODES, "id string, labels array<string>")
    rows = spark.createDataFrame(statements, "id string, path string, value string, datatype string")
    return sorted(((r.id, r.value) for r in shapes.violations(nodes, rows, table).collect() if r.id is not None), key=str)


@pytest.mark.parametrize("kind,expected,statements,bad", [
    ("min_count", "1", [("a", "p", "x", "string"), ("b", "q", "x", "string")], [("b", "0")]),
    ("max_count", "1", [("a", "p", "x", "string"), ("a", "p", "x", "string"), ("b", "p", "x", "string"), ("b", "p", "y", "string")], [("b", "2")]),
    ("has_value", "x", [("a", "p", "x", "string"), ("a", "p", "y", "string"), ("b", "p", "y", "string")], [("b", None)]),
    ("datatype", "string", [("a", "p", "x", "string"), ("b", "p", "1", "integer"), ("b", "p", "2", None)], [("b", "1"), ("b", "2")]),
    ("in", "x|y.z", [("a", "p", "y.z", "string"), ("b", "p", "yoz", "string")], [("b", "yoz")]),
    ("min_inclusive", "0.0", [("a", "p", "0", "decimal"), ("b", "p", "-0.1", "decimal"), ("b", "p", "low", "string")], [("b", "-0.1"), ("b", "low")]),
    ("max_inclusive", "1.0", [("a", "p", "1.0", "decimal"), ("b", "p", "1.01", "decimal")], [("b", "1.01")]),
    ("node_kind", "iri", [("a", "p", "c", "iri"), ("b", "p", "c", "string")], [("b", "c")]),
    ("class", "C", [("a", "p", "c", "iri"), ("b", "p", "a", "iri"), ("b", "p", "nobody", "iri"), ("b", "p", None, "iri")], [("b", "a"), ("b", "nobody")]),
    ("needs", "x>q", [("a", "p", "x", "string"), ("a", "q", "z", "string"), ("b", "p", "x", "string"), ("link", "p", "x", "string")], [("b", None)]),
])
def test_kind(spark, kind, expected, statements, bad):
    assert found(spark, statements, ("S", ("A",), "p", kind, expected)) == bad


def test_layer_order(spark):
    layers = [("a", "layer", "REASONING", "string"), ("b", "layer", "PERCEPTION", "string")]
    rule = ("S", ("L",), "source>target", "layer_order", "REASONING>PERCEPTION|REASONING>SEMANTIC")
    assert found(spark, layers + [("link", "source", "a", "iri"), ("link", "target", "b", "iri")], rule) == [("link", "REASONING>PERCEPTION")]
    assert found(spark, layers + [("link", "source", "b", "iri"), ("link", "target", "a", "iri")], rule) == []


def test_two_classes_of_one_shape_and_empty_tables(spark):
    rule = ("S", ("A", "B"), "p", "min_count", "1")
    assert found(spark, [], rule) == [("a", "0"), ("b", "0")]
    none = spark.createDataFrame([], "id string, labels array<string>")
    facts = spark.createDataFrame([], "id string, path string, value string, datatype string")
    assert shapes.violations(none, facts).count() == 0 and shapes.violations(none, facts, ()).count() == 0
    with pytest.raises(ValueError):
        shapes.violations(none, facts, [("S", ("A",), "p", "beauty", "1")])


def test_all_shapes_of_the_model():
    assert len({shape for shape, *_ in shapes.SHAPES}) == 16 and {kind for *_, kind, _ in shapes.SHAPES} == {*shapes.KINDS}


def test_a_value_is_one_row_of_what_every_kind_reads(spark, monkeypatch):
    written, write = [], shapes.materialize
    monkeypatch.setattr(shapes, "materialize", lambda df, name: written.append(write(df, name)) or written[-1])
    assert found(spark, [("a", "p", "x", "string"), ("a", "p", "x", None), ("b", "p", "x", "string")], ("S", ("A",), "p", "datatype", "string")) == [("a", "x")]
    assert written[0].count() == 2


def test_a_value_of_two_datatypes_counts_once_and_breaks_both(spark):
    twice = [("a", "p", "x", "string"), ("a", "p", "x", "iri"), ("b", "p", "y", "string"), ("b", "q", "y", "string")]
    assert found(spark, twice, ("S", ("A",), "p", "max_count", "1")) == []
    assert found(spark, twice, ("S", ("A",), "p", "datatype", "string"), ("S", ("A",), "p", "node_kind", "iri")) == [("a", "x"), ("a", "x"), ("b", "y")]

"""Taxonomy, names, transitions, quality, views, layers by label, copies of sessions and searches on worked examples."""

from datetime import datetime

from pyspark.sql import functions as F

from strataweave.functions import temporal
from strataweave.operators import feedback, flags, measures

NODES = "id string, labels array<string>"
EDGES = "src string, rel_type string, dst string"


def test_taxonomy(spark):
    nodes = spark.createDataFrame(
        [("a", ["Column"]), ("t", ["Table"]), ("d", ["Domain"]), ("e", ["Domain", "X"]), ("x", ["X"]), ("p", ["Policy"]), ("free", ["Drug"]), ("chunk", ["Chunk"]), ("none", None), ("c1", ["C"]), ("c2", ["C"]), ("below", ["C"])], NODES)
    edges = spark.createDataFrame([
        ("a", "PART_OF", "t"), ("t", "PART_OF", "d"), ("d", "IS_A", "e"), ("x", "BELONGS_TO", "e"), ("p", "IS_A", "gone"), ("none", "IS_A", "d"), ("a", "MENTIONS", "p"), ("c1", "IS_A", "c2"), ("c2", "IS_A", "c1"), ("below", "IS_A", "c1"), (None, "IS_A", "a")], EDGES)
    one = measures.taxonomy(nodes, edges).first()
    # valid: a-t by a pair, d-e and x-e by a shared label (d-e by a pair too), the three inside C; not valid: t-d, p-gone, none-d
    assert (one.relationships, one.valid, one.invalid, one.coherence) == (9, 6, 3, round(6 / 9, 6))
    assert (one.orphans, one.unclassified, one.episodic) == (1, 1, 0)  # free; a chunk is structure
    assert (one.max_depth, one.cyclic) == (3, 3) and one.avg_depth == round((3 + 2 + 1 + 1 + 1 + 2) / 6, 6)
    marked = nodes.withColumn("is_orphan", F.col("id").isin("free", "x", "p", "chunk")).withColumn("orphan_source", F.when(F.col("id") == "x", "episodic").when(F.col("id") == "p", "elsewhere"))
    one = measures.taxonomy(marked, edges).first()
    assert (one.orphans, one.episodic, one.knowledge, one.unclassified) == (3, 1, 0, 2)
    empty = measures.taxonomy(nodes.limit(0), edges.limit(0)).first()
    assert (empty.relationships, empty.coherence, empty.orphans, empty.max_depth, empty.avg_depth) == (0, 1.0, 0, 0, 0.0)


def test_normalization(spark):
    rows = [("customer", "T", ["X"]), ("Cust Addr", "T", ["X"]), ("client", "T", ["X"]), ("", "T", ["X"]), (None, None, None), ("Red-Hat", "T", ["X"]), ("red hat", "T", ["X"]), ("redhat", "T", ["X"]), ("red hat", None, ["X"]), (" Red Hat ", "T", ["Chunk"]), ("RED HAT", "T", ["X"])]
    entities = spark.createDataFrame(rows, "name string, type string, labels array<string>")
    one = measures.normalization(entities).first()
    assert one.total == 11 and one.canonical + one.normalized == 9 and one.rate == round(9 / 11, 6)
    assert one.synonym_hits == 1 and one.abbreviation_hits >= 2
    # red_hat twice (typed, no structure), redhat twice
    assert {(r.canonical_form, r.n) for r in measures.duplicate_names(entities).collect()} == {("red_hat", 2), ("redhat", 2)} and one.duplicates == 2
    merged = entities.withColumn("merged_into", F.when(F.col("name") == "RED HAT", "1"))
    assert {r.canonical_form for r in measures.duplicate_names(merged).collect()} == {"redhat"}
    assert measures.normalization(entities.limit(0)).first().rate == 0.0


def test_transition_statistics(spark):
    at = datetime(2024, 1, 1)
    rows = [("A", "B", "completed", at, datetime(2024, 1, 1, 0, 1)), ("A", "B", "completed", at, None), ("B", "C", "completed", at, datetime(2024, 1, 1, 0, 0, 30)), ("A", "B", "failed", at, datetime(2024, 1, 2)), ("A", "B", "pending", None, None), ("A", "B", "odd", at, None)]
    frame = spark.createDataFrame(rows, "from_layer string, to_layer string, status string, requested_at timestamp, completed_at timestamp")
    got = {(r.kind, r.key): r.value for r in measures.transition_statistics(frame).collect()}
    assert got == {("count", "total"): 6, ("count", "completed"): 3, ("count", "pending"): 1, ("count", "rejected"): 0, ("count", "failed"): 1, ("mean", "mean_seconds"): 45, ("path", "A → B"): 2, ("path", "B → C"): 1}
    assert {r.value for r in measures.transition_statistics(frame.limit(0)).collect()} == {0.0}


def test_quality_statistics(spark):
    frame = spark.createDataFrame([(1, "good", 0.5, None), (1, None, 1.0, None), (2, "good", None, None)], "doc_id long, level string, a double, b double")
    got = {(r.kind, r.key): r.value for r in measures.quality_statistics(frame, ("a", "b")).collect()}
    assert got == {("average", "a"): 0.75, ("average", "b"): 0.0, ("count", "documents"): 2, ("level", "good"): 2}


def test_layers_by_label(spark):
    rows = [("a", ["Drug", "Table"], None, "x", None), ("b", ["Drug"], None, None, 0.3), ("c", ["Odd"], None, None, None), ("d", None, None, None, 0.2), ("e", ["Policy"], "SEMANTIC", "active", None), ("f", ["Message"], None, None, None)]
    frame = spark.createDataFrame(rows, "id string, labels array<string>, layer string, status string, confidence double")
    got = {r.id: (r.layer, r.status, r.confidence, r.layer_assignment_method) for r in measures.migrate_layers(frame).collect()}
    assert got == {
        "a": ("PERCEPTION", "pending_validation", 0.7, "migration_by_label"), "b": ("SEMANTIC", "validated", 0.3, "migration_by_label"), "c": ("PERCEPTION", "pending_validation", None, "migration_default"),
        "d": ("PERCEPTION", "pending_validation", 0.2, "migration_default"), "e": ("SEMANTIC", "active", None, None), "f": ("APPLICATION", "validated", 0.9, "migration_by_label")}


def test_copy_sessions(spark):
    ids = [f"00000000-0000-4000-8000-{i:012d}" for i in range(4)]
    sessions = spark.createDataFrame([(ids[0],), (ids[1],), ("bad",), (None,)], "session_id string")
    messages = spark.createDataFrame([(ids[0], ids[0]), (ids[1], ids[1]), (ids[2], "bad"), (ids[3], ids[3]), ("odd", ids[0])], "message_id string, session_id string")
    there, said = sessions.limit(0).union(spark.createDataFrame([(ids[0],)], "session_id string")), messages.filter(F.col("message_id") == ids[0])
    new, fresh, counts = measures.copy_sessions(sessions, messages, there, said)
    assert [r.session_id for r in new.collect()] == [ids[1]] and [r.message_id for r in fresh.collect()] == [ids[1]] and new.columns == sessions.columns
    assert {tuple(r) for r in counts.collect()} == {("sessions", 1, 1, 2, 0), ("messages", 1, 1, 1, 2)}
    new, fresh, counts = measures.copy_sessions(sessions, messages, there, said, full=True)
    assert new.count() == 2 and fresh.count() == 2 and {tuple(r) for r in counts.collect()} == {("sessions", 2, 0, 2, 0), ("messages", 2, 0, 1, 2)}


def test_session_search_and_buckets(spark):
    sessions = spark.createDataFrame([(1, "Knee pain", 10), (2, None, 30), (3, "PAIN", 20), (4, "pain", 5)], "session_id long, title string, last_activity long")
    messages = spark.createDataFrame([(1, "a"), (1, "b"), (2, "my pain and pain"), (2, "none"), (3, None)], "session_id long, content string")
    anywhere = flags.search_sessions(sessions, messages, "Pain", limit=3).collect()
    assert [(r.session_id, r.matches, r.message_count) for r in anywhere] == [(2, 1, 2), (3, 1, 1), (1, 2, 2)]
    exact = flags.search_sessions(sessions, messages, "pain", exact=True, limit=5).collect()
    assert [(r.session_id, r.matches) for r in exact] == [(1, 2), (2, 1)]
    now, at = datetime(2024, 3, 10, 12), [datetime(2024, 3, 10, 11), datetime(2024, 3, 9, 13), datetime(2024, 3, 9, 11), datetime(2024, 3, 3, 0), datetime(2024, 2, 20), datetime(2024, 1, 1), datetime(2024, 3, 12), None]
    frame = spark.createDataFrame([(i, x, now) for i, x in enumerate(at)], "i int, last timestamp, now timestamp")
    got = [tuple(r) for r in frame.orderBy("i").select(temporal.day_bucket(F.col("last"), F.col("now")), temporal.elapsed_bucket(F.col("last"), F.col("now"))).collect()]
    assert got == [("today", "today"), ("yesterday", "today"), ("yesterday", "yesterday"), ("this_week", "this_week"), ("older", "this_month"), ("older", "older"), ("today", "this_week"), ("older", "older")]


def test_views_and_search(spark):
    columns = spark.createDataFrame([("c1", "t", "PII", None), ("c2", "t", None, True), ("c3", "t", "open", False), ("c4", "t", None, None)], "name string, table_name string, classification string, is_pii boolean")
    nodes = spark.createDataFrame([("a", "A", "said of B", ["X"], "SEMANTIC"), ("b", "B", None, ["X"], "SEMANTIC"), ("c", "C", "", ["Y"], None)], "id string, name string, description string, labels array<string>, layer string")
    edges = spark.createDataFrame([("a", "FLOWS_TO", "b"), ("a", "OTHER", "c")], EDGES)
    views = measures.named_views(columns, nodes, edges)
    assert {r.name for r in views["pii_data"].collect()} == {"c1", "c2"} and [tuple(r) for r in views["lineage"].collect()] == [("A", "FLOWS_TO", "B")]
    assert [(list(r.type), r.n) for r in views["domain_summary"].collect()] == [(["X"], 2)]
    assert [r.id for r in flags.search(nodes, "b").collect()] == ["a", "b"] and [r.id for r in flags.search(nodes.drop("description"), "B").collect()] == ["b"]


def test_layer_suggestions(spark):
    rows = [(["PERCEPTION"], 1, "incorrect"), (["PERCEPTION", "APPLICATION"], 2, "missing_info"), (["APPLICATION"], 5, "x"), (["REASONING"], 2, None), (["SEMANTIC"], 5, "incorrect")]
    frame = spark.createDataFrame(rows, "layers array<string>, rating int, feedback_type string")
    got = {r.layer: r.suggestions for r in feedback.layer_performance(frame).collect()}
    assert got["PERCEPTION"].split("; ") == ["Critical: PERCEPTION layer needs significant improvement", "Improve entity extraction accuracy from source documents", "Expand document coverage for better information retrieval"]
    assert got["APPLICATION"] == "Consider retraining with recent preference data" and got["SEMANTIC"] == "" and got["REASONING"] == "Critical: REASONING layer needs significant improvement"

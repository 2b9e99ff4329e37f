"""The graph store: pruning, upserts, all or nothing, replays; crystallization against one batch over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from strataweave.sources import graph_store
from strataweave.sources.graph_store import GraphStore
from strataweave.streaming import crystallize

NODES = "id string, name string, type string, labels array<string>, layer string, confidence double, observation_count long, status string"
EDGES = "src string, rel_type string, dst string, confidence double"


def node(i, name="n", layer="PERCEPTION", labels=("X",), count=1, confidence=0.5, kind="T"):
    return (i, name, kind, list(labels) if labels else None, layer, confidence, count, "active")


@pytest.fixture
def store(spark, tmp_path):
    made = GraphStore(spark, f"file://{tmp_path}/graph")
    rows = [node("a"), node("b", layer="SEMANTIC"), node("c", layer=None), node("d", layer="SEMANTIC", labels=None), node("a", name="m", labels=("Y",))]
    edges = [("a", "IS A/B", "b", 0.5), ("a", "SEES", "b", 0.7), ("b", "SEES", "ghost", 0.1), ("b", "SEES", "ghost", 0.2)]
    made.commit(nodes=spark.createDataFrame(rows, NODES), edges=spark.createDataFrame(edges, EDGES))
    return made


def ids(df):
    return sorted(r.id for r in df.collect())


def test_filters_prune_partitions(store):
    plan = store.nodes(layer="SEMANTIC")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(layer" in plan and "SEMANTIC" in plan.split("PartitionFilters")[1].split("]")[0]
    scan = store.edges(rel_type="SEES")._jdf.queryExecution().executedPlan().toString()
    assert "SEES" in scan.split("PartitionFilters")[1].split("]")[0]
    assert ids(store.nodes("SEMANTIC")) == ["b", "d"] and ids(store.nodes()) == ["a", "b", "c", "d", "ghost"]
    assert store.edges("IS A/B").count() == 1 and store.edges(src="b").select("confidence").collect()[0][0] == 0.2
    a = store.nodes().filter("id = 'a'").first()
    assert sorted(a.labels) == ["X", "Y"] and a.name == "n" and store.nodes().filter("id = 'ghost'").first().labels == ["Entity"]


def test_upsert_writes_touched_partitions_alone(spark, store):
    before = store.manifest()
    store.commit(nodes=spark.createDataFrame([("b", None, None, ["Z"], "REASONING", 0.9, None, None), node("new", layer="REASONING")], NODES))
    after = store.manifest()
    assert {v for v, f in after.parts["nodes"].items() if before.parts["nodes"].get(v) == f} == {"PERCEPTION", "__HIVE_DEFAULT_PARTITION__"}
    assert after.parts["edges"] == before.parts["edges"]
    b = store.nodes("REASONING").filter("id = 'b'").first()
    assert sorted(b.labels) == ["X", "Z"] and (b.name, b.confidence, b.observation_count) == ("n", 0.9, 1)
    assert ids(store.nodes("SEMANTIC")) == ["d"] and ids(store.nodes()) == ["a", "b", "c", "d", "ghost", "new"]
    store.commit(nodes=spark.createDataFrame([("d", None, None, None, "REASONING", None, None, None)], NODES))
    assert "SEMANTIC" not in store.manifest().parts["nodes"] and store.nodes("SEMANTIC").count() == 0


def test_failing_edges_leave_nodes_unseen(spark, store):
    before = store.manifest()
    bad = spark.createDataFrame([("a", "SEES", "c", 2.0)], EDGES)
    with pytest.raises(ValueError):
        store.commit(nodes=spark.createDataFrame([node("late")], NODES), edges=bad, valid={"edges": "confidence <= 1"})
    broken = bad.withColumn("confidence", F.when(F.col("dst") == "c", F.raise_error(F.lit("broken"))).cast("double"))
    with pytest.raises(Exception, match="broken"):
        store.commit(nodes=spark.createDataFrame([node("late")], NODES), edges=broken)
    assert store.manifest() == before and "late" not in ids(store.nodes())


def test_replayed_batches_and_two_writers(spark, store):
    rows = spark.createDataFrame([node("e")], NODES)
    first = store.commit(nodes=rows, batch=("s", 0))
    assert store.commit(nodes=spark.createDataFrame([node("f")], NODES), batch=("s", 0)) == first and "f" not in ids(store.nodes())
    stale = store.manifest()
    store.commit(nodes=rows)
    stale.version += 1
    with pytest.raises(RuntimeError):
        store._publish(stale)


MENTIONS = "name string, type string, confidence double"


def test_crystallization_of_a_stream(spark, tmp_path):
    rng = random.Random(4)
    names = ["Alpha", "alpha ", "BETA", "gamma ray", "Delta", "", " ", None]
    rows = [(rng.choice(names), rng.choice(["T", "U", None]), round(rng.random(), 3)) for _ in range(200)] + [("Alpha", "T", 0.2)] * 100
    table = spark.createDataFrame(rows, MENTIONS)
    table.repartition(6).write.parquet(f"{tmp_path}/in")

    def fresh(name):
        made = GraphStore(spark, f"file://{tmp_path}/{name}")
        made.commit(nodes=spark.createDataFrame([node("n1", "alpha", count=5, confidence=0.1), node("n2", "Beta", count=None, confidence=0.99, kind="U")], NODES))
        return made

    def rows_of(made):
        return sorted((r.id, r.observation_count, round(r.confidence, 6)) for r in made.nodes().collect())

    streamed, at_once, told = fresh("streamed"), fresh("at_once"), []
    stream = spark.readStream.schema(MENTIONS).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    crystallize.run(streamed, stream, "s", f"{tmp_path}/log", lambda done: told.append(done.first()), fuzzy=False).awaitTermination()
    crystallize.crystallize(at_once, table, "s", 0, fuzzy=False)
    assert len(told) >= 3 and sum(r.mentions for r in told) == table.filter("trim(name) <> ''").count()
    expected = rows_of(at_once)
    assert rows_of(streamed) == expected
    mine = [(n, t, c) for n, t, c in rows if n and n.strip()]
    assert dict((i, c) for i, c, _ in expected)["n1"] == 5 + sum(n.strip().lower() == "alpha" and t == "T" for n, t, _ in mine)
    before = streamed.manifest()
    again = crystallize.crystallize(streamed, table, "s", 0).first()
    assert streamed.manifest() == before and rows_of(streamed) == expected and (again.merged, again.created) == (0, 0)


def test_similar_names_are_merged(spark, tmp_path):
    made = GraphStore(spark, f"file://{tmp_path}/fuzzy")
    made.commit(nodes=spark.createDataFrame([node("n1", "customer account", count=1)], NODES))
    done = crystallize.crystallize(made, spark.createDataFrame([("Customer acount", "T", 0.9), ("customer account", "T", 0.3), ("supplier", "T", 0.4)], MENTIONS), "s", 0).first()
    assert (done.mentions, done.merged, done.created) == (3, 2, 1)
    n1 = made.nodes().filter("id = 'n1'").first()
    assert (n1.observation_count, n1.confidence, n1.name) == (3, 0.9, "customer account") and made.nodes().count() == 2


def test_first_commit_folds_rows_once_and_finds_lacking_nodes_once(spark, tmp_path, monkeypatch):
    read, found = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(df, counter):
        return df.sparkSession.createDataFrame(df.rdd.map(lambda r: (counter.add(1), r)[1]), df.schema)

    plain = graph_store.placeholders
    monkeypatch.setattr(graph_store, "placeholders", lambda nodes, edges: counted(plain(nodes, edges), found))
    made = GraphStore(spark, f"file://{tmp_path}/graph")
    edges = spark.createDataFrame([("a", "SEES", f"ghost{i % 7}", 0.5) for i in range(10)], EDGES)
    made.commit(nodes=counted(spark.createDataFrame([node(f"n{i}") for i in range(10)] + [node("a"), node("a", name="z")], NODES), read), edges=edges)
    assert ids(made.nodes()) == ["a", *(f"ghost{i}" for i in range(7)), *(f"n{i}" for i in range(10))] and made.nodes().filter("id = 'a'").first().name == "z"
    assert (read.value, found.value) == (12, 7)

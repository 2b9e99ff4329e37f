import pytest

from strataweave.operators import graph
from strataweave.plans.fixtures import Tables
from strataweave.session import in_bytes, measured_session, megabytes


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Nodes of few bytes in their files and many in memory."""
    path = str(tmp_path_factory.mktemp("measured") / "nodes")
    spark.range(3_000_000).selectExpr("'order:' || id as id", "'n' as name").coalesce(1).write.option("compression", "zstd").parquet(path)
    return path


def test_large_nodes_of_small_files_are_not_broadcast(spark, stored):
    def plan(session):
        nodes = session.read.parquet(stored)
        edges = nodes.selectExpr("id as src", "'X' as rel_type", "id as dst")
        return graph.dangling(nodes, edges)._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastExchange" in plan(spark)  # by the size of the files
    assert "BroadcastExchange" not in plan(Tables(spark, "/nowhere").spark)


def test_measured_session_keeps_settings_and_leaves_the_callers(spark):
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(static)
    own = measured_session(spark)
    assert own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    assert (in_bytes(own.conf.get(static)), own.conf.get(adaptive)) == (256 << 10, before)
    assert spark.conf.get(static) == before and spark.conf.get(adaptive, None) is None
    own.conf.set(static, "-1")
    assert measured_session(own).conf.get(static) == "-1"
    assert (in_bytes("256k"), in_bytes("10485760b"), megabytes("8g"), megabytes("512k")) == (262144, 10485760, 8192, 0)


def test_tasks_of_a_measured_session_do_not_grow_with_the_table(spark):
    parts, files, shuffled = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    own = measured_session(spark)
    assert (own.conf.get(parts), in_bytes(own.conf.get(files)), in_bytes(own.conf.get(shuffled))) == ("200", 16 << 20, 32 << 20)
    assert spark.conf.get(parts, None) is None
    own.conf.set(shuffled, "1m")
    few, more = (own.range(n).selectExpr("sha2(string(id), 256) as id").groupBy("id").count().rdd.getNumPartitions() for n in (1_000, 300_000))
    assert few <= 4 < more  # never more than the four parts of the session before
    own.conf.set(parts, "7")
    assert measured_session(own).conf.get(parts) == "7"

"""What registered queries broadcast, over tables whose files are below Spark's threshold and whose rows are many."""

import pytest

from strataweave import registry
from strataweave.plans import fixtures, q_store

FOLDER = "/root/testdata/sf0.01"
#: Bytes of files that are sent unseen, and rows of one broadcast, for tables of some 20,000 nodes.
UNSEEN, MOST = 4_000, 4_000


@pytest.fixture
def by_files(spark, monkeypatch):
    """A session in which tables are sent by the size of their files alone, not by what a shuffle has measured."""
    own = spark.newSession()
    for key, value in {"spark.sql.shuffle.partitions": 4, "spark.sql.autoBroadcastJoinThreshold": 10 << 20, "spark.sql.adaptive.autoBroadcastJoinThreshold": -1}.items():
        own.conf.set(key, str(value))
    monkeypatch.setattr("strataweave.session.UNSEEN_BROADCAST", UNSEEN)
    monkeypatch.setattr(q_store, "_STORES", {})
    return own


def most_rows(name, session):
    """Rows of the largest broadcast while the query is made and run."""
    store = session._jsparkSession.sharedState().statusStore()
    each = lambda seq: (seq.apply(i) for i in range(seq.size()))
    before = {e.executionId() for e in each(store.executionsList())}
    registry.queries()[name](session, FOLDER).write.format("noop").mode("overwrite").save()
    session.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = [0]
    for e in each(store.executionsList()):
        if e.executionId() not in before:
            values = store.executionMetrics(e.executionId())
            for node in each(store.planGraph(e.executionId()).allNodes().toSeq()):
                if node.name() == "BroadcastExchange":
                    rows = (values.get(m.accumulatorId()) for m in each(node.metrics().toSeq()) if m.name() == "number of output rows")
                    found += [int(r.get().replace(",", "")) for r in rows if r.isDefined()]
    return max(found)


def test_nodes_are_sent_where_files_decide(by_files, monkeypatch):
    monkeypatch.setattr(fixtures, "measured_session", lambda session: session)
    assert most_rows("AGG-19", by_files) > MOST


@pytest.mark.parametrize("name", ["AGG-19", "AGG-21", "AGG-24", "SRC-02", "SRC-03", "SRC-20", "STR-02-promote", "STR-04", "FLT-13", "FLT-19", "TOP-02", "SCL-03"])
def test_tables_are_not_sent_whole_through_the_driver(by_files, name):
    assert most_rows(name, by_files) <= MOST

"""The partitioned graph store and what writes to it, as registered queries."""

import uuid

from pyspark.sql import functions as F

from ..operators import storage
from ..session import shared_dir
from ..sources.graph_store import GraphStore
from ..streaming import crystallize, events
from .fixtures import query

_STORES: dict[tuple, GraphStore] = {}


def _new(t, name):
    return GraphStore(t.spark, f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}")


def _published(t):
    """The derived graph in a store, written once a session."""
    key = (t.spark.sparkContext.applicationId, shared_dir(t.spark), t.sf_dir)
    if key not in _STORES:
        store = _new(t, "graph")
        store.commit(nodes=t.nodes, edges=t.edges)
        _STORES[key] = store
    return GraphStore(t.spark, _STORES[key].path)


@query("SRC-02", "SELECT src, dst, confidence FROM {edges} WHERE rel_type = 'SUPPLIES' AND src = 'supplier:3'")
def _(t):
    return _published(t).edges(rel_type="SUPPLIES", src="supplier:3").select("src", "dst", "confidence")


@query("SRC-03", "SELECT id, name, confidence FROM {nodes} WHERE layer = 'SEMANTIC' AND status = 'active' ORDER BY id LIMIT 200")
def _(t):
    return storage.page(_published(t).nodes("SEMANTIC", "active").select("id", "name", "confidence"), "id", 0, 200)


@query("SRC-04", """SELECT id, name, CASE WHEN k % 20 = 0 THEN 'closed' ELSE status END AS status, CASE WHEN k % 40 = 0 THEN 'REASONING' ELSE layer END AS layer, confidence, CASE WHEN k % 20 = 0 THEN list_contains(labels, 'Entity')::INT + 2 ELSE len(labels) END AS labels FROM {nodes}
  UNION ALL SELECT 'brand:' || p_brand, NULL, 'open', 'SEMANTIC', NULL, 1 FROM part GROUP BY p_brand""")
def _(t):
    """Upsert of known nodes, some of which change their layer, and of new ones."""
    store = _new(t, "upserted")
    store.commit(nodes=t.nodes)
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in t.nodes.schema}
    some = t.nodes.filter("k % 20 = 0").select(*(
        {"id": F.col("id"), "status": F.lit("closed").alias("status"), "layer": F.when(F.col("k") % 40 == 0, "REASONING").otherwise(F.col("layer")).alias("layer"), "labels": F.array(F.lit("Touched")).alias("labels")}.get(c, none[c]) for c in t.nodes.columns))
    made = t.part.select(*({"id": F.concat(F.lit("brand:"), "p_brand").alias("id"), "status": F.lit("open").alias("status"), "layer": F.lit("SEMANTIC").alias("layer"), "labels": F.array(F.lit("Brand")).alias("labels")}.get(c, none[c]) for c in t.nodes.columns))
    store.commit(nodes=some.union(made))
    return store.nodes().select("id", "name", "status", "layer", "confidence", F.size("labels").alias("labels"))


@query("SRC-20", """WITH e AS (SELECT * FROM {edges} WHERE rel_type IN ('BELONGS_TO', 'PART_OF')), n AS (SELECT * FROM {nodes} WHERE id LIKE 'supplier:%' OR id LIKE 'nation:%'), ends AS (SELECT src AS id FROM e UNION SELECT dst FROM e)
  SELECT 'node' AS kind, id, name FROM n UNION ALL SELECT 'bare', id, NULL FROM ends WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT rel_type, src, dst FROM e""")
def _(t):
    """Nodes and edges of one batch appear together; a batch whose edges fail leaves its nodes unseen."""
    store = _new(t, "batches")
    store.commit(nodes=t.nodes.filter("id like 'supplier:%' or id like 'nation:%'"), edges=t.edges.filter("rel_type in ('BELONGS_TO', 'PART_OF')"))
    try:
        store.commit(nodes=t.nodes.filter("id like 'order:%'"), edges=t.edges.filter("rel_type = 'PLACED'"), valid={"edges": "confidence >= 0.5"})
    except ValueError:  # some are below, so the batch is refused as a whole
        pass
    nodes = store.nodes().select(F.when(F.array_contains("labels", "Entity") & F.col("name").isNull(), "bare").otherwise("node").alias("kind"), "id", "name")
    return nodes.union(store.edges().select(F.col("rel_type").alias("kind"), F.col("src").alias("id"), F.col("dst").alias("name")))


@query("STR-04", """WITH m AS (SELECT lower('Order ' || (event_id % 40000)::VARCHAR) AS key, 'InformationAsset' AS type, count(*) AS n, max(value / 500) AS c FROM events GROUP BY 1, 2), known AS (SELECT lower(trim(name)) AS key, type, min(id) AS id FROM {nodes} GROUP BY 1, 2),
  r AS (SELECT m.*, known.id FROM m LEFT JOIN known USING (key, type))
  SELECT x.id, x.observation_count + coalesce(r.n, 0) AS observation_count, greatest(x.confidence, coalesce(r.c, 0)) AS confidence FROM {nodes} x LEFT JOIN r ON r.id = x.id
  UNION ALL SELECT 'entity:' || substr(sha256(key || chr(31) || type), 1, 24), n, c FROM r WHERE id IS NULL""")
def _(t):
    """Events as mentions of orders, crystallized a micro-batch at a time into the stored nodes."""
    store = _new(t, "crystallized")
    store.commit(nodes=t.nodes.withColumn("observation_count", F.col("observation_count").cast("long")))
    stream = events.read(t.spark, f"{t.sf_dir}/events.parquet")
    mentions = stream.select(F.concat(F.lit("Order "), (F.col("event_id") % 40000).cast("string")).alias("name"), F.lit("InformationAsset").alias("type"), (F.col("value") / 500).alias("confidence"))
    crystallize.run(store, mentions, "events", f"{store.path}-log", fuzzy=False).awaitTermination()
    return store.nodes().select("id", "observation_count", "confidence")

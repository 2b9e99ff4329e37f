"""Jobs over a graph store and a folder of documents: promotion on events, promotion scans, assessment of new documents.

Each keeps its place, so that a run over what has not changed writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_id
from ..operators import validation
from ..session import materialize
from ..sources.graph_store import GraphStore

#: Event by the layer that it promotes from.
ACTIONS = {"entity_created": "PERCEPTION", "entity_updated": "SEMANTIC"}
SUMMARY = "stream string, batch long, candidates long, promoted long"


def _summary(spark: SparkSession, stream: str, number: int, candidates: int, promoted: int) -> DataFrame:
    return spark.createDataFrame([(stream, number, candidates, promoted)], SUMMARY)


def promote(store: GraphStore, candidates: DataFrame, stream: str, number: int) -> DataFrame:
    """Move the candidates (id, layer, target) that still are in their layer to the target and return a summary: stream, batch, candidates, promoted.

    Stored nodes need the columns ``promoted_from`` and ``version``. A number that the stream has published changes nothing; neither do ids that are not stored, or are in another layer by now.
    """
    spark, manifest = store.spark, store.manifest()
    if manifest.batches.get(stream, -1) >= number:
        return _summary(spark, stream, number, 0, 0)
    wanted = materialize(candidates.groupBy("id", "layer").agg(F.max("target").alias("_target")), "candidates")
    nodes = store.nodes(manifest=manifest)
    moved = nodes.join(wanted, ["id", "layer"]).withColumns({"promoted_from": F.col("layer"), "version": (F.coalesce("version", F.lit(1)) + 1).cast(nodes.schema["version"].dataType)})
    moved = materialize(moved.withColumn("layer", F.col("_target")).select(*nodes.columns), "promoted")
    promoted = moved.count()
    if promoted:
        store.commit(nodes=moved, batch=(stream, number))
    return _summary(spark, stream, number, wanted.count(), promoted)


def on_events(store: GraphStore, events: DataFrame, stream: str, log: str, tell: Callable[[DataFrame], None] | None = None, every: str | None = None):
    """A streaming query that promotes the entities of (action, id, layer, and what ``validation.automatic_target`` reads) that qualify.

    A created entity without a layer counts as perception; other actions and layers are passed over.
    """
    layer = F.when((F.col("action") == "entity_created") & F.col("layer").isNull(), "PERCEPTION").otherwise(F.col("layer"))
    asked = events.withColumn("layer", layer)
    asked = asked.filter(F.coalesce(*(F.when(F.col("action") == a, F.col("layer") == x) for a, x in ACTIONS.items()), F.lit(False)))
    asked = asked.withColumn("target", validation.automatic_target()).filter("target is not null").select("id", "layer", "target")

    def work(batch: DataFrame, number: int) -> None:
        done = promote(store, batch, stream, number)
        if tell:
            tell(done)

    writer = asked.writeStream.option("checkpointLocation", log).foreachBatch(work)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def scan(store: GraphStore, name: str = "scan", layers: tuple[str, ...] = ("PERCEPTION", "SEMANTIC")) -> DataFrame:
    """Promote whatever qualifies, a layer after the other, and return a summary a layer.

    Only the layer's folder is read for candidates. What reaches the next layer is looked at again there, as its own scan would.
    """
    told = []
    for layer in layers:
        stream = f"{name}-{layer}"
        number = store.manifest().batches.get(stream, -1) + 1
        found = store.nodes(layer).withColumn("target", validation.automatic_target()).filter("target is not null").select("id", "layer", "target")
        told += [tuple(r) for r in promote(store, found, stream, number).collect()]  # one row
    return store.spark.createDataFrame(told, SUMMARY)


def assess_new(documents: DataFrame, folder: str, log: str, assess: Callable[[DataFrame], DataFrame], key: str = "doc_id", every: str | None = None):
    """A streaming query that assesses each text of (key, text) once: ``assess`` gets the new ones of a batch and gives a row each; read them with ``assessed``.

    New is what has no row with this key and content yet, so a document that comes again is assessed only if it has changed. A batch that is run again replaces itself; one without new texts writes nothing.
    """

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("content_id", content_id(F.coalesce("text", F.lit("")))).dropDuplicates([key, "content_id"])
        held = assessed(spark, folder)
        if held is not None:
            rows = rows.join(held.filter(F.col("batch") != number).select(key, "content_id"), [key, "content_id"], "left_anti")
        rows = materialize(rows, "unassessed")
        if not rows.isEmpty():
            made = assess(rows.drop("content_id"))
            made.join(rows.select(key, "content_id"), key).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = documents.writeStream.option("checkpointLocation", log).foreachBatch(work)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def assessed(spark: SparkSession, folder: str) -> DataFrame | None:
    """All assessments with their content_id and batch; None before the first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.option("basePath", folder).parquet(folder) if there else None

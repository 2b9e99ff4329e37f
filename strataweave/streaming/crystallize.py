"""Crystallization: mentions of entities, a micro-batch at a time, into the nodes of a graph store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import resolve
from ..session import materialize
from ..sources.graph_store import GraphStore


def gathered(mentions: DataFrame) -> DataFrame:
    """One row a normalised name and type of (name, type, confidence): key, name, type, observations, confidence."""
    rows = mentions.filter(F.trim("name") != "").groupBy(F.lower(F.trim("name")).alias("key"), F.coalesce("type", F.lit("Entity")).alias("type"))
    return rows.agg(F.min(F.trim("name")).alias("name"), F.count("*").alias("observations"), F.max("confidence").alias("confidence"))


def resolved(batch: DataFrame, nodes: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Adds ``id`` to the gathered rows: a node of that name and type, else the most similar name of the type, else null."""
    same = nodes.groupBy(F.lower(F.trim("name")).alias("key"), "type").agg(F.min("id").alias("known"))
    exact = batch.join(same, ["key", "type"], "left")
    if not fuzzy:
        return exact.withColumnRenamed("known", "id")
    open_ = exact.filter("known is null").select(F.concat_ws("\x1f", "key", "type").alias("in_id"), "name", "type")
    found = resolve.fuzzy_matches(open_, nodes.select("id", "name", "type"))
    best = found.groupBy("in_id").agg(F.min_by("cand_id", F.struct(-F.col("score"), "cand_id")).alias("near"))
    near = best.select(F.split_part("in_id", F.lit("\x1f"), F.lit(1)).alias("key"), F.split_part("in_id", F.lit("\x1f"), F.lit(2)).alias("type"), "near")
    return exact.join(near, ["key", "type"], "left").select("key", "type", "name", "observations", "confidence", F.coalesce("known", "near").alias("id"))


def crystallize(store: GraphStore, mentions: DataFrame, stream: str, number: int, layer: str = "PERCEPTION", fuzzy: bool = True) -> DataFrame:
    """Merge a batch's mentions into the store and return its summary: batch, mentions, merged, created.

    A known entity's observation_count grows by its mentions and its confidence becomes the greater one; others become nodes of ``layer``. Several names of a batch that resolve to one node add up.
    A batch number that the store has published changes nothing and its summary is empty of work (merged and created are 0).
    """
    manifest, spark = store.manifest(), mentions.sparkSession
    if manifest.batches.get(stream, -1) >= number:
        return spark.createDataFrame([(number, 0, 0, 0)], "batch long, mentions long, merged long, created long")
    nodes = store.nodes(manifest=manifest)
    rows = materialize(resolved(gathered(mentions), nodes, fuzzy), "crystallized")
    hits = rows.filter("id is not null").groupBy("id").agg(F.sum("observations").alias("more"), F.max("confidence").alias("seen"))
    old = nodes.join(hits, "id").withColumns({"observation_count": F.coalesce("observation_count", F.lit(0)) + F.col("more"), "confidence": F.greatest("confidence", "seen")}).drop("more", "seen")
    made = rows.filter("id is null").select(
        F.concat(F.lit("entity:"), F.substring(F.sha2(F.concat_ws("\x1f", "key", "type"), 256), 1, 24)).alias("id"), "name", "type", F.array(F.col("type")).alias("labels"), F.lit(layer).alias("layer"),
        "confidence", F.col("observations").alias("observation_count"),
    )
    kinds = {f.name: f.dataType for f in nodes.schema}
    shaped = lambda df: df.select(*(F.col(c).cast(k) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))
    store.commit(nodes=materialize(shaped(old).union(shaped(made)), "crystallized-nodes"), batch=(stream, number))
    return rows.agg(
        F.lit(number).cast("long").alias("batch"), F.coalesce(F.sum("observations"), F.lit(0)).alias("mentions"), F.count_if(F.col("id").isNotNull()).alias("merged"), F.count_if(F.col("id").isNull()).alias("created"))


def run(store: GraphStore, mentions: DataFrame, stream: str, log: str, tell: Callable[[DataFrame], None] | None = None, every: str | None = None, fuzzy: bool = True):
    """A streaming query that crystallizes each micro-batch; ``log``: its checkpoint, ``tell`` gets each summary. Without ``every`` (such as 5 minutes) it takes what is there and ends."""

    def work(batch: DataFrame, number: int) -> None:
        done = crystallize(store, batch, stream, number, fuzzy=fuzzy)
        if tell:
            tell(done)

    writer = mentions.writeStream.option("checkpointLocation", log).foreachBatch(work)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

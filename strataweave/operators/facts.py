"""Hypergraph facts from entities that occur together in text chunks: mentions (chunk_id, doc_id, seq, entity, type, confidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def entity_sets(mentions: DataFrame, least: int = 2) -> DataFrame:
    """chunk_id, entities (sorted), n: chunks with at least ``least`` entities; no pairs are made."""
    rows = mentions.groupBy("chunk_id").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    return rows.withColumn("n", F.size("entities").cast("long")).filter(F.col("n") >= least)


def type_pairs(mentions: DataFrame, more_than: int = 5, top: int = 50) -> DataFrame:
    """type_a, type_b, n: how often entities of two types share a chunk, the entity of type_a being the smaller.

    Each mention is counted against the running counts of its own chunk's types, so rows are mentions times types of a chunk and no pairs of mentions are made; null types are left out.
    """
    one = mentions.filter("type is not null").select("chunk_id", "entity", "type").distinct()
    met = one.join(one.select("chunk_id", F.col("type").alias("type_a")).distinct(), "chunk_id")
    same = F.col("type") == F.col("type_a")
    within = Window.partitionBy("chunk_id", "type_a")
    smaller = F.count_if(same).over(within.orderBy("entity").rangeBetween(Window.unboundedPreceding, 0)) - F.count_if(same).over(Window.partitionBy("chunk_id", "type_a", "entity"))
    rows = met.select("type_a", F.col("type").alias("type_b"), smaller.alias("k")).groupBy("type_a", "type_b").agg(F.sum("k").alias("n"))
    return rows.filter(F.col("n") > more_than).orderBy(F.desc("n"), "type_a", "type_b").limit(top)


def build(mentions: DataFrame, texts: DataFrame | None = None, least_confidence: float = 0.6, least_entities: int = 2) -> DataFrame:
    """fact_id, chunk_id, entities, n, confidence, fact_type: one fact a chunk whose mentions are confident and diverse enough.

    A drug or disease with a treatment or medication is a treatment; a cause or effect, or a text (chunk_id, text) that says causes, a causation;
    mentions of one type are hierarchical; others an association.
    """
    rows = mentions.groupBy("chunk_id").agg(
        F.array_sort(F.collect_set("entity")).alias("entities"), F.avg("confidence").alias("c"), F.collect_set(F.lower("type")).alias("kinds"), F.count_distinct("type").alias("diversity"))
    rows = rows.filter((F.size("entities") >= least_entities) & (F.round("c", 9) >= least_confidence))  # whatever the order of the sum
    has = lambda *t: F.arrays_overlap("kinds", F.array(*map(F.lit, t)))
    causal = has("cause", "effect")
    if texts is not None:
        said = texts.filter(F.contains(F.lower("text"), F.lit("causes"))).select("chunk_id", F.lit(True).alias("says_causes")).distinct()
        rows = rows.join(said, "chunk_id", "left")
        causal = causal | F.coalesce("says_causes", F.lit(False))
    kind = F.when(has("drug", "disease") & has("treatment", "medication"), "treatment").when(causal, "causation").when(F.col("diversity") == 1, "hierarchical").otherwise("association")
    digest = F.sha2(F.concat_ws(":", "chunk_id", F.array_join("entities", ":")), 256)
    return rows.select(digest.alias("fact_id"), "chunk_id", "entities", F.size("entities").cast("long").alias("n"), F.round("c", 6).alias("confidence"), kind.alias("fact_type"))


def hyperedges(facts: DataFrame) -> DataFrame:
    """fact_id, entity, position, confidence."""
    return facts.select("fact_id", "confidence", F.posexplode("entities").alias("position", "entity"))


def statistics(facts: DataFrame) -> DataFrame:
    rows = facts.groupBy("fact_type").agg(F.count("*").alias("facts"), F.sum("n").alias("participants"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count_if(F.col("confidence") >= 0.7).alias("confident"))
    return rows


def chains(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Two-hop chains e1 - f1 - bridge - f2 - e2 from the start entities; confidence is the facts' mean."""
    h = edges.select("fact_id", "entity", "confidence")
    a = h.join(starts.select("entity").distinct(), "entity", "left_semi").select(F.col("fact_id").alias("f1"), F.col("entity").alias("e1"), F.col("confidence").alias("c1"))
    rows = a.join(h.select(F.col("fact_id").alias("f1"), F.col("entity").alias("bridge")), "f1").filter("bridge <> e1")
    rows = rows.join(h.select(F.col("fact_id").alias("f2"), F.col("entity").alias("bridge"), F.col("confidence").alias("c2")), "bridge").filter("f1 <> f2")
    rows = rows.join(h.select(F.col("fact_id").alias("f2"), F.col("entity").alias("e2")), "f2").filter("e2 <> e1 and e2 <> bridge")
    return rows.select("e1", "f1", "bridge", "f2", "e2", F.round((F.col("c1") + F.col("c2")) / 2, 6).alias("confidence"))


def of_entity(edges: DataFrame, entity: str, limit: int = 50) -> DataFrame:
    """An entity's facts with the others in them, most confident first."""
    own = edges.filter(F.col("entity") == entity).select("fact_id", "confidence")
    others = edges.filter(F.col("entity") != entity).join(own.select("fact_id"), "fact_id", "left_semi").groupBy("fact_id").agg(F.array_join(F.array_sort(F.collect_set("entity")), ",").alias("others"))
    return own.join(others, "fact_id", "left").orderBy(F.desc("confidence"), "fact_id").limit(limit)


def propagate(edges: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """a < b pairs of entities that share a confident fact and have no edge yet, with the best fact."""
    h = edges.filter(F.col("confidence") >= least)
    pairs = h.select("fact_id", F.col("entity").alias("a"), "confidence").join(h.select("fact_id", F.col("entity").alias("b")), "fact_id").filter("a < b")
    best = pairs.groupBy("a", "b").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "fact_id")).alias("f"))
    seen = known.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return best.join(seen, ["a", "b"], "left_anti").select("a", "b", "f.fact_id", (-F.col("f.c")).alias("confidence"))


def cleanup(facts: DataFrame, edges: DataFrame, validated: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Facts and hyperedges without the unvalidated facts below a confidence."""
    kept = facts.filter(F.col("confidence") >= least).unionByName(facts.filter(F.col("confidence") < least).join(validated.select("fact_id").distinct(), "fact_id", "left_semi").select(*facts.columns))
    return kept, edges.join(kept.select("fact_id"), "fact_id", "left_semi")


def document_entities(chunks: DataFrame, mentions: DataFrame, type: str | None = None) -> DataFrame:
    """doc_id, entity, type: the entities that a document's chunks mention, each once; of one type if that is given."""
    found = chunks.select("doc_id", "chunk_id").join(mentions.select("chunk_id", "entity", "type"), "chunk_id")
    return (found.filter(F.col("type") == type) if type else found).select("doc_id", "entity", "type").distinct()

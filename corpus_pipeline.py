"""A corpus pipeline: quality filter, near-duplicate removal, source mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the
columns of ``documents``, and any others that ``docs`` has, whatever their names. Null and empty texts, null ids and sources, very long texts,
repeated rows, ties and empty tables have the results that each stage states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataweave.llm import mixing, ngram_jaccard, packing, quality_gam
from strataweave.session import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: drop the documents that the quality classifier rejects.

    The whole text alone decides. Null and empty texts are judged as texts without features; repeated rows share their fate; rows without an id
    are judged like any. Without labels nothing is dropped.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_gam.fit(docs, labels)
    own = [c for c in docs.columns if c.lower() == "score"]
    renamed = docs.withColumnsRenamed({c: f"{c}_of_docs" for c in own})
    kept = quality_gam.score(renamed, model).filter("score >= 0.5").drop("score")
    return kept.withColumnsRenamed({f"{c}_of_docs": c for c in own}).select(*docs.columns)


#: Stages on word shingles take five words and 0.8; the defaults are those of the query op3 alone.
NEAR = ngram_jaccard.Settings(words=5, numerator=80, denominator=100)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each class of near-duplicates stays, the one with the smallest id.

    Classes are the components of the links at 0.8 or more. Null and empty texts and texts without words are no copies of each other: one row
    an id stays. Repeated rows are one class; a row without an id stays only where its class has no id.
    """
    return ngram_jaccard.representatives(docs, NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: repeat or thin out documents to the sources' target weights.

    A null text has size 0 and a null source is a source of its own; equal rows draw alike. Rows of a source that its rate leaves out go; no row
    is there more than twice as often as before.
    """
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the pieces of all documents in windows that hold the mixture's proportions.

    A null or empty text is its end token; every copy of a repeated row is packed. Columns beside id, text and source are left out.
    """
    return packing.pack(docs).drop("ids")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixture", mix_sources),
    ("packing", pack_windows),
]

#: The classifier cannot be said in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""The operators of this subpackage as registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, cover_tree, genetic_packing, html_template, license_scan, lm_bloom, mixing, ngram_jaccard, packing, phrases, quality_gam, rp_forest, whitening
from .lm_bloom import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_bloom.score_documents(_table(spark, sf_dir, "documents"))


def op2_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.main_texts(_table(spark, sf_dir, "pages"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.classes(_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digests(chat_format.windows(conversations.unionByName(chat_format.planted(spark))))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string"))
    return license_scan.scan(docs.select("doc_id", path.alias("path"), "text"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).drop("ids")


def op7_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    scored = quality_gam.classify(docs, labels)
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genetic_packing.pack(_table(spark, sf_dir, "documents")).drop("ids")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


_QUERIES = (op1_lm_bloom, op2_html_template, op3_ngram_jaccard, op4_chat_format, op5_license_scan, op6_packing, op7_rp_forest, op8_cover_tree, op9_mixing, op10_quality_gam, op11_whitening, op12_genetic_packing, op13_phrases)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": mixing.ORACLE, "op13_phrases": phrases.ORACLE}

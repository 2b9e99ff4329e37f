"""Mixing sources to target weights (operator 9), with DataFrame functions only.

Tokens (words) are summed a source, targets derive a repetition rate a source, and each document is
emitted floor(rate) times plus one copy with probability equal to the rate's fraction, drawn from a
hash of its id, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to which their targets are broadcast (some MB).
MOST_BROADCAST = 100_000


def words_in(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to a table of (source, source_size), one row a source.

    Sources in code-point order, null last, take the weights in turn. Targets share ``share`` times all
    sizes by weight; none goes above ``most`` times its source's size, and what is cut is shared anew by
    weight. That fixed point is a water level: with sources in the order of most * size / weight, the
    first whose level holds for all after it gives the level of all that are not full. The two windows run
    over one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    ranked = sizes.withColumn(
        "weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    ).withColumn("cap", F.col("source_size") * most).withColumn("full_at", F.col("cap") / F.col("weight"))
    levels = ranked.withColumn(
        "level",
        (F.sum("source_size").over(Window.partitionBy()) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after),
    )
    level = levels.filter("level <= full_at").agg(F.min_by("level", F.struct("full_at", F.col("source").isNull(), "source")).alias("at"))
    return levels.join(F.broadcast(level), F.lit(True), "left").select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("at") * F.col("weight"), F.col("cap"))).alias("target")
    )


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the md5 of seed and id (without an id, of the text's md5)."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def _planned(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: int) -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct of size, source_size, target and copies, and that column's name."""
    name = next(n for i in range(len(docs.columns) + 1) if (n := f"_mix{i}").lower() not in {c.lower() for c in docs.columns})
    sized = docs.withColumn(name, words_in(F.col("text")))
    goals = targets(sized.groupBy("source").agg(F.sum(name).alias("source_size")), weights, share, most)
    goals = goals.select(F.col("source").alias(f"{name}s"), F.struct("source_size", "target").alias(f"{name}g"))
    goals = materialize(goals, "mixing-targets")  # a row a source: sent to all tasks if they are few, else joined by a shuffle
    goals = F.broadcast(goals) if goals.count() <= MOST_BROADCAST else goals
    total, target = F.col(f"{name}g.source_size"), F.col(f"{name}g.target")
    rate = F.when(total > 0, F.least(target / total, F.lit(most))).otherwise(0.0)
    copies = F.floor(rate) + F.when(draw(F.col("doc_id"), F.col("text"), seed) < rate - F.floor(rate), 1).otherwise(0)
    joined = sized.join(goals, F.col("source").eqNullSafe(F.col(f"{name}s")))
    row = F.struct(F.col(name).alias("size"), total.alias("source_size"), target.alias("target"), copies.cast("int").alias("copies"))
    return joined.withColumn(name, row).drop(f"{name}s", f"{name}g"), name


def plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """``docs`` with size, source_size, target and ``copies``, the number of times that the mix emits the row.

    Null text: size 0. Null source: a source of its own. Equal rows draw alike. Texts of any length are counted whole. An empty
    table gives an empty result. Columns named like the results are replaced. The sums a source are pre-aggregated, so that a
    source with most rows costs no more; the table joined back has one row a source.
    """
    added = ["size", "source_size", "target", "copies"]
    planned, name = _planned(docs.drop(*added), weights, share, most, seed)
    return planned.select(*[c for c in planned.columns if c != name], *(F.col(f"{name}.{c}").alias(c) for c in added))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the plan says, with the columns of ``docs``, whatever their names."""
    planned, name = _planned(docs, weights, share, most, seed)
    kept = planned.filter(f"{name}.copies > 0")
    return kept.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(f"{name}.copies")))).select(*docs.columns)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, text FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight,
         source_size::DOUBLE * 2.0::DOUBLE AS cap FROM sums
), levels AS (
  SELECT *, cap / weight AS full_at,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked
), goals AS (
  SELECT source, source_size, least(cap, weight * (SELECT level FROM levels WHERE level <= cap / weight ORDER BY cap / weight, source ASC NULLS LAST LIMIT 1)) AS target FROM levels
), rated AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN least(g.target / g.source_size, 2.0) ELSE 0.0 END AS rate,
         ('0x' || substr(md5('17:' || coalesce(s.doc_id::VARCHAR, 'text ' || md5(coalesce(s.text, '')))), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS draw
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM rated
"""

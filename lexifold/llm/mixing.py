"""Operator 1: mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, stash, table

SEED = "mix-1"
WEIGHTS = (3, 1, 2)
EPOCHS = 2
#: The words of the mix, as a fraction of the words of all documents.
SHARE = (3, 2)
#: Documents of a source stand in the order of a seeded hash; its first digits make up this many buckets, each totalled on its own.
BUCKET_DIGITS = 3
#: Equal rows at the edge are numbered in so many parts at most.
PARTS = 1024


def _key(seed: str, docs: DataFrame) -> Column:
    """A hash of the id, the text and all other columns: rows that share it are the same in every column."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", "source")]
    own = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("text"), F.lit("null")))]
    return F.md5(F.concat_ws(":", F.lit(seed), *own, *([F.md5(F.to_json(F.struct(*rest)))] if rest else [])))


def water_level(totals: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, share: tuple[int, int] = SHARE) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Each source's target is the smaller of its cap (epochs times its size) and its weight times a common level. The level is
    that at which the targets sum to share times all sizes: with sources in order of cap over weight, those before the first
    one that the level of the rest doesn't overfill are clamped, and the excess goes to the rest by weight. Sources are ranked
    by code point, null last, and take the weights in turn. One row per source, so windows without a partition are small.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = totals.withColumn("w", w).withColumn("cap", F.lit(epochs) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    left = F.lit(share[0]) * F.sum("source_size").over(every) - F.lit(share[1]) * F.coalesce(F.sum("cap").over(before), F.lit(0))
    leveled = ranked.withColumn("level", left / (F.lit(share[1]) * F.sum("w").over(onward)))
    # clamping a source that the level overfills raises the level of the rest, clamping any other lowers it: the highest is the one sought
    level = F.max("level").over(every)
    return leveled.withColumn("target", F.least(F.col("cap").cast("double"), F.col("w") * level)).select("source", "source_size", "target")


def mix_plan(docs: DataFrame, seed: str = SEED, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, share: tuple[int, int] = SHARE) -> DataFrame:
    """Per source: source_size, target, whole (copies that every row gets), cut and cut_n: rows whose hash key is less than cut get one
    more, and so do cut_n of those that have it.

    What is left of the target after whole copies is filled in the order of the hash, up to half of the document at the edge.
    The edge is found from totals per bucket, then in its own bucket only; no source is sorted as a whole.
    """
    base = docs.select(F.col("source").alias("source"), F.col("text").alias("text"), _key(seed, docs).alias("key")).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    buckets = stash(base.groupBy("source", "bucket").agg(F.sum(n_words(F.col("text"))).alias("size")), "mix-buckets")
    plan = water_level(buckets.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs, share)
    plan = plan.withColumn("whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("int"))
    plan = stash(plan.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    order = Window.partitionBy("source").orderBy("bucket")
    ends = buckets.withColumn("end", F.sum("size").over(order))
    ends = ends.withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source"))).where("end > extra and extra > 0")
    edge = stash(ends.groupBy("source", "extra").agg(F.min(F.struct("bucket", (F.col("end") - F.col("size")).alias("start"))).alias("e")).select(F.col("source").alias("s"), "extra", F.col("e.bucket").alias("b"), F.col("e.start").alias("start")), "mix-edge")
    near = base.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select("source", "key", "extra", "start", n_words(F.col("text")).alias("size"))
    inside = Window.partitionBy("source").orderBy("key")
    # rows of one key are equal, so they have one size
    near = near.groupBy("source", "key", "extra", "start").agg(F.max("size").alias("size"), F.count("*").alias("n"))
    near = near.withColumn("begin", F.col("start") + F.sum(F.col("size") * F.col("n")).over(inside) - F.col("size") * F.col("n"))
    fit = F.when(F.col("size") > 0, F.floor((F.col("extra") - F.col("begin")) / F.col("size") + 0.5)).when(F.col("begin") <= F.col("extra"), F.col("n")).otherwise(0)
    near = near.withColumn("take", F.least(F.col("n"), F.greatest(F.lit(0), fit)).cast("long")).where("take > 0")
    last = near.groupBy("source").agg(F.max(F.struct("key", "take", "n")).alias("last"))
    # with none taken in the edge bucket, the bucket's own name bounds the ones before it from above
    cuts = edge.join(last, F.col("s").eqNullSafe(F.col("source")), "left").select("s", F.coalesce("last.key", "b").alias("cut"), F.coalesce("last.take", F.lit(0)).alias("cut_n"), F.coalesce(F.col("last.take") < F.col("last.n"), F.lit(False)).alias("split"))
    return stash(plan.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", "cut", "cut_n", F.coalesce("split", F.lit(False)).alias("split")), "mix-cuts")


def _split_rows(rows: DataFrame) -> DataFrame:
    """Rows that stand at a cut in the midst of equal ones: cut_n of them get one copy more. They are counted by parts of the input,
    and each part gives its own again, so a third of all rows that are equal are neither gathered nor numbered in one task."""
    same = ["of", "key", "size", "source_size", "target", "whole", "cut_n", "part"]
    parts = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))).groupBy(*same).agg(F.first("row").alias("row"), F.count("*").alias("n"))
    ahead = Window.partitionBy("of", "key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("take", F.col("cut_n") - F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    each = parts.select("row", "size", "source_size", "target", "whole", "take", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"))
    return each.select("row", "size", "source_size", "target", (F.col("whole") + (F.col("i") <= F.col("take")).cast("int")).alias("copies"))


def mix_sources(docs: DataFrame, seed: str = SEED, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, share: tuple[int, int] = SHARE) -> DataFrame:
    """One row per document: row (a struct of all its columns), size (words), source_size, target, copies (0 to epochs).

    Null sources are a source of their own; null and empty texts have size 0 and sit in the mix like others; rows that share a
    doc_id are taken by their texts and other columns, equal rows one by one; a table without words has targets 0 and takes nothing;
    an empty table gives no rows. Columns whose names clash with these stay in row. Long texts are read whole. The same seed and
    rows give the same copies.
    """
    plan = mix_plan(docs, seed, weights, epochs, share).withColumnRenamed("source", "s")
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("of"), n_words(F.col("text")).alias("size"), _key(seed, docs).alias("key"))
    mixed = rows.join(plan, F.col("of").eqNullSafe(F.col("s")))
    copies = F.col("whole") + F.coalesce(F.col("key") <= F.col("cut"), F.lit(False)).cast("int")
    if plan.where("split").isEmpty():
        return mixed.select("row", "size", "source_size", "target", copies.alias("copies"))
    at_cut = F.coalesce(F.col("split") & (F.col("key") == F.col("cut")), F.lit(False))
    return mixed.where(~at_cut).select("row", "size", "source_size", "target", copies.alias("copies")).unionByName(_split_rows(mixed.where(at_cut)))


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it has copies, with its own columns."""
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat('mix-1:', coalesce(doc_id::VARCHAR, 'null'), ':', md5(coalesce(text, 'null')))) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2 * source_size AS cap FROM s),
l AS (
  SELECT *, (3 * sum(source_size) OVER () - 2 * coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (2 * sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM r),
t AS (SELECT source, source_size, least(cap::DOUBLE, w * (SELECT max(level) FROM l)) AS target FROM l),
p AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::INT AS whole FROM t),
c AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS extra,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS UNBOUNDED PRECEDING) AS stop
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN extra > 0 AND 2 * stop - size <= 2 * extra THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""

"""Resampling and multiple testing.

A bootstrap never copies data: statistics are first reduced to sums by locus, and a replicate is a weight for each locus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..deploy import ship
from ..genotypes import portable_hash
from ..shared import write_shared

__all__ = ["adjust_pvalues", "chi2_tail", "dense_index", "jackknife_blocks", "largest_remainder", "locus_weights", "normal_tail", "percentile_interval", "permuted_labels"]

_STEP = 1_000_003


def dense_index(loci: DataFrame, *order: str) -> DataFrame:
    """``loci`` with ``slot`` 0, 1, ... in the given order: places within sorted ranges plus the sizes of the ranges before.

    The ranges are sorted and numbered once, in a table of the shared folder that all later readers see alike; ties keep
    the order that they have there. No task sorts more than its range.
    """
    spark = loci.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The number is the task's in the upper bits and the place in the task's rows below.
    dealt = loci.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = write_shared(dealt, "slots").withColumn("__part", F.shiftright("__at", 33))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = sizes.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    place = F.col("__at").bitwiseAND((1 << 33) - 1)
    return dealt.join(F.broadcast(sizes), "__part").withColumn("slot", F.col("__base") + place).drop("__part", "__base", "__at")


def locus_weights(spark: SparkSession, n_loci: int, n_reps: int, seed: int = 0) -> DataFrame:
    """(rep, slot, w): how often each of ``n_loci`` draws of a replicate hits a slot; slots that are not hit are absent."""
    draws = spark.range(n_reps * n_loci).select((F.col("id") / n_loci).cast("int").alias("rep"), (F.col("id") % n_loci).alias("j"))
    slot = portable_hash(F.col("rep") * _STEP + F.col("j"), seed) % n_loci
    return draws.select("rep", slot.alias("slot")).groupBy("rep", "slot").agg(F.count("*").alias("w"))


def permuted_labels(samples: DataFrame, n_reps: int, seed: int, *keys: str) -> DataFrame:
    """``samples(keys.., sample_idx, population)`` for each ``rep`` with populations dealt anew within ``keys``: the k-th
    sample in the replicate's hash order gets the k-th label in id order."""
    reps = samples.sparkSession.range(n_reps).select(F.col("id").cast("int").alias("rep"))
    all_reps = samples.crossJoin(F.broadcast(reps))  # as many copies as replicates are asked for
    own = Window.partitionBy(*keys, "rep").orderBy("population", "sample_idx")
    shuffled = Window.partitionBy(*keys, "rep").orderBy(portable_hash(F.col("rep") * _STEP + F.col("sample_idx"), seed), "sample_idx")
    ranked = all_reps.withColumn("__own", F.row_number().over(own)).withColumn("__new", F.row_number().over(shuffled))
    labels = ranked.select(*keys, "rep", F.col("__own").alias("__new"), "population")
    return ranked.drop("population", "__own").join(labels, [*keys, "rep", "__new"]).drop("__new")


def percentile_interval(values: DataFrame, value: str, *keys: str, level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return values.groupBy(*keys).agg(F.percentile(value, tail).alias("lower"), F.percentile(value, 1 - tail).alias("upper"))


def jackknife_blocks(n_loci: int, block_size: int = 500) -> tuple[int, int]:
    """(block size, blocks): whole blocks only; with fewer loci than a block, halves."""
    size = block_size if n_loci >= block_size else max(n_loci // 2, 1)
    return size, n_loci // size


#: Ranks that a task of ``adjust_pvalues`` takes.
RANKS = 100_000


def adjust_pvalues(rows: DataFrame, p: str, method: str, *keys: str) -> DataFrame:
    """``rows`` with ``p_adj``: bonferroni, holm or fdr_bh within ``keys``; a null p stays null and counts nowhere.

    Values get their ranks from ``dense_index``; the running extremes go through parts of ``RANKS`` ranks, and on from
    part to part by each part's own extreme, so that no task holds all values of a key.
    """
    if method not in ("bonferroni", "holm", "fdr_bh"):
        raise ValueError(f"unknown correction: {method}")
    none = rows.filter(F.col(p).isNull()).withColumn("p_adj", F.lit(None).cast("double"))
    known = dense_index(rows.filter(F.col(p).isNotNull()).withColumn("__key", F.struct(F.lit(0), *keys)), "__key", p)
    facts = known.groupBy("__key").agg(F.count("*").alias("__n"), F.min("slot").alias("__first"))  # a row a key
    ranked = known.join(F.broadcast(facts), "__key").withColumn("__rank", F.col("slot") - F.col("__first")).withColumn("__part", F.floor(F.col("__rank") / RANKS))
    if method == "bonferroni":
        ranked = ranked.withColumn("__best", F.col(p) * F.col("__n"))
    else:
        down = method == "fdr_bh"
        # Of equal values, the last rank is the one that counts for fdr_bh, the first for holm; the running extreme spreads it.
        value = F.col(p) * F.col("__n") / (F.col("__rank") + 1) if down else F.col(p) * (F.col("__n") - F.col("__rank"))
        pick, order = (F.min, F.desc) if down else (F.max, F.asc)
        within = Window.partitionBy("__key", "__part").orderBy(order("__rank")).rowsBetween(Window.unboundedPreceding, 0)
        before = Window.partitionBy("__key").orderBy(order("__part")).rowsBetween(Window.unboundedPreceding, -1)  # a row a part
        ranked = ranked.withColumn("__x", value)
        parts = ranked.groupBy("__key", "__part").agg(pick("__x").alias("__e")).withColumn("__outer", pick("__e").over(before)).drop("__e")
        ranked = ranked.withColumn("__best", pick("__x").over(within)).join(F.broadcast(parts), ["__key", "__part"])
        ranked = ranked.withColumn("__best", (F.least if down else F.greatest)("__best", "__outer"))
    found = ranked.withColumn("p_adj", F.least(F.lit(1.0), F.col("__best")))
    return found.select(*rows.columns, "p_adj").unionByName(none)


def largest_remainder(rows: DataFrame, weight: str, total: int, order: str, *by: str) -> DataFrame:
    """``rows`` with ``share``: ``total`` (for each value of ``by``, if given) dealt in proportion to ``weight``, whole numbers, the largest remainders rounded up."""
    every = Window.partitionBy(*by or [F.lit(0)])
    exact = F.col(weight) * F.lit(total) / F.sum(weight).over(every)
    rows = rows.withColumn("__exact", exact).withColumn("__floor", F.floor("__exact"))
    left = F.lit(total) - F.sum("__floor").over(every)
    rank = F.row_number().over(every.orderBy(F.desc(F.round(F.col("__exact") - F.col("__floor"), 9)), order))
    return rows.withColumn("share", (F.col("__floor") + F.when(rank <= left, 1).otherwise(0)).cast("long")).drop("__exact", "__floor")


def _erfc(spark: SparkSession, c: Column) -> Column:
    ship(spark)

    @F.pandas_udf("double")
    def erfc(x):
        return x.map(lambda v: None if v is None or v != v else math.erfc(v))

    return erfc(c)


def normal_tail(spark: SparkSession, z: Column) -> Column:
    """Two-sided p of a standard normal."""
    return _erfc(spark, F.abs(z) / math.sqrt(2))


def chi2_tail(spark: SparkSession, x: Column) -> Column:
    """Upper tail of chi-squared with one degree of freedom."""
    return _erfc(spark, F.sqrt(x / 2))

"""Tables behind reports: pairwise layouts, published comparisons, curves and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import format_interval, format_pvalue, significance_stars

__all__ = ["calibration_summary", "filter_report", "outlier_table", "pairwise_layout", "published_comparison", "read_pairwise", "threshold_curves", "unique_section_ids"]


def read_pairwise(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """(pop1, pop2, value) of a result file in long form."""
    schema = "pop1 string, pop2 string, value double"
    return spark.read.schema(schema).option("header", True).csv(path) if kind == "csv" else spark.read.schema(schema).json(path)


def pairwise_layout(table: DataFrame, layout: str = "value_p") -> DataFrame:
    """(row, column, text) cells of rows (pop1, pop2, value, lower, upper, p) with pop1 < pop2.

    Layouts: value_p (values below the diagonal, p above), value_ci, value_stars, value (both triangles).
    """
    value = F.format_number("value", 3)
    above = {"value_p": format_pvalue(F.col("p")), "value_ci": format_interval(F.col("lower"), F.col("upper")), "value_stars": significance_stars(F.col("p")), "value": value}
    if layout not in above:
        raise ValueError(f"unknown layout: {layout}")
    below = F.concat(value, significance_stars(F.col("p"))) if layout == "value_stars" else value
    return table.select("pop1", "pop2", above[layout].alias("text")).toDF("row", "column", "text").unionByName(table.select(F.col("pop2").alias("row"), F.col("pop1").alias("column"), below.alias("text")))


def published_comparison(observed: DataFrame, published: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Rows (population, ne, ne_lower, ne_upper) beside published ones: relative error and overlap of intervals."""
    if published.groupBy("population").count().filter("count > 1").limit(1).count():
        raise ValueError("published rows repeat a population")
    p = published.select("population", *[F.col(c).alias(f"published_{c}") for c in ("ne", "ne_lower", "ne_upper")])
    joined = p.join(observed.select("population", "ne", "ne_lower", "ne_upper"), "population", "left")
    error = F.abs(F.col("ne") - F.col("published_ne")) / F.col("published_ne")
    overlap = (F.col("ne_lower") <= F.col("published_ne_upper")) & (F.col("ne_upper") >= F.col("published_ne_lower"))
    return joined.withColumn("relative_error", error).withColumn("intervals_overlap", overlap).withColumn("passes", (error <= tolerance) & overlap)


def calibration_summary(runs: DataFrame, truth: str, value: str, lower: str, upper: str, *keys: str) -> DataFrame:
    """By cell: bias, spread and the share of intervals that cover the truth."""
    covered = (F.col(lower) <= F.col(truth)) & (F.col(upper) >= F.col(truth))
    return runs.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(F.col(value) - F.col(truth)).alias("bias"), F.stddev_samp(value).alias("std"), F.avg(covered.cast("int")).alias("coverage"))


def threshold_curves(search: DataFrame) -> DataFrame:
    """Mean share of removed loci by method and threshold, over the other thresholds."""
    share = F.col("removed_count") / (F.col("removed_count") + F.col("kept_count"))
    long = search.select("filter_method", share.alias("share"), F.explode(F.map_from_arrays(F.array(F.lit("missing"), F.lit("maf"), F.lit("mac")), F.array(F.col("missing"), F.col("maf"), F.col("mac").cast("double")))).alias("kind", "threshold"))
    return long.groupBy("filter_method", "kind", "threshold").agg(F.avg("share").alias("removed_share"))


def filter_report(audit: DataFrame) -> str:
    """Text of an audit: a line a step."""
    return "\n".join(f"{r['step']}. {r['filter_method']}" + ("" if r["threshold"] is None else f" ({r['threshold']:g})") + f": kept {r['kept_count']} of {r['total_loci']}, removed {r['removed_count']}" for r in audit.orderBy("step").collect())


def outlier_table(outliers: DataFrame, limit: int = 50) -> DataFrame:
    """Wide table of the first outlier loci: a column a pair of populations."""
    first = outliers.select("locus_idx").distinct().orderBy("locus_idx").limit(limit)
    return outliers.dropDuplicates(["locus_idx", "population_pair"]).join(first, "locus_idx", "left_semi").groupBy("locus_idx").pivot("population_pair").agg(F.first("fst"))


def unique_section_ids(samples: DataFrame) -> DataFrame:
    """Sample names made unique within their section by a number."""
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("population").orderBy("sample_idx"))
    return samples.withColumn("sample_id", F.concat_ws("_", "population", rank.cast("string")))

"""Missingness, heterozygosity, diversity and allele summaries: one or two aggregates over the calls each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.iupac import BASES, copies, is_het, mask_of_code
from ..genotypes import GenotypeFrame

__all__ = [
    "allele_summary", "bootstrap_summary", "convergence_summary", "genotype_distribution", "het_rate_locus", "het_rate_sample", "heterozygosity", "heterozygosity_per_population",
    "missing_per_locus", "missing_per_population", "missing_per_population_locus", "missing_per_population_sample", "missing_per_sample", "missing_summary", "pooled_ratio", "population_sizes", "token_audit",
]


def _missing(frame: GenotypeFrame, *keys: str) -> DataFrame:
    rate = (F.count("*") - F.count("gt")) / F.count("*")
    return frame.with_population().groupBy(*keys).agg(F.round(rate, 4).alias("missing"))


def missing_per_locus(frame: GenotypeFrame) -> DataFrame:
    return _missing(frame, "locus_idx")


def missing_per_sample(frame: GenotypeFrame) -> DataFrame:
    return _missing(frame, "sample_idx")


def missing_per_population(frame: GenotypeFrame) -> DataFrame:
    return _missing(frame, "population")


def missing_per_population_locus(frame: GenotypeFrame) -> DataFrame:
    return _missing(frame, "population", "locus_idx")


def missing_per_population_sample(frame: GenotypeFrame) -> DataFrame:
    """(population, sample_idx, locus_idx, missing) of the cells without a call, as the long form of a table of flags."""
    return frame.with_population().filter("gt is null").select("population", "sample_idx", "locus_idx", F.lit(True).alias("missing"))


def missing_summary(frame: GenotypeFrame, digits: int = 4) -> DataFrame:
    """Mean, median and maximum of each missingness table; all tables from one pass by grouping sets."""
    calls = frame.with_population().withColumn("m", F.col("gt").isNull().cast("int"))
    calls.createOrReplaceTempView("__lociflow_missing")
    sets = frame.spark.sql(
        "SELECT grouping_id(locus_idx, sample_idx, population) AS g, avg(m) AS rate FROM __lociflow_missing"
        " GROUP BY GROUPING SETS ((locus_idx), (sample_idx), (population), (population, locus_idx))"
    )
    kinds = {3: "locus", 5: "sample", 6: "population", 2: "population_locus"}
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("g").cast("int"))
    return sets.groupBy(kind.alias("level")).agg(F.round(F.avg("rate"), digits).alias("mean"), F.round(F.percentile("rate", 0.5), digits).alias("median"), F.round(F.max("rate"), digits).alias("max"))


def het_rate_locus(frame: GenotypeFrame) -> DataFrame:
    """Heterozygous share of valid calls."""
    return _het(frame, "locus_idx")


def het_rate_sample(frame: GenotypeFrame) -> DataFrame:
    return _het(frame, "sample_idx")


def _het(frame: GenotypeFrame, key: str) -> DataFrame:
    rate = F.coalesce(F.sum(is_het(F.col("gt")).cast("int")), F.lit(0)) / F.greatest(F.count("gt"), F.lit(1))
    return frame.with_population().groupBy(key).agg(F.round(rate, 4).alias("het_rate"))


def population_sizes(frame: GenotypeFrame) -> DataFrame:
    return frame.samples.groupBy("population").agg(F.count("*").alias("n_samples"))


def dosage(frame: GenotypeFrame) -> DataFrame:
    """``with_population`` rows with ``dosage``: copies of non-reference bases, null if missing, outside the locus' alleles or of three bases."""
    from .encodings import encode_012

    return encode_012(frame).join(frame.samples.select("sample_idx", "population"), "sample_idx")


def _diversity(n: Column, het: Column, copies_: Column, zero: bool) -> list[Column]:
    p = copies_ / (2.0 * n)
    he = 2 * p * (1 - p)
    none = F.lit(0.0) if zero else F.lit(None).cast("double")
    return [F.when(n > 0, het / n).alias("ho"), F.when(n > 0, he).otherwise(none).alias("he"), F.when(n > 1, he * n / (n - 1)).otherwise(none).alias("pi")]


def heterozygosity(frame: GenotypeFrame) -> DataFrame:
    """Observed and expected heterozygosity and nucleotide diversity by locus; null where not estimable."""
    by = dosage(frame).groupBy("locus_idx").agg(F.count("dosage").alias("n"), F.coalesce(F.sum((F.col("dosage") == 1).cast("int")), F.lit(0)).alias("h"), F.sum("dosage").alias("c"))
    return by.select("locus_idx", *_diversity(F.col("n"), F.col("h"), F.col("c"), zero=False))


def heterozygosity_per_population(frame: GenotypeFrame) -> DataFrame:
    """The same within populations; there expected heterozygosity and diversity are 0 where there are too few calls, and
    populations without any call are left out."""
    by = dosage(frame).groupBy("population", "locus_idx").agg(F.count("dosage").alias("n"), F.coalesce(F.sum((F.col("dosage") == 1).cast("int")), F.lit(0)).alias("h"), F.sum("dosage").alias("c"))
    some = by.groupBy("population").agg(F.max("n").alias("most")).filter("most > 0")
    return by.join(some, "population", "left_semi").select("population", "locus_idx", *_diversity(F.col("n"), F.col("h"), F.col("c"), zero=True))


def genotype_distribution(frame: GenotypeFrame) -> DataFrame:
    return frame.with_population().groupBy(F.coalesce("gt", F.lit("N")).alias("gt")).agg(F.count("*").alias("n"))


def allele_summary(frame: GenotypeFrame) -> DataFrame:
    """One row of scalars over loci and samples: missingness, heterozygosity, richness, effective alleles, expected
    heterozygosity, inbreeding, singletons and minor-allele frequencies (all copies but the major allele's)."""
    gt = F.col("gt")
    cells = frame.with_population()
    counts = [F.sum(copies(gt, b)).alias(f"n_{b}") for b in BASES]
    loci = cells.groupBy("locus_idx").agg(F.count("*").alias("cells"), F.count("gt").alias("n"), F.coalesce(F.sum(is_het(gt).cast("int")), F.lit(0)).alias("het"), *counts)
    every = F.array(*(F.col(f"n_{b}") for b in BASES))
    total = F.aggregate(every, F.lit(0).cast("long"), lambda a, b: a + b)
    squares = F.aggregate(every, F.lit(0.0), lambda a, b: a + (b / F.col("total")) * (b / F.col("total")))
    loci = loci.withColumn("total", total).withColumn("squares", F.when(F.col("total") > 0, squares))
    loci = loci.select(
        "*",
        F.size(F.filter(every, lambda x: x > 0)).alias("alleles"),
        ((F.col("cells") - F.col("n")) / F.col("cells")).alias("missing"),
        F.when(F.col("n") > 0, F.col("het") / F.col("n")).alias("ho"),
        (1 - F.col("squares")).alias("he"),
        (1 / F.col("squares")).alias("effective"),
        F.when(F.col("total") > 0, (F.col("total") - F.array_max(every)) / F.col("total")).alias("maf"),
        F.get(F.sort_array(every, asc=False), 1).alias("second"),
    )
    loci = loci.withColumn("fis", F.when(F.col("he") > 0, 1 - F.col("ho") / F.col("he")).when(F.col("he") == 0, 0.0))
    share = lambda c: F.avg(c.cast("int"))
    per_locus = loci.agg(
        F.count("*").alias("n_loci"),
        *(f(c).alias(f"{c}_{name}") for c in ("missing", "ho", "he", "effective", "fis", "maf") for name, f in (("mean", F.avg), ("median", lambda x: F.percentile(x, 0.5)))),
        F.percentile("missing", 0.25).alias("missing_q1"),
        F.percentile("missing", 0.75).alias("missing_q3"),
        *(F.sum((F.col("alleles") == k).cast("long")).alias(name) for k, name in ((1, "monomorphic"), (2, "biallelic"), (3, "triallelic"), (4, "quadriallelic"))),
        F.avg("alleles").alias("richness_mean"),
        share((F.col("alleles") == 2) & (F.col("second") == 1)).alias("singleton_share"),
        *(share(F.col("maf") < t).alias(f"maf_below_{name}") for t, name in ((0.01, "1"), (0.05, "5"), (0.1, "10"))),
    )
    samples = cells.groupBy("sample_idx").agg(((F.count("*") - F.count("gt")) / F.count("*")).alias("m"), (F.coalesce(F.sum(is_het(gt).cast("int")), F.lit(0)) / F.greatest(F.count("gt"), F.lit(1))).alias("h"))
    per_sample = samples.agg(F.count("*").alias("n_samples"), F.avg("m").alias("sample_missing_mean"), F.percentile("m", 0.5).alias("sample_missing_median"), F.avg("h").alias("sample_het_mean"), F.percentile("h", 0.5).alias("sample_het_median"))
    joined = per_locus.crossJoin(per_sample)  # one row each
    return joined.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in joined.dtypes])


def token_audit(raw: DataFrame, column: str, loci: int = 1000) -> DataFrame:
    """Counts of raw tokens of the first loci: as they are, decoded, or skipped."""
    kept = raw.filter(F.col("locus_idx") < loci) if "locus_idx" in raw.columns else raw
    token = F.upper(F.col(column))
    return kept.groupBy(token.alias("token"), F.when(mask_of_code(token).isNotNull(), "decoded").otherwise("skipped").alias("outcome")).agg(F.count("*").alias("n"))


def bootstrap_summary(values: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean, standard deviation and the 95 percent interval over replicates, NaN and null left out."""
    kept = values.filter(F.col(value).isNotNull() & ~F.isnan(value))
    return kept.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.percentile(value, 0.025).alias("lower"), F.percentile(value, 0.975).alias("upper"), F.count("*").alias("n_reps"))


def convergence_summary(runs: DataFrame, value: str = "r2d") -> DataFrame:
    """By population and pair budget: spread of a statistic over seeds."""
    out = runs.groupBy("population", "max_pairs").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.withColumn("cv", F.when(F.col("mean") != 0, F.col("std") / F.abs("mean")))


def pooled_ratio(rows: DataFrame, top: str, bottom: str, *keys: str) -> DataFrame:
    """Ratio of sums with its linearised standard error over independent rows."""
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(top).alias("t"), F.sum(bottom).alias("b"), F.sum(F.col(top) * F.col(top)).alias("tt"), F.sum(F.col(bottom) * F.col(bottom)).alias("bb"), F.sum(F.col(top) * F.col(bottom)).alias("tb")
    )
    r = F.when(F.col("b") != 0, F.col("t") / F.col("b"))
    residuals = F.col("tt") - 2 * r * F.col("tb") + r * r * F.col("bb")
    se = F.when(F.col("n") > 1, F.sqrt(F.greatest(residuals, F.lit(0.0)) * F.col("n") / (F.col("n") - 1)) / F.abs("b"))
    return sums.select(*keys, "n", r.alias("ratio"), se.alias("se"))


def rolling_mean(rows: DataFrame, value: str, order: str, *keys: str, width: int = 5, interpolate: bool = False, every: int = 1) -> DataFrame:
    """Centred rolling mean; null where the window is not full.

    ``interpolate`` fills gaps on the line between the means around them (at an end, with the nearest one); ``every`` keeps
    each so many-th row, the first included.
    """
    half = width // 2
    own = Window.partitionBy(*keys).orderBy(order)
    w = own.rowsBetween(-half, half)
    out = rows.withColumn("rolling", F.when(F.count(value).over(w) == width, F.avg(value).over(w)))
    if not interpolate and every == 1:
        return out
    out = out.withColumn("__row", F.row_number().over(own) - 1)
    if interpolate:
        there = F.when(F.col("rolling").isNotNull(), F.struct(F.col("__row").alias("at"), F.col("rolling").alias("v")))
        out = out.withColumn("__a", F.last(there, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
        out = out.withColumn("__b", F.first(there, ignorenulls=True).over(own.rowsBetween(0, Window.unboundedFollowing)))
        a, b = F.col("__a"), F.col("__b")
        line = a["v"] + (b["v"] - a["v"]) * (F.col("__row") - a["at"]) / (b["at"] - a["at"])
        out = out.withColumn("rolling", F.coalesce("rolling", line, a["v"], b["v"])).drop("__a", "__b")
    return out.filter(F.col("__row") % every == 0).drop("__row")

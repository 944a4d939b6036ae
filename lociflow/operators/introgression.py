"""D statistics of four and five taxa from site-pattern sums."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import ConfigurationError
from ..genotypes import GenotypeFrame, portable_hash
from .encodings import encode_012
from .resampling import adjust_pvalues, chi2_tail, dense_index, jackknife_blocks, locus_weights, normal_tail

__all__ = ["METHODS", "combination_table", "d_jackknife", "d_per_combination", "d_significance", "d_statistics", "estimability", "least_missing_samples", "role_frequencies", "select_individuals", "significance_counts", "site_patterns"]

# Which patterns make each statistic, ancestral A and derived B by role (P1, P2, P3.., outgroup).
METHODS = {
    "patterson": {"D": (("ABBA",), ("BABA",))},
    "partitioned": {"D1": (("ABBAA",), ("BABAA",)), "D2": (("ABABA",), ("BAABA",)), "D12": (("ABBBA",), ("BABBA",))},
    "dfoil": {
        "DFO": (("BABAA", "BBBAA", "ABABA", "AAABA"), ("BAABA", "BBABA", "ABBAA", "AABAA")),
        "DFI": (("BABAA", "BABBA", "ABABA", "ABAAA"), ("ABBAA", "ABBBA", "BAABA", "BAAAA")),
        "DOL": (("BAABA", "BABBA", "ABBAA", "ABAAA"), ("ABABA", "ABBBA", "BABAA", "BAAAA")),
        "DIL": (("ABBAA", "BBBAA", "BAABA", "AAABA"), ("ABABA", "BBABA", "BABAA", "AABAA")),
    },
}


def role_frequencies(frame: GenotypeFrame, roles: list[str]) -> DataFrame:
    """(locus_idx, p0, p1, ..): derived frequency of each population in ``roles``, the outgroup last.

    Loci where a population has no call go, and those where the outgroup is at one half; where it is above, all are flipped.
    """
    if len(set(roles)) != len(roles) or len(roles) not in (4, 5):
        raise ValueError("roles must be four or five different populations")
    cells = encode_012(frame).join(F.broadcast(frame.samples.select("sample_idx", "population").filter(F.col("population").isin(roles))), "sample_idx")
    means = cells.groupBy("locus_idx").agg(*(F.avg(F.when(F.col("population") == r, F.col("dosage"))).alias(f"m{k}") for k, r in enumerate(roles)))
    return _polarised(means, len(roles))


def _polarised(means: DataFrame, n: int, *keys: str) -> DataFrame:
    every = reduce(lambda a, b: a & b, (F.col(f"m{k}").isNotNull() for k in range(n)))
    out = F.col(f"m{n - 1}") / 2
    kept = means.filter(every & (F.abs(out - 0.5) > 1e-12))
    return kept.select(*keys, "locus_idx", *[F.when(out > 0.5, 1 - F.col(f"m{k}") / 2).otherwise(F.col(f"m{k}") / 2).alias(f"p{k}") for k in range(n)])


def _weight(pattern: str) -> Column:
    return reduce(lambda a, b: a * b, (F.col(f"p{k}") if c == "B" else 1 - F.col(f"p{k}") for k, c in enumerate(pattern)))


def site_patterns(frequencies: DataFrame, method: str, *keys: str) -> DataFrame:
    """Left and right pattern weights of each statistic, by site."""
    names = []
    for name, (left, right) in METHODS[method].items():
        for side, patterns in (("l", left), ("r", right)):
            names.append(reduce(lambda a, b: a + b, map(_weight, patterns)).alias(f"{side}_{name}"))
    return frequencies.select(*keys, "locus_idx", *names)


def _statistic(name: str) -> Column:
    total = F.col(f"l_{name}") + F.col(f"r_{name}")
    return F.when(total != 0, (F.col(f"l_{name}") - F.col(f"r_{name}")) / total)


def _sums(patterns: DataFrame, method: str, *keys: str, weight: Column | None = None) -> DataFrame:
    w = F.lit(1) if weight is None else weight
    sums = patterns.groupBy(*keys).agg(F.sum(w).alias("n_sites"), *(F.sum(F.col(f"{s}_{n}") * w).alias(f"{s}_{n}") for n in METHODS[method] for s in "lr"))
    return sums.select(*keys, "n_sites", *[_statistic(n).alias(n) for n in METHODS[method]])


def d_statistics(frame: GenotypeFrame, roles: list[str], method: str) -> DataFrame:
    """One row with each statistic of the method."""
    return _sums(site_patterns(role_frequencies(frame, roles), method), method)


def d_jackknife(frame: GenotypeFrame, roles: list[str], method: str = "patterson", block_size: int = 500, compat: bool = False) -> DataFrame:
    """(statistic, value, se, z): delete-one-block jackknife; ``compat`` gives the plain deviation of the replicates."""
    patterns = dense_index(site_patterns(role_frequencies(frame, roles), method), "locus_idx")
    size, blocks = jackknife_blocks(patterns.count(), block_size)
    used = patterns.filter(F.col("slot") < size * blocks).withColumn("block", (F.col("slot") / size).cast("long"))
    names = [f"{s}_{n}" for n in METHODS[method] for s in "lr"]
    by_block = used.groupBy("block").agg(*(F.sum(c).alias(c) for c in names))
    total = by_block.agg(*(F.sum(c).alias(f"t_{c}") for c in names))
    left = by_block.crossJoin(F.broadcast(total)).select("block", *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in names])  # one row
    reps = left.select(*[_statistic(n).alias(n) for n in METHODS[method]])
    observed = total.select(*[F.col(f"t_{c}").alias(c) for c in names]).select(*[_statistic(n).alias(f"o_{n}") for n in METHODS[method]])
    n = F.count("*").cast("double")
    spread = lambda c: F.stddev_samp(c) if compat else F.sqrt((n - 1) * (n - 1) / n) * F.stddev_samp(c)
    wide = reps.agg(*(spread(c).alias(f"s_{c}") for c in METHODS[method])).crossJoin(observed)  # one row each
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("statistic"), F.col(f"o_{c}").alias("value"), F.col(f"s_{c}").alias("se")) for c in METHODS[method])))
    return wide.select(rows.alias("x")).select("x.*").withColumn("z", F.when(F.col("se") > 1e-12, F.col("value") / F.col("se")))


def d_significance(frame: GenotypeFrame, roles: list[str], method: str, n_reps: int = 100, seed: int = 0) -> DataFrame:
    """Each statistic with its bootstrap deviation, z, two-sided p, chi-squared and its p, and both corrections."""
    patterns = dense_index(site_patterns(role_frequencies(frame, roles), method), "locus_idx")
    weights = locus_weights(frame.spark, patterns.count(), n_reps, seed)
    reps = _sums(patterns.join(weights, "slot"), method, "rep", weight=F.col("w"))
    names = list(METHODS[method])
    spread = reps.agg(*(F.stddev_samp(c).alias(f"s_{c}") for c in names)).crossJoin(d_statistics(frame, roles, method).select(*names))  # one row each
    long = spread.select(F.explode(F.array(*(F.struct(F.lit(c).alias("statistic"), F.col(c).alias("value"), F.col(f"s_{c}").alias("std")) for c in names))).alias("x")).select("x.*")
    long = long.withColumn("z", F.when(F.col("std") > 1e-12, F.col("value") / F.col("std"))).withColumn("chi2", F.col("z") * F.col("z"))
    long = long.withColumn("p", normal_tail(frame.spark, F.col("z"))).withColumn("p_chi2", chi2_tail(frame.spark, F.col("chi2")))
    return adjust_pvalues(adjust_pvalues(long, "p", "bonferroni").withColumnRenamed("p_adj", "p_bonferroni"), "p", "fdr_bh").withColumnRenamed("p_adj", "p_fdr")


def least_missing_samples(frame: GenotypeFrame, k: int) -> DataFrame:
    """The ``k`` samples of each population with the fewest missing calls, ties in sample order."""
    missing = frame.with_population().groupBy("population", "sample_idx").agg((F.count("*") - F.count("gt")).alias("n_missing"))
    rank = F.row_number().over(Window.partitionBy("population").orderBy("n_missing", "sample_idx"))
    return missing.withColumn("rank", rank).filter(F.col("rank") <= k)


def select_individuals(frame: GenotypeFrame, roles: list[str], individuals: int | None = None, selection: str | dict[str, list[str]] = "least_missing", seed: int = 0) -> DataFrame:
    """(sample_idx, population) of the individuals that stand for each population of ``roles``.

    ``selection``: least_missing, random (hash order of ``seed``), all, or lists of sample names by population, each in full.
    A population takes ``individuals`` of them at most, all if there is no such number.
    """
    samples = frame.samples.filter(F.col("population").isin(roles))
    if isinstance(selection, dict):
        if set(selection) != set(roles):
            raise ConfigurationError("individuals must be named for each population")
        named = [(p, n) for p, names in selection.items() for n in names]
        chosen = samples.join(F.broadcast(frame.spark.createDataFrame(named, "population string, sample_id string")), ["population", "sample_id"])
        if not all(selection.values()) or chosen.count() != len(set(named)):
            raise ConfigurationError("individuals that are not samples of their population")
        return chosen.select("sample_idx", "population")
    if selection not in ("least_missing", "random", "all"):
        raise ConfigurationError(f"unknown selection: {selection}")
    if individuals is not None and individuals < 1:
        raise ConfigurationError("at least one individual is needed")
    if selection == "all" or individuals is None:
        return samples.select("sample_idx", "population")
    if selection == "least_missing":
        return least_missing_samples(frame, individuals).filter(F.col("population").isin(roles)).select("sample_idx", "population")
    rank = F.row_number().over(Window.partitionBy("population").orderBy(portable_hash(F.col("sample_idx"), seed), "sample_idx"))
    return samples.withColumn("rank", rank).filter(F.col("rank") <= individuals).select("sample_idx", "population")


#: Combinations of individuals that are compared at most: beyond, choose fewer individuals.
MAX_COMBINATIONS = 1_000_000


def d_per_combination(frame: GenotypeFrame, roles: list[str], method: str, individuals: int | None = 2, selection: str | dict[str, list[str]] = "least_missing", seed: int = 0) -> DataFrame:
    """Statistics of each combination of one individual a role; individuals are chosen as in ``select_individuals``.

    Combinations are the product of the chosen; more than ``MAX_COMBINATIONS`` of them are an error, not a sample.
    """
    chosen = select_individuals(frame, roles, individuals, selection, seed)
    sizes = [r["count"] for r in chosen.groupBy("population").count().collect()]  # a row a population
    if math.prod(sizes) > MAX_COMBINATIONS:
        raise ConfigurationError(f"{math.prod(sizes)} combinations: choose fewer individuals")
    calls = encode_012(frame).join(F.broadcast(chosen), "sample_idx").filter("dosage is not null")
    joined = None
    for k, role in enumerate(roles):
        own = calls.filter(F.col("population") == role).select("locus_idx", F.col("sample_idx").alias(f"s{k}"), F.col("dosage").alias(f"m{k}"))
        joined = own if joined is None else joined.join(own, "locus_idx")
    names = [f"s{k}" for k in range(len(roles))]
    patterns = site_patterns(_polarised(joined, len(roles), *names), method, *names)
    return _sums(patterns, method, *names).select(F.concat_ws("-", *names).alias("combination"), "n_sites", *METHODS[method])


def significance_counts(rows: DataFrame, raw: str = "p", bonferroni: str = "p_bonferroni", fdr: str = "p_fdr", alpha: float = 0.05) -> DataFrame:
    """Rows by the strictest correction at which they are significant."""
    hit = lambda c: F.coalesce(F.col(c) < alpha, F.lit(False))
    kind = F.when(hit(bonferroni), "Bonferroni").when(hit(fdr), "FDR").when(hit(raw), "Raw").otherwise("NS")
    return rows.groupBy(kind.alias("category")).agg(F.count("*").alias("n"))


def combination_table(rows: DataFrame, method: str) -> DataFrame:
    """Long rows (method, combination, statistic, value) for plots: each combination once, those without any value left out."""
    names = list(METHODS[method])
    known = rows.filter(F.coalesce(*[F.nanvl(F.col(n), F.lit(None).cast("double")) for n in names]).isNotNull()).dropDuplicates(["combination"])
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("statistic"), F.col(n).alias("value")) for n in names)))
    return known.select(F.lit(method).alias("method"), "combination", pairs.alias("x")).select("method", "combination", "x.*")


def estimability(rows: DataFrame, *statistics: str) -> DataFrame:
    """Rows without a value, by statistic."""
    return rows.agg(F.count("*").alias("n_rows"), *(F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in statistics))

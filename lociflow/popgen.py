"""One object for the analyses of a bundle: each method runs what the operators offer and returns named DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import ConfigurationError, PopulationMapError
from .genotypes import GenotypeFrame
from .operators import distances, introgression, linkage, outliers, statistics
from .shared import write_shared

__all__ = ["PopGen"]

METHODS = ("observed", "permutation", "bootstrap")


class PopGen:
    """Analyses of ``frame``. Every method returns lazy DataFrames by name; nothing is collected but what an operator says."""

    def __init__(self, frame: GenotypeFrame):
        self.frame = frame

    def _needs_populations(self, n: int = 2) -> None:
        if self.frame.samples.select("population").distinct().limit(n).count() < n:
            raise PopulationMapError(f"at least {n} populations are needed")

    def summary(self) -> dict[str, DataFrame]:
        """Missing calls, heterozygosity and diversity overall and by population, allele summary, genotypes and population sizes."""
        f = self.frame
        return {
            "missing": statistics.missing_summary(f),
            "heterozygosity": statistics.heterozygosity(f),
            "heterozygosity_per_population": statistics.heterozygosity_per_population(f),
            "alleles": statistics.allele_summary(f),
            "genotypes": statistics.genotype_distribution(f),
            "population_sizes": statistics.population_sizes(f),
        }

    def _distance(self, method: str, value: str, observed, permuted, drawn) -> dict[str, DataFrame]:
        if method not in METHODS:
            raise ConfigurationError(f"unknown method: {method}")
        self._needs_populations()
        if method == "permutation":
            both = permuted()
            return {"observed": distances.symmetric_table(both.select("pop1", "pop2", value), value), "pvalues": distances.symmetric_table(both.select("pop1", "pop2", "p"), "p", 1.0)}
        out = {"observed": distances.symmetric_table(observed(), value)}
        if method == "bootstrap":
            limits = drawn()
            out |= {f"{side}_ci": distances.symmetric_table(limits.select("pop1", "pop2", F.col(side).alias(value)), value) for side in ("lower", "upper")}
            out["triangle_ci"] = distances.triangle_intervals(limits, 0.0)
        return out

    def fst(self, method: str = "observed", n_reps: int = 1000, seed: int = 0) -> dict[str, DataFrame]:
        """Weir and Cockerham's Fst as symmetric tables: observed, and with it p-values or both limits."""
        f = self.frame
        return self._distance(method, "fst", lambda: distances.fst_observed(f), lambda: distances.fst_permutation(f, n_reps, seed), lambda: distances.fst_bootstrap(f, n_reps, seed))

    def nei(self, method: str = "observed", n_reps: int = 1000, seed: int = 0) -> dict[str, DataFrame]:
        """Nei's distance as symmetric tables, as in ``fst``."""
        f = self.frame
        return self._distance(method, "nei", lambda: distances.nei_observed(f), lambda: distances.nei_permutation(f, n_reps, seed), lambda: distances.nei_bootstrap(f, n_reps, seed))

    def amova(self, regions: DataFrame, n_reps: int = 0, seed: int = 0) -> dict[str, DataFrame]:
        """Variance components and Phi statistics over ``regions(population, region)``; with replicates, their p-values."""
        out = {"components": distances.amova(self.frame, regions)}
        return out | ({"bootstrap": distances.amova_bootstrap(self.frame, regions, n_reps, seed)} if n_reps else {})

    def d_statistics(
        self, method: str, roles: list[str], n_reps: int = 1000, seed: int = 0, individuals: int | None = None, selection: str | dict[str, list[str]] = "random", per_combination: bool = True, overall: bool = True,
        jackknife: bool = False, block_size: int = 500,
    ) -> dict[str, DataFrame]:
        """Statistics of the populations in ``roles`` (three or four, and the outgroup last), overall and by combination of individuals."""
        if method not in introgression.METHODS:
            raise ConfigurationError(f"unknown method: {method}")
        wanted = 4 if method == "patterson" else 5
        if len(roles) != wanted or len(set(roles)) != wanted:
            raise ConfigurationError(f"{method} needs {wanted} different populations")
        frame, out = self.frame, {}
        if individuals is not None or isinstance(selection, dict):
            chosen = introgression.select_individuals(frame, roles, individuals, selection, seed)
            frame = GenotypeFrame(frame.calls.join(chosen.select("sample_idx"), "sample_idx", "left_semi"), frame.loci, frame.samples.join(chosen.select("sample_idx"), "sample_idx", "left_semi"))
        if overall:
            out["overall"] = introgression.d_statistics(frame, roles, method)
            out["significance"] = introgression.d_significance(frame, roles, method, n_reps, seed)
            out["categories"] = introgression.significance_counts(out["significance"])
        if jackknife:
            out["jackknife"] = introgression.d_jackknife(frame, roles, method, block_size)
        if per_combination:
            out["combinations"] = introgression.d_per_combination(frame, roles, method, selection="all")
            out["combination_table"] = introgression.combination_table(out["combinations"], method)
            out["estimability"] = introgression.estimability(out["combinations"], *introgression.METHODS[method])
        return out

    def linkage(
        self, populations: list[str] | None = None, overall: bool = False, groups: DataFrame | None = None, blocks: DataFrame | None = None, assume_unlinked: bool = False, n_reps: int = 200, n_blocks: int = 20,
        max_pairs: int | None = linkage.MAX_PAIRS, mating: str = "random", bootstrap: str = "pairs", seed: int = 0, pairwise: bool = False,
    ) -> dict[str, DataFrame]:
        """Unbiased linkage moments and effective size with intervals; ``pairwise`` gives each pair's statistics too."""
        options = {"populations": populations, "groups": groups, "n_blocks": n_blocks, "seed": seed, "assume_unlinked": assume_unlinked, "max_pairs": max_pairs, "overall": overall, "blocks": blocks}
        sums = write_shared(linkage.two_locus_sums(self.frame, **options), "linkage")
        out = {"blocks": sums, "summary": linkage.ld_summary(sums, n_reps, seed, mating, bootstrap), "bootstrap": linkage.ld_bootstrap(sums, n_reps, seed, bootstrap), "shares": linkage.block_shares(sums)}
        if pairwise:
            pairs = linkage.with_r2(linkage.with_statistics(linkage.two_locus_counts(self.frame, **options)))
            out |= {"pairs": pairs, "informative": linkage.informative_share(pairs)}
        return out

    def outliers(self, method: str = "permutation", correction: str | None = None, alpha: float = 0.05, n_reps: int = 1000, seed: int = 0, neighbours: int = 5) -> dict[str, DataFrame]:
        """Loci of outlying Fst and the pairs of populations in which they are; ``method``: permutation or neighbours."""
        self._needs_populations()
        if method == "permutation":
            return {"outliers": outliers.fst_outliers_permutation(self.frame, n_reps, alpha, correction, seed=seed)}
        if method == "neighbours":
            return {"outliers": outliers.fst_outliers_knn(self.frame, neighbours, alpha, correction, seed=seed)}
        raise ConfigurationError(f"unknown method: {method}")

    def pca(self, n_components: int = 2, center: bool = True, scale: bool = False, neighbours: int = 5) -> dict[str, DataFrame]:
        scores = outliers.pca(self.frame, n_components, center, scale, neighbours)
        return {"scores": scores.join(self.frame.samples, "sample_idx")}

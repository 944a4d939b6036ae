"""``python -m lociflow``: read genotypes, filter them and write what the chosen analyses find."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import linkage, reports
from .popgen import METHODS, PopGen
from .sources import readers, writers

__all__ = ["main"]

FORMATS = {"vcf": readers.read_vcf, "phylip": readers.read_phylip, "structure": readers.read_structure, "genepop": readers.read_genepop}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lociflow", description="Filter genotypes and analyse them by population.")
    parser.add_argument("input")
    parser.add_argument("--format", choices=FORMATS, default="vcf")
    parser.add_argument("--popmap")
    parser.add_argument("--force", action="store_true", help="leave out samples without a population")
    parser.add_argument("--include", nargs="+", help="populations to keep")
    parser.add_argument("--exclude", nargs="+", help="populations to leave out")
    parser.add_argument("--prefix", default="lociflow")
    parser.add_argument("--reps", type=int, default=100, help="replicates of bootstraps and permutations")
    parser.add_argument("--seed", type=int, default=0)
    filters = parser.add_argument_group("filters, in this order")
    filters.add_argument("--missing-sample", type=float)
    filters.add_argument("--missing", type=float)
    filters.add_argument("--missing-pop", type=float)
    filters.add_argument("--maf", type=float)
    filters.add_argument("--mac", type=int)
    filters.add_argument("--biallelic", action="store_true")
    filters.add_argument("--singletons", action="store_true", help="leave out loci with one copy of an allele")
    filters.add_argument("--search", action="store_true", help="write what each combination of the default thresholds would keep")
    analyses = parser.add_argument_group("analyses")
    analyses.add_argument("--fst", choices=METHODS, default="bootstrap")
    analyses.add_argument("--nei", choices=METHODS, default="bootstrap")
    analyses.add_argument("--dstat", choices=("patterson", "partitioned", "dfoil"))
    analyses.add_argument("--roles", nargs="+", help="populations of the D statistics, the outgroup last")
    analyses.add_argument("--individuals", type=int, help="individuals of each population in combinations")
    analyses.add_argument("--selection", choices=("random", "least_missing", "all"), default="random")
    analyses.add_argument("--linkage", action="store_true")
    analyses.add_argument("--assume-unlinked", action="store_true")
    analyses.add_argument("--max-pairs", type=int, default=linkage.MAX_PAIRS)
    analyses.add_argument("--outliers", choices=("permutation", "neighbours"))
    analyses.add_argument("--correction", choices=("bonferroni", "holm", "fdr_bh"))
    analyses.add_argument("--pca", type=int, help="components")
    return parser


def main(args: list[str] | None = None) -> None:
    a = _parser().parse_args(args)
    spark = SparkSession.builder.appName("lociflow").getOrCreate()
    popmap = readers.read_popmap(spark, a.popmap) if a.popmap else None
    options = {"keep_format": True} if a.format == "vcf" else {}
    frame = FORMATS[a.format](spark, a.input, popmap=popmap, force=a.force, **options)
    if a.include or a.exclude:
        frame = readers.subset_populations(frame, a.include, a.exclude)
    report = lambda name, rows: writers.write_report(rows, writers.output_path(a.prefix, "reports", name))
    if a.search:
        report("threshold_search", frame.search_thresholds())
    whole = frame
    steps = (("filter_missing_sample", a.missing_sample), ("filter_missing", a.missing), ("filter_missing_pop", a.missing_pop), ("filter_maf", a.maf), ("filter_mac", a.mac))
    for name, threshold in steps:
        if threshold is not None:
            frame = getattr(frame, name)(threshold)
    if a.biallelic:
        frame = frame.filter_biallelic()
    if a.singletons:
        frame = frame.filter_singletons()
    if frame is not whole:
        print(reports.filter_report(frame.audit()))
        report("flows", frame.flows())
        frame = frame.resolve()
    frame = frame.stored()
    header = readers.vcf_header(spark, a.input) if a.format == "vcf" else None
    writers.write_vcf(frame, writers.output_path(a.prefix, "data", "filtered"), header)
    writers.write_popmap(frame, writers.output_path(a.prefix, "data", "popmap"))
    popgen = PopGen(frame)
    found = {"summary": popgen.summary()}
    if frame.samples.select("population").distinct().count() > 1:
        found |= {"fst": popgen.fst(a.fst, a.reps, a.seed), "nei": popgen.nei(a.nei, a.reps, a.seed)}
    if a.dstat:
        found["dstat"] = popgen.d_statistics(a.dstat, a.roles or [], a.reps, a.seed, a.individuals, a.selection)
    if a.linkage:
        found["linkage"] = popgen.linkage(assume_unlinked=a.assume_unlinked, n_reps=a.reps, max_pairs=a.max_pairs, seed=a.seed)
    if a.outliers:
        found["outliers"] = popgen.outliers(a.outliers, a.correction, n_reps=a.reps, seed=a.seed)
    if a.pca:
        found["pca"] = popgen.pca(a.pca)
    for group, tables in found.items():
        for name, rows in tables.items():
            report(f"{group}_{name}", rows)


if __name__ == "__main__":
    main()

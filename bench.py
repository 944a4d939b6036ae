"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

HEADLINE = [
    "filter_maf", "filter_missing_pop", "filter_chain_audit", "threshold_search", "missing_per_locus", "heterozygosity_per_pop", "allele_summary", "encode_012",
    "fst_observed", "fst_bootstrap_ci", "nei_observed", "amova_components", "patterson_d", "dfoil", "ld_two_locus_counts", "ld_unbiased_full", "pca_scores",
]


#: Sample sizes of six populations and loci of the published linkage benchmark (about 13.2 million pairs a population in 50 s).
SIZES, LOCI = (22, 23, 24, 44, 18, 44), 5_272


def made_frame(spark: SparkSession):
    """Genotypes of that shape, made by hash; loci of 400 groups, so that nearly all pairs are of different ones."""
    from lociflow.genotypes import GenotypeFrame, portable_hash

    total = sum(SIZES)
    names = [f"p{k}" for k, n in enumerate(SIZES) for _ in range(n)]
    samples = spark.createDataFrame([(k, f"s{k}", p) for k, p in enumerate(names)], "sample_idx long, sample_id string, population string")
    loci = spark.range(LOCI).select(F.col("id").alias("locus_idx"), (F.col("id") % 400).cast("string").alias("chrom"), F.col("id").alias("pos"), F.lit("A").alias("ref"), F.array(F.lit("C")).alias("alt"))
    draw = portable_hash(F.col("id"), 7) % 10
    calls = spark.range(LOCI * total).select(F.floor(F.col("id") / total).alias("locus_idx"), (F.col("id") % total).alias("sample_idx"), F.when(draw < 4, "A").when(draw < 7, "M").when(draw < 9, "C").alias("gt"))
    return GenotypeFrame(calls, loci, samples)


def linkage_of_made_frame(spark: SparkSession) -> tuple[float, int]:
    """Seconds of the whole analysis, 200 bootstrap replicates included, and the pairs that it counts."""
    from lociflow.operators import linkage
    from lociflow.shared import write_shared

    began = time.perf_counter()
    sums = write_shared(linkage.two_locus_sums(made_frame(spark), n_blocks=20, max_pairs=None), "sums")
    linkage.ld_summary(sums, 200).collect()  # a row a population
    return time.perf_counter() - began, sums.agg(F.sum("n_pairs")).first()[0]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lociflow-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from lociflow.plans import genomics

    queries = genomics.queries()
    queries["pop_sizes"](spark, sf_dir).count()  # starts the executors
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    seconds, pairs = linkage_of_made_frame(spark)
    took["linkage_six_populations"] = round(seconds, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf"), "linkage_pairs": pairs, "linkage_pairs_per_sec": round(pairs / seconds)}))
    spark.stop()


if __name__ == "__main__":
    main()

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from helpers import frame_of
from pyspark.sql import functions as F

from lociflow.functions.two_locus import unbiased
from lociflow.operators import distances, introgression, linkage, outliers, packed, resampling, statistics


def test_heterozygosity(spark):
    f = frame_of(spark, ["NAM", "NMC"], ref="AAA")
    rows = statistics.heterozygosity(f).orderBy("locus_idx").collect()
    assert [r["ho"] for r in rows] == [None, 0.5, 0.5]
    assert [r["he"] for r in rows] == [None, 0.375, 0.375]


def test_constructed_d(spark):
    rows = ["A" * 8, "C" * 8, "C" * 8, "A" * 8]
    f = frame_of(spark, rows, ["p1", "p2", "p3", "o"])
    assert introgression.d_statistics(f, ["p1", "p2", "p3", "o"], "patterson").first()["D"] == 1.0
    assert introgression.d_statistics(f, ["p2", "p1", "p3", "o"], "patterson").first()["D"] == -1.0
    g = frame_of(spark, ["C" * 4, "A" * 4, "C" * 4, "A" * 4, "A" * 4], ["p1", "p2", "p3", "p4", "o"])
    got = introgression.d_statistics(g, ["p1", "p2", "p3", "p4", "o"], "dfoil").first()
    assert (got["DFO"], got["DFI"], got["DOL"], got["DIL"]) == (1.0, 1.0, -1.0, -1.0)


def test_unbiased_statistics_against_all_samples():
    """The mean over all multinomial samples is the population's value."""
    p = np.array([0.3, 0.1, 0.05, 0.1, 0.15, 0.05, 0.05, 0.1, 0.1])
    half = lambda a, b, c: p[a] + p[b] / 2 + p[c] / 2 + p[4] / 4
    ab, a_, b_, x = half(0, 1, 3), half(2, 1, 5), half(6, 3, 7), half(8, 5, 7)
    delta, big_a, big_b = ab * x - a_ * b_, ab + a_, ab + b_
    want = {"d": 2 * delta, "d2": 4 * delta**2, "dz": 2 * delta * (1 - 2 * big_b) * (1 - 2 * big_a), "pi2": big_a * (1 - big_a) * big_b * (1 - big_b)}
    n = 4
    counts, weights = [], []
    for c in itertools.combinations_with_replacement(range(9), n):
        k = Counter(c)
        counts.append([k[i] for i in range(9)])
        weights.append(math.factorial(n) / math.prod(math.factorial(v) for v in k.values()) * math.prod(p[i] ** v for i, v in k.items()))
    for name, value in want.items():
        assert np.dot(weights, unbiased(np.array(counts), name)[:, 0]) == pytest.approx(value, abs=1e-12)
    assert np.isnan(unbiased(np.zeros((1, 9)), "d")[0, 0])


def test_ld_counts_and_size(spark):
    rng = np.random.default_rng(4)
    rows = ["".join(rng.choice(list("AMC"), 8)) for _ in range(8)]
    f = frame_of(spark, rows, ["x"] * 8, chroms=["1"] * 4 + ["2"] * 4)
    counts = linkage.two_locus_counts(f, n_blocks=4)
    for r in counts.collect():
        assert sum(r[f"n{k}"] for k in range(9)) == 8
        a, b = ([{"A": 0, "M": 1, "C": 2}[s[j]] for s in rows] for j in (r["locus_a"], r["locus_b"]))
        assert r["n4"] == sum(x == 1 and y == 1 for x, y in zip(a, b, strict=True))
    both = linkage.unbiased_d(linkage.with_statistics(counts).withColumnRenamed("d", "full").drop("n"))
    assert all(r["d"] == pytest.approx(r["full"]) for r in both.collect())
    row = linkage.ld_summary(linkage.block_sums(linkage.with_statistics(counts)), 5).first()
    assert row["ne"] is None if row["r2d"] <= 0 else row["ne"] == pytest.approx(1 / (3 * row["r2d"]))


def test_fst_and_nei_order(spark):
    rng = np.random.default_rng(42)
    rows, pops = [], []
    for pop, p in (("a", 0.7), ("b", 0.5), ("c", 0.3)):
        for _ in range(10):
            z = rng.binomial(2, 1 - p, 60)
            rows.append("".join("AMC"[k] for k in z))
            pops.append(pop)
    f = frame_of(spark, rows, pops)
    fst = {(r["pop1"], r["pop2"]): r["fst"] for r in distances.fst_observed(f).collect()}
    assert fst["a", "c"] > 0.2 > fst["a", "b"] > 0
    nei = {(r["pop1"], r["pop2"]): r["nei"] for r in distances.nei_observed(f).collect()}
    assert nei["a", "c"] > nei["a", "b"] > 0
    assert distances.fst_permutation(f, 9).filter("pop1 = 'a' and pop2 = 'c'").first()["p"] == pytest.approx(0.1)
    assert outliers.fst_outliers_knn(f, alpha=1.0, min_z=2.0).schema == outliers.OUTLIERS
    assert outliers.pca(f, 2).count() == 30


def test_amova_against_pairs(spark):
    rng = np.random.default_rng(2)
    rows = ["".join(rng.choice(list("ACMGN"), 6)) for _ in range(12)]
    pops = ["p1"] * 3 + ["p2"] * 3 + ["p3"] * 3 + ["p4"] * 3
    region = {"p1": "r1", "p2": "r1", "p3": "r2", "p4": "r2"}
    base = {"A": {"A"}, "C": {"C"}, "G": {"G"}, "M": {"A", "C"}}
    total = 0.0
    for j in range(6):
        for pop in region:
            own = [base[r[j]] for r, q in zip(rows, pops, strict=True) if q == pop and r[j] != "N"]
            s = 2 * sum(not (x & y) for x, y in itertools.combinations(own, 2))
            total += s - s * s / len(own) ** 2 if own else 0
    got = distances.amova(frame_of(spark, rows, pops), spark.createDataFrame(list(region.items()), "population string, region string")).first()
    assert got["ssw"] == pytest.approx(total)


def test_corrections(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double")
    get = lambda m: [r["p_adj"] for r in resampling.adjust_pvalues(df, "p", m).orderBy("p").collect()]
    assert get("bonferroni")[1:] == pytest.approx([0.03, 0.09, 0.12])
    assert get("holm")[1:] == pytest.approx([0.03, 0.06, 0.06])
    assert get("fdr_bh")[1:] == pytest.approx([0.03, 0.04, 0.04])
    assert get("holm")[0] is None


def test_tails(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1.959963984540054,)], "z double")
    assert df.select(resampling.normal_tail(spark, F.col("z"))).first()[0] == pytest.approx(0.05)
    assert df.select(resampling.chi2_tail(spark, F.col("z") * F.col("z"))).first()[0] == pytest.approx(0.05)


def test_dense_index_of_a_million(spark):
    """One slot each, in order, whatever columns a branch needs."""
    n = 1_000_000
    loci = spark.range(n).select((F.col("id") * 7_919 % n).alias("k"), F.repeat(F.lit("x"), 60).alias("payload"))
    slots = resampling.dense_index(loci, "k")
    found = slots.agg(F.count("*").alias("n"), F.count_if(F.col("slot") == F.col("k")).alias("right")).first()
    assert (found["n"], found["right"]) == (n, n)
    # Ties: branches that read other columns see the same numbers.
    tied = resampling.dense_index(loci.limit(20_000).withColumn("t", F.col("k") % 3), "t")
    assert tied.select("slot", "k").join(tied.select("slot", F.col("k").alias("again"), F.length("payload")), "slot").filter("k = again").count() == 20_000


def _ld_frame(spark, n_samples=30, n_loci=60):
    rng = np.random.default_rng(8)
    rows = ["".join(rng.choice(list("AAMCN"), n_loci)) for _ in range(n_samples)]
    return frame_of(spark, rows, ["x"] * 12 + ["y"] * (n_samples - 12), chroms=[str(k % 5) for k in range(n_loci)])


def test_ld_pair_budget(spark):
    f = _ld_frame(spark)
    pairs = lambda df: {(r["population"], r["locus_a"], r["locus_b"]): tuple(r[c] for c in linkage.STATES) for r in df.collect()}
    every = pairs(linkage.two_locus_counts(f, seed=3))
    some = pairs(linkage.two_locus_counts(f, seed=3, max_pairs=100))
    assert {p: sum(k[0] == p for k in some) for p in "xy"} == {"x": 100, "y": 100}
    assert all(every[k] == v for k, v in some.items())
    assert pairs(linkage.two_locus_counts(f, seed=3, max_pairs=10**6)) == every


def test_ld_sums_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(linkage, "CHUNK_LOCI", 3)
    f = _ld_frame(spark)
    for options in ({}, {"max_pairs": 300}, {"overall": True}, {"blocks": f.loci.select("locus_idx", (F.col("locus_idx") % 4).alias("block"))}):
        got = linkage.two_locus_sums(f, **({"max_pairs": None} | options)).collect()
        want = linkage.block_sums(linkage.with_statistics(linkage.two_locus_counts(f, **options))).collect()
        key = lambda r: (r["population"], r["block_a"], r["block_b"])
        assert {key(r) for r in got} == {key(r) for r in want}
        by = {key(r): r for r in want}
        for r in got:
            for c in r.__fields__[3:]:
                assert r[c] == pytest.approx(by[key(r)][c], abs=1e-9)
        assert ({r["population"] for r in got} == {"x", "y", "Overall"}) == ("overall" in options)


def test_ld_node_bootstrap(spark):
    sums = linkage.two_locus_sums(_ld_frame(spark), n_blocks=4)
    rows = linkage.ld_bootstrap(sums, 6, 1, "node_cluster").collect()
    assert {r["population"] for r in rows} == {"x", "y"}
    draws = {(r["rep"], r["slot"]): r["w"] for r in resampling.locus_weights(spark, 4, 6, 1).collect()}
    total = {(r["block_a"], r["block_b"]): r["sum_d2"] for r in sums.filter("population = 'x'").collect()}
    pi = {(r["block_a"], r["block_b"]): r["sum_pi2"] for r in sums.filter("population = 'x'").collect()}
    for r in rows:
        if r["population"] == "x":
            w = {k: draws.get((r["rep"], k[0]), 0) * draws.get((r["rep"], k[1]), 0) for k in total}
            assert r["r2d"] == pytest.approx(sum(w[k] * total[k] for k in w) / sum(w[k] * pi[k] for k in w))


def test_significance_of_statistics(spark):
    """p-values against Python's error function."""
    rng = np.random.default_rng(2)
    f = frame_of(spark, ["".join(rng.choice(list("AMC"), 80)) for _ in range(20)], [p for p in "wxyz" for _ in range(5)])
    for r in introgression.d_significance(f, list("wxyz"), "patterson", 20, 1).collect():
        assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)))
        assert r["p_chi2"] == pytest.approx(math.erfc(math.sqrt(r["chi2"] / 2)))


@pytest.mark.parametrize("method", ["bonferroni", "holm", "fdr_bh"])
def test_corrections_in_parts(spark, monkeypatch, method):
    monkeypatch.setattr(resampling, "RANKS", 7)
    rng = np.random.default_rng(1)
    rows = [(str(k % 3), None if k % 11 == 0 else float(np.round(rng.random() ** 2, 2)), k) for k in range(150)]
    got = {r["k"]: r["p_adj"] for r in resampling.adjust_pvalues(spark.createDataFrame(rows, "g string, p double, k int"), "p", method, "g").collect()}
    assert len(got) == 150
    for g in "012":
        p = sorted((v, k) for h, v, k in rows if h == g and v is not None)
        n, best = len(p), 0.0
        for rank, (v, k) in enumerate(p):
            if method == "holm":
                best = max(best, v * (n - rank))
            want = {"bonferroni": v * n, "holm": best, "fdr_bh": min(w * n / (r + 1) for r, (w, _) in enumerate(p) if r >= rank)}[method]
            assert got[k] == pytest.approx(min(1.0, want))
    assert all(got[k] is None for _, v, k in rows if v is None)


def test_permutations_both_ways(spark, monkeypatch):
    """Labels as a matrix and labels joined to the calls give the same."""
    rng = np.random.default_rng(9)
    f = frame_of(spark, ["".join(rng.choice(list("AAMCTKN"), 25)) for _ in range(14)], list("xxxxyyyyyzzzzz"))

    def run():
        pairs = {(r["pop1"], r["pop2"]): (r["fst"], r["p"]) for r in distances.fst_permutation(f, 7, 2).collect()}
        loci = {(r["pop1"], r["pop2"], r["locus_idx"]): (r["fst"], r["n"], r["up"], r["down"], r["sd"]) for r in distances.fst_permuted_per_locus(f, 7, 2).collect()}
        return pairs, loci

    matrix = run()
    monkeypatch.setattr(distances, "MAX_LABELS", 0)
    for got, want in zip(matrix, run(), strict=True):
        assert set(got) == set(want)
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)


@pytest.mark.parametrize("options", [{}, {"scale": True}, {"center": False}])
def test_pca_of_many_samples(spark, monkeypatch, options):
    """Components from the loci's square are those from the samples' square."""
    rng = np.random.default_rng(4)
    x = rng.choice(list("AAAMCNNN"), (60, 12))
    x[:, 3], x[5] = "A", "N"
    f = frame_of(spark, ["".join(r) for r in x])
    few = np.array([tuple(r) for r in outliers.pca(f, 2, k=4, **options).orderBy("sample_idx").collect()])
    monkeypatch.setattr(outliers, "MAX_SAMPLES", 50)
    for nearest in (4, 1024):
        monkeypatch.setattr(outliers, "NEAREST", nearest)
        many = np.array([tuple(r) for r in outliers.pca(f, 2, k=4, **options).orderBy("sample_idx").collect()])
        assert np.abs(few - many).max() < 1e-9


def test_permutations_in_blocks(spark, monkeypatch):
    """Blocks of samples, loci and labels smaller than the frame give what whole ones give."""
    rng = np.random.default_rng(11)
    f = frame_of(spark, ["".join(rng.choice(list("AAMCTKN"), 9)) for _ in range(14)], list("xxxxyyyyyzzzzz"))
    found = lambda: sorted(map(tuple, distances._permuted(f, 3, 2, True).collect()))
    whole = found()
    labels = {(r["pop1"], r["pop2"], r["rep"], r["sample_idx"]): r["population"] for r in resampling.permuted_labels(distances._pair_samples(f), 3, 2, "pop1", "pop2").collect()}
    calls = [r for r in f.calls.collect() if r["gt"] is not None]
    for one, two, rep, locus, *counts in whole:
        if rep >= 0:
            sides = [[r["gt"] for r in calls if r["locus_idx"] == locus and labels.get((one, two, rep, r["sample_idx"])) == p] for p in (one, two)]
            assert [counts[0], counts[9]] == list(map(len, sides))
            assert [counts[1], counts[10]] == [sum(2 * (g == "A") + (g == "M") for g in side) for side in sides]
    for name, size in (("BLOCK_SAMPLES", 4), ("BLOCK_LOCI", 2), ("BLOCK_ROWS", 5)):
        monkeypatch.setattr(distances, name, size)
    assert found() == whole


def test_packed_parts_are_bounded(spark, monkeypatch):
    """Many samples make parts of fewer loci."""
    f = frame_of(spark, ["ACGT" * 10] * 20)
    monkeypatch.setattr(packed, "PACKED_CELLS", 100)
    parts = packed.packed(f.calls.withColumn("value", F.lit(1)), list(range(20)), 40, "test").collect()
    assert len(parts) >= 4 and sum(len(r["data"]) for r in parts) == 800


def test_permutation_never_brings_many_labels_to_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(12)
    f = frame_of(spark, ["".join(rng.choice(list("AAMCN"), 6)) for _ in range(12)], list("xxxxxxyyyyyy"))
    want = [(r["pop1"], r["pop2"], pytest.approx(r["fst"]), r["p"]) for r in distances.fst_permutation(f, 3, 1).collect()]
    monkeypatch.setattr(distances, "MAX_LABELS", 10)
    monkeypatch.setattr(distances, "permuted_labels", None)  # not even made there
    assert [tuple(r) for r in distances.fst_permutation(f, 3, 1).collect()] == want


def test_a_task_packs_one_block(spark, monkeypatch):
    """Blocks that Spark would put together, since they are small, are still tasks and files of their own."""
    f, tables, kept = frame_of(spark, ["ACGTMCTK"] * 14, list("xxxxxxxyyyyyyy")), {}, distances.write_shared
    monkeypatch.setattr(distances, "write_shared", lambda df, name: tables.setdefault(name, kept(df, name)))
    monkeypatch.setattr(distances, "BLOCK_SAMPLES", 4)
    distances._permuted(f, 3, 2)
    for name in ("codes", "labels"):
        assert [r["count"] for r in tables[name].groupBy(F.input_file_name()).count().collect()] == [1] * 4


def test_permutation_blocks_are_not_sorted(spark, monkeypatch):
    f, plans, kept = frame_of(spark, ["ACGTMCTK", "AMGTACTT"] * 4, list("xxxxyyyy")), {}, distances.write_shared
    want = [tuple(r) for r in distances.fst_permutation(f, 3, 2).collect()]
    monkeypatch.setattr(distances, "MAX_LABELS", 0)
    monkeypatch.setattr(distances, "write_shared", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and kept(df, name))
    assert [tuple(r) for r in distances.fst_permutation(f, 3, 2).collect()] == [(a, b, pytest.approx(fst), p) for a, b, fst, p in want]
    assert sorted(plans) == ["codes", "labels"] and not any("FlatMapGroups" in plan for plan in plans.values())

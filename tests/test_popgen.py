from __future__ import annotations

import numpy as np
import pytest
from helpers import frame_of

from lociflow import __main__
from lociflow.errors import ConfigurationError, PopulationMapError
from lociflow.operators import distances, introgression
from lociflow.popgen import PopGen
from lociflow.sources import writers

POPULATIONS = ["w", "x", "y", "z"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(6)
    shares = {"w": 0.8, "x": 0.6, "y": 0.4, "z": 0.2}
    rows = ["".join("AMCN"[min(3, int(rng.binomial(2, shares[p])) + 3 * (rng.random() < 0.05))] for _ in range(40)) for p in POPULATIONS for _ in range(5)]
    return frame_of(spark, rows, [p for p in POPULATIONS for _ in range(5)], chroms=[str(k % 4) for k in range(40)])


def test_distances(frame):
    popgen = PopGen(frame)
    observed = {(r["pop1"], r["pop2"]): r["fst"] for r in distances.fst_observed(frame).collect()}
    for found in (popgen.fst(), popgen.fst("bootstrap", 5), popgen.fst("permutation", 5)):
        table = {(r["pop1"], r["pop2"]): r["fst"] for r in found["observed"].collect()}
        assert len(table) == 16
        assert all(table[k] == table[k[::-1]] == pytest.approx(v) for k, v in observed.items())
    drawn = popgen.nei("bootstrap", 5)
    assert set(drawn) == {"observed", "lower_ci", "upper_ci", "triangle_ci"}
    assert {r["p"] for r in popgen.nei("permutation", 5)["pvalues"].filter("pop1 <> pop2").collect()} <= {k / 6 for k in range(1, 7)}
    with pytest.raises(ConfigurationError):
        popgen.fst("other")


def test_one_population(spark):
    with pytest.raises(PopulationMapError):
        PopGen(frame_of(spark, ["AC", "CA"])).fst()


def test_d_statistics(frame):
    popgen = PopGen(frame)
    found = popgen.d_statistics("patterson", POPULATIONS, 5, individuals=2, selection="least_missing", jackknife=True, block_size=10)
    assert found["combinations"].count() == 16
    assert found["estimability"].first()["n_rows"] == 16
    named = {p: [f"s{5 * k}", f"s{5 * k + 3}"] for k, p in enumerate(POPULATIONS)}
    assert sorted(r["combination"] for r in popgen.d_statistics("patterson", POPULATIONS, 5, selection=named)["combinations"].collect())[0] == "0-5-10-15"
    chosen = introgression.select_individuals(frame, POPULATIONS, 2, "random", 3).collect()
    assert {p: sum(r["population"] == p for r in chosen) for p in POPULATIONS} == dict.fromkeys(POPULATIONS, 2)
    for wrong in (named | {"w": ["s19"]}, named | {"w": []}, {"w": ["s0"]}):
        with pytest.raises(ConfigurationError):
            popgen.d_statistics("patterson", POPULATIONS, 5, selection=wrong)
    with pytest.raises(ConfigurationError):
        popgen.d_statistics("dfoil", POPULATIONS)


def test_linkage(frame):
    found = PopGen(frame).linkage(overall=True, n_reps=5, n_blocks=4, pairwise=True)
    assert {r["population"] for r in found["summary"].collect()} == {*POPULATIONS, "Overall"}
    shares = found["shares"].groupBy("population").sum("pair_share", "signal_share").collect()
    assert all(r[1] == pytest.approx(1) and r[2] == pytest.approx(1) for r in shares)
    assert found["pairs"].filter("n >= 4").count() == found["blocks"].agg({"n_pairs": "sum"}).first()[0]


def test_command_line(spark, frame, tmp_path):
    writers.write_vcf(frame, str(tmp_path / "in"))
    writers.write_popmap(frame, str(tmp_path / "map"))
    args = f"{tmp_path}/in --popmap {tmp_path}/map --prefix {tmp_path}/run --missing 0.5 --singletons --reps 4 --dstat patterson --roles w x y z --individuals 1 --linkage --outliers permutation --pca 2 --fst permutation"
    __main__.main(args.split())
    names = {p.name for p in (tmp_path / "run_output" / "reports").iterdir()}
    assert {"fst_pvalues", "nei_lower_ci", "dstat_overall", "dstat_combinations", "linkage_summary", "outliers_outliers", "pca_scores", "summary_alleles", "flows"} <= names
    assert spark.read.option("header", True).csv(str(tmp_path / "run_output" / "reports" / "pca_scores")).count() == 20

from __future__ import annotations

import pytest
from helpers import frame_of, kept

from lociflow.errors import EmptyLocusSetError, InvalidThresholdError

#          0 1 2 3 4 5
ROWS = ["AARNAA", "CARNAC", "MNRNAV"]


def test_locus_filters(spark):
    f = frame_of(spark, ROWS, ["x", "x", "y"])
    assert kept(f.filter_missing(0.4)) == [0, 1, 2, 4, 5]
    assert kept(f.filter_missing_pop(0.5)) == [0, 2, 4, 5]
    assert kept(f.filter_het(0.5)) == [0, 1, 3, 4, 5]
    assert kept(f.filter_het_pop(0.0)) == [1, 3, 4, 5]
    assert kept(f.filter_mac(2)) == [0, 2, 5]
    assert kept(f.filter_mac(2, exclude_heterozygous=True)) == [0, 5]
    assert kept(f.filter_maf(0.4)) == [0, 2, 5]  # a three-base code adds one copy of each base
    assert kept(f.filter_monomorphic()) == [0, 2, 5]
    assert kept(f.filter_biallelic()) == [0, 2]
    assert kept(f.filter_biallelic(exclude_heterozygous=True)) == [0, 5]


def test_singletons_and_depth(spark):
    f = frame_of(spark, ["AAR", "ACA", "AAA"], depth=[[1, 2, 3], [4, 5, 6], [0, 0, 10]])
    assert kept(f.filter_singletons()) == [0, 1]
    assert kept(f.filter_allele_depth(7)) == [1, 2]
    with pytest.raises(KeyError):
        frame_of(spark, ["A"]).filter_allele_depth(1)


def test_filter_that_keeps_none_is_logged_and_changes_nothing(spark):
    f = frame_of(spark, ["AC", "AC"]).filter_monomorphic().filter_missing(1.0)
    assert kept(f) == [0, 1]
    assert [(r["filter_method"], r["removed_count"], r["kept_count"]) for r in f.audit().orderBy("step").collect()] == [("filter_monomorphic", 2, 0), ("filter_missing", 0, 2)]


def test_samples_then_loci(spark):
    f = frame_of(spark, ["ANNN", "ACCA", "CCCN"])
    g = f.filter_missing_sample(0.5)
    assert [r["sample_idx"] for r in g.samples.orderBy("sample_idx").collect()] == [1, 2]
    assert kept(g.filter_missing(0.4)) == [0, 1, 2]
    # The other way round the sample is measured over fewer loci.
    assert f.filter_missing(0.4).filter_missing_sample(0.0).samples.count() == 2
    assert g.resolve().calls.count() == 8


def test_thinning(spark):
    f = frame_of(spark, ["ACGTAC"], chroms=["1", "1", "1", "1", "2", "2"], positions=[1, 5, 100, 300, 1, 2])
    assert kept(f.thin_loci(10, remove_all=True)) == [2, 3]
    assert len(kept(f.thin_loci(10))) == 4
    assert len(kept(f.filter_linked(3))) == 2
    assert len(kept(f.random_subset_loci(3))) == 3
    assert len(kept(f.random_subset_loci(0.5))) == 3
    assert len(kept(f.random_subset_loci(100))) == 6


def test_errors(spark):
    f = frame_of(spark, ROWS)
    with pytest.raises(TypeError):
        f.filter_missing(1)
    with pytest.raises(InvalidThresholdError):
        f.filter_maf(1.5)
    with pytest.raises(RuntimeError):
        f.resolve()
    with pytest.raises(EmptyLocusSetError):
        f.random_subset_loci(0.01)
    with pytest.raises(ValueError):
        f.search_thresholds(filter_order=("filter_nothing",))


def test_search(spark):
    rows = frame_of(spark, ROWS).search_thresholds((0.4, 1.0), (0.0,), (2,), ("filter_missing", "filter_mac")).collect()
    assert len(rows) == 8
    assert {(r["missing"], r["exclude_het"], r["kept_count"]) for r in rows if r["step"] == 2} == {(0.4, True, 2), (0.4, False, 3), (1.0, True, 2), (1.0, False, 3)}


def test_many_loci(spark):
    frame = frame_of(spark, ["".join("AN"[j % 3 == 0] for j in range(3000)), "A" * 3000])
    assert kept(frame.filter_missing(0.4).resolve()) == [j for j in range(3000) if j % 3]

from __future__ import annotations

import pytest
from helpers import frame_of, matrix
from pyspark.sql import functions as F

from lociflow.errors import ConfigurationError
from lociflow.functions import iupac, sequences
from lociflow.operators import encodings


def test_012_and_back(spark):
    f = frame_of(spark, ["AMCNG"], ref="AAAAA", alt=[["C"]] * 5)
    got = encodings.encode_012(f).orderBy("locus_idx")
    assert [r["dosage"] for r in got.collect()] == [0, 1, 2, None, None]
    assert [r["gt"] for r in encodings.decode_012(got, f.loci).orderBy("locus_idx").collect()] == ["A", "M", "C", "N", "N"]


def test_codes_round_trip(spark):
    df = spark.createDataFrame([(c,) for c in "ACGTMRWSYKVHDBN"], "gt string")
    a1, a2 = iupac.two_channel(F.col("gt"))
    rows = df.select("gt", iupac.onehot_to_code(iupac.onehot(F.col("gt"), 0.5)).alias("o"), iupac.int_to_code(iupac.int_code(F.col("gt"))).alias("i"), iupac.two_channel_to_code(a1, a2).alias("t"), iupac.structure_to_code(iupac.structure_pair(F.col("gt"))).alias("s"), iupac.complement(iupac.complement(F.col("gt"))).alias("c")).collect()
    for r in rows:
        assert r["o"] == r["gt"] == r["c"]
        for k in "its":
            assert r[k] == (r["gt"] if r["gt"] in "ACGTMRWSYK" else "N")


def test_structure_order_and_distance(spark):
    row = spark.range(1).select(iupac.structure_to_code(F.lit("2/1")).alias("a"), iupac.structure_to_code(F.lit("2/1"), symmetric=True).alias("b"), iupac.set_distance(F.lit("A"), F.lit("M")).alias("c"), iupac.set_distance(F.lit("A"), F.lit("S")).alias("d"), iupac.set_distance(F.lit("A"), F.lit(None)).alias("e"), iupac.token_to_code(F.lit("1|0"), F.lit("A"), F.array(F.lit("G"))).alias("f"), iupac.token_to_code(F.lit("A/C")).alias("g")).first()
    assert tuple(row) == ("N", "M", 0, 1, 1, "R", "M")


def test_reference_alleles(spark):
    f = frame_of(spark, ["AR", "CG", "MA", "AN"])
    assert [(r["ref"], r["alt"]) for r in encodings.reference_alleles(f).orderBy("locus_idx").collect()] == [("A", ["C"]), ("A", ["G"])]
    assert [(r["ref"], r["alt"]) for r in encodings.reference_alleles_by_homozygotes(f).orderBy("locus_idx").collect()] == [("A", ["C"]), ("A", ["G"])]


def test_sequences(spark):
    df = spark.createDataFrame([("acgtRYn-",), ("",), (None,)], "s string")
    got = df.select(sequences.simplify(F.col("s")).alias("a"), sequences.reverse_complement(F.col("s")).alias("b"), sequences.sequence_counts(F.col("s"))["VAR"].alias("v")).collect()
    assert tuple(got[0]) == ("**N-", "-nRYacgt", 2)
    assert tuple(got[1]) == ("", "", 0)
    assert tuple(got[2]) == (None, None, None)
    row = spark.range(1).select(sequences.safe_divide(F.lit(1), F.lit(0)).alias("a"), sequences.safe_divide(F.lit(1), F.lit(4)).alias("b"), sequences.allele_counts(F.array(F.lit("A"), F.lit("M"), F.lit("C"), F.lit("C"))).alias("c"), sequences.n_alleles(F.array(F.lit("A"), F.lit("V"))).alias("d")).first()
    assert tuple(row) == (None, 0.25, ["C", "A"], 3)


def test_resolved_alleles(spark):
    """Bases stay; an ambiguous code gives its most frequent base; what is lacking comes from the calls."""
    rows = ["AGACN", "RGACN", "GTAMN", "GTCAN"]
    f = frame_of(spark, rows, ref="ARNCN", alt=[["G"], ["K"], [], ["A"], []])
    got = {r["locus_idx"]: (r["ref"], r["alt"]) for r in encodings.resolved_alleles(f).collect()}
    assert {k: got[k] for k in range(4)} == {0: ("A", "G"), 1: ("G", "T"), 2: ("A", "C"), 3: ("C", "A")}
    with pytest.raises(ConfigurationError):
        encodings.with_calls(f, f.calls, "gt", "other")
    assert matrix(encodings.with_calls(f, encodings.encode_int(f), "code", "int")) == rows

from __future__ import annotations

from helpers import frame_of

from lociflow.__main__ import main
from lociflow.operators import reports


def test_layouts(spark):
    table = spark.createDataFrame([("a", "b", 0.1234, 0.1, 0.2, 0.004)], "pop1 string, pop2 string, value double, lower double, upper double, p double")
    cells = lambda layout: {(r["row"], r["column"]): r["text"] for r in reports.pairwise_layout(table, layout).collect()}
    assert cells("value_p") == {("a", "b"): "0.004", ("b", "a"): "0.123"}
    assert cells("value_ci")["a", "b"] == "(0.100, 0.200)"
    assert cells("value_stars") == {("a", "b"): "**", ("b", "a"): "0.123**"}


def test_published(spark):
    schema = "population string, ne double, ne_lower double, ne_upper double"
    got = reports.published_comparison(spark.createDataFrame([("a", 10.2, 9.0, 11.0)], schema), spark.createDataFrame([("a", 10.0, 9.5, 10.5), ("b", 1.0, 0.0, 2.0)], schema))
    assert {r["population"]: r["passes"] for r in got.collect()} == {"a": True, "b": None}


def test_curves(spark):
    f = frame_of(spark, ["AANC", "ACCC"])
    rows = reports.threshold_curves(f.search_thresholds((0.4, 1.0), (0.0,), (2,), ("filter_missing",))).filter("kind = 'missing'").collect()
    assert {r["threshold"]: r["removed_share"] for r in rows} == {0.4: 0.25, 1.0: 0.0}


def test_command(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t1\t.\tA\tC\t.\tPASS\t.\tGT\t0/1\t1/1\n1\t2\t.\tA\tC\t.\tPASS\t.\tGT\t./.\t./.\n")
    main([str(tmp_path / "a.vcf"), "--prefix", str(tmp_path / "run"), "--missing", "0.5", "--reps", "2"])
    assert spark.read.text(str(tmp_path / "run_output/data/filtered")).filter("not value like '#%'").count() == 1

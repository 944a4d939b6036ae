from __future__ import annotations

import time

import pytest
from helpers import matrix

from lociflow.errors import AlignmentError, AlleleEncodingError, PopulationMapError
from lociflow.operators.trees import parse_newick, patristic_distances
from lociflow.sources import readers, writers
from lociflow.streaming.ingest import ingest_vcf_shards

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3
chr10\t5\t.\tA\tG\t.\tPASS\tNS=3\tGT:AD\t0/0:3,0\t0|1:1,2\t1/1:0,9
chr2\t7\trs1\tC\tT,G\t50\tPASS\tDP=9;DB\tGT:AD\t0/2:1,0,1\t./.:.\t./1:0,4,0
chr2\t3\t.\tT\tTA\t.\tPASS\t.\tGT:AD\t0/0:5,0\t0/1:1,1\t1/1:0,2
"""


def test_vcf(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    f = readers.read_vcf(spark, str(tmp_path / "a.vcf"))
    # Natural order: chr2 before chr10; insertions are no single base.
    assert [r["marker_name"] for r in f.loci.orderBy("locus_idx").collect()] == ["chr2:3", "chr2:7", "chr10:5"]
    assert matrix(f) == ["TSA", "NNR", "NNG"]
    assert f.calls.filter("locus_idx = 1 and sample_idx = 2").first()["depth"] == 4
    assert f.loci.filter("locus_idx = 1").first()["info"] == {"DP": "9", "DB": "."}
    fields = readers.vcf_format_fields(spark, str(tmp_path / "a.vcf"))
    assert fields.filter("chrom = 'chr10' and sample_idx = 1").first()["fields"] == {"AD": "1,2"}
    writers.write_vcf(f, str(tmp_path / "out"))
    text = spark.read.text(str(tmp_path / "out")).collect()
    assert [r[0] for r in text][4].split("\t")[3:] == ["C", "T,G", "50", "PASS", "DP=9;DB", "GT", "0/2", "./.", "./."]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.vcf").write_text(VCF)
    ingest_vcf_shards(spark, str(tmp_path / "in"), str(tmp_path / "calls"), str(tmp_path / "log"))
    ingest_vcf_shards(spark, str(tmp_path / "in"), str(tmp_path / "calls"), str(tmp_path / "log"))
    got = spark.read.parquet(str(tmp_path / "calls"))
    assert got.count() == 9
    # A shard with another order of columns, which comes later.
    (tmp_path / "in" / "b.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts3\ts1\ts2\nchr1\t1\t.\tA\tG\t.\tPASS\t.\tGT\t1/1\t0/0\t0/1\n")
    ingest_vcf_shards(spark, str(tmp_path / "in"), str(tmp_path / "calls"), str(tmp_path / "log"))
    got = spark.read.parquet(str(tmp_path / "calls"))
    assert {(r["sample_id"], r["gt"]) for r in got.filter("chrom = 'chr1'").collect()} == {("s1", "A"), ("s2", "R"), ("s3", "G")}
    assert got.count() == 12


def test_vcf_folder(spark, tmp_path_factory):
    tmp_path, out = tmp_path_factory.mktemp("in"), tmp_path_factory.mktemp("out") / "vcf"
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    (tmp_path / "a.vcf").write_text(f"##fileformat=VCFv4.2\n##FORMAT=<ID=DP>\n{head}s1\ts2\n1\t5\t.\tA\tG\t.\tPASS\t.\tGT:DP\t0/0:3\t0/1:4\n")
    (tmp_path / "b.vcf").write_text(f"##fileformat=VCFv4.2\n{head}s2\ts1\n1\t2\t.\tC\tT\t.\tPASS\t.\tDP:GT\t9:0/0\t8:1/1\n")
    f = readers.read_vcf(spark, str(tmp_path), keep_format=True)
    assert matrix(f) == ["TA", "CR"]
    assert {(r["locus_idx"], r["sample_idx"], r["extra"]) for r in f.calls.collect()} == {(0, 0, "8"), (0, 1, "9"), (1, 0, "3"), (1, 1, "4")}
    header = readers.vcf_header(spark, str(tmp_path))
    assert header == ["##fileformat=VCFv4.2", "##FORMAT=<ID=DP>"]
    for single in (True, False):
        writers.write_vcf(f, str(out), header, single)
        again = readers.read_vcf(spark, str(out), keep_format=True)
        assert matrix(again) == matrix(f)
        assert readers.vcf_header(spark, str(out)) == header
        assert sorted(map(tuple, again.calls.select("locus_idx", "sample_idx", "extra").collect())) == sorted(map(tuple, f.calls.select("locus_idx", "sample_idx", "extra").collect()))
    (tmp_path / "b.vcf").write_text(f"{head}s2\n1\t2\t.\tC\tT\t.\tPASS\t.\tGT\t0/0\n")
    with pytest.raises(AlignmentError):
        readers.read_vcf(spark, f"{tmp_path}/*.vcf")


def test_exploded_calls_are_not_broadcast(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    f = readers.read_vcf(spark, str(tmp_path / "a.vcf"))
    writers.write_phylip(f, str(tmp_path / "phy"))
    popmap = spark.createDataFrame([("s1", "a"), ("s2", "a"), ("s3", "b")], "sample_id string, population string")
    for frame in (f, readers.read_vcf(spark, str(tmp_path / "a.vcf"), popmap), readers.read_phylip(spark, str(tmp_path / "phy"))):
        assert "SortMergeJoin [sample_idx" in frame.with_population()._jdf.queryExecution().executedPlan().toString()
        assert frame.with_population().count() == 9
    # The parts of one file are read as it is.
    writers.write_vcf(f, str(tmp_path / "parts"), single=False)
    again = readers.read_vcf(spark, str(tmp_path / "parts"))
    assert "SortMergeJoin [sample_idx" in again.with_population()._jdf.queryExecution().executedPlan().toString()
    assert again.with_population().count() == 9


def test_phylip_round_trip(spark, tmp_path):
    (tmp_path / "a.phy").write_text("2 4\nx ACRN\ny GGTT\n")
    f = readers.read_phylip(spark, str(tmp_path / "a.phy"))
    assert matrix(f) == ["ACRN", "GGTT"]
    writers.write_phylip(f, str(tmp_path / "out"))
    assert matrix(readers.read_phylip(spark, str(tmp_path / "out"))) == ["ACRN", "GGTT"]
    (tmp_path / "b.phy").write_text("3 4\nx ACRN\ny GGTT\n")
    with pytest.raises(AlignmentError):
        readers.read_phylip(spark, str(tmp_path / "b.phy"))


@pytest.mark.parametrize("onerow", [True, False])
def test_structure_round_trip(spark, tmp_path, onerow):
    (tmp_path / "a.phy").write_text("2 4\nx ACRN\ny GGTK\n")
    f = readers.read_phylip(spark, str(tmp_path / "a.phy"))
    writers.write_structure(f, str(tmp_path / "out"), onerow=onerow, popids=True, marker_names=True)
    g = readers.read_structure(spark, str(tmp_path / "out"), has_popids=True, has_marker_names=True)
    assert matrix(g) == ["ACRN", "GGTK"]
    with pytest.raises(AlleleEncodingError):
        readers.read_structure(spark, str(tmp_path / "out"), has_popids=True, has_marker_names=True, alleles={1: "A", -9: "N"})


def test_structure_of_long_rows(spark, tmp_path):
    n = 5_000
    rows = ["\t".join([f"s{k}", *(x for j in range(n) for x in (str((j + k) % 4 + 1), "-9" if j == k else str(j % 4 + 1)))]) for k in range(10)]
    (tmp_path / "a.str").write_text("\n".join(rows) + "\n")
    start = time.monotonic()
    got = matrix(readers.read_structure(spark, str(tmp_path / "a.str")))
    assert time.monotonic() - start < 60  # each allele once, not each line once an allele
    codes = {frozenset("A"): "A", frozenset("C"): "C", frozenset("G"): "G", frozenset("T"): "T", **{frozenset(p): c for p, c in zip(("AC", "AG", "AT", "CG", "CT", "GT"), "MRWSYK", strict=True)}}
    assert got == ["".join("N" if j == k else codes[frozenset(("ACGT"[(j + k) % 4], "ACGT"[j % 4]))] for j in range(n)) for k in range(10)]


def test_genepop(spark, tmp_path):
    (tmp_path / "a.gen").write_text("title\nL1\nL2\nL3\nPop\na , 0101 0202 0304\nPOP\nb , 0102 0303 0404\nc , 0000 9999 001001\n")
    f = readers.read_genepop(spark, str(tmp_path / "a.gen"))
    assert matrix(f) == ["ACK", "MGT", "NNA"]
    assert [r["population"] for r in f.samples.orderBy("sample_idx").collect()] == ["Pop1", "Pop2", "Pop2"]
    writers.write_genepop(f, str(tmp_path / "out"), by_population=True)
    assert matrix(readers.read_genepop(spark, str(tmp_path / "out"))) == ["ACK", "MGT", "NNA"]


def test_popmap(spark, tmp_path):
    (tmp_path / "a.phy").write_text("2 2\nx AC\ny GG\n")
    (tmp_path / "m.csv").write_text("SampleID,PopulationID\nx,p\nx,q\nz,r\n")
    popmap = readers.read_popmap(spark, str(tmp_path / "m.csv"))
    assert {(r[0], r[1]) for r in popmap.collect()} == {("x", "q"), ("z", "r")}
    with pytest.raises(PopulationMapError):
        readers.read_phylip(spark, str(tmp_path / "a.phy"), popmap)
    f = readers.read_phylip(spark, str(tmp_path / "a.phy"), popmap, force=True)
    assert matrix(f) == ["AC"]
    with pytest.raises(PopulationMapError):
        readers.subset_populations(f, exclude=["q"])


@pytest.mark.parametrize(("text", "want"), [("a pop\nb q\n", {("a", "pop"), ("b", "q")}), ("sampleids popids\nx p\n", {("x", "p")}), ("PopID,note,SampleID\np,1,x\n", {("x", "p")}), ("id1,population\nid2,sample\n", {("id1", "population"), ("id2", "sample")})])
def test_popmap_headers(spark, tmp_path, text, want):
    (tmp_path / "m").write_text(text)
    assert {(r["sample_id"], r["population"]) for r in readers.read_popmap(spark, str(tmp_path / "m")).collect()} == want


def test_blank_lines(spark, tmp_path):
    """Files whose lines are not numbered without gaps."""
    (tmp_path / "a.phy").write_text("2 4\n\nx ACRN\n\ny GGTT\n\n")
    assert matrix(readers.read_phylip(spark, str(tmp_path / "a.phy"))) == ["ACRN", "GGTT"]
    (tmp_path / "a.gen").write_text("title\nL1, L2\nPop\n\na , 0101 0202\n\nPOP\nb , 0102 0303\n")
    f = readers.read_genepop(spark, str(tmp_path / "a.gen"))
    assert matrix(f) == ["AC", "MG"]
    assert [r["population"] for r in f.samples.orderBy("sample_idx").collect()] == ["Pop1", "Pop2"]


def test_rates(spark, tmp_path):
    (tmp_path / "q").write_text("Rate matrix Q:\n\n  A -1 0.2 0.3 0.5\n  C 0.1 -1 0.4 0.5\n  G 0.1 0.2 -1 0.7\n  T 0.3 0.3 0.4 -1\n")
    assert readers.read_qmatrix(spark, str(tmp_path / "q")).filter("base = 'C'").first()["G"] == 0.4
    (tmp_path / "r").write_text("# made\nSite\tRate\n1\t0.5\n2\t1.5\n")
    assert [r["rate"] for r in readers.read_site_rates(spark, str(tmp_path / "r"), 2).orderBy("locus_idx").collect()] == [0.5, 1.5]


def test_tree(spark):
    tree = parse_newick("((a:1,b:2)x:1,(c:3,'d e':1):2);")
    assert tree.tips() == ["a", "b", "c", "d e"]
    assert parse_newick(tree.newick().replace("d e", "'d e'")).stats() == tree.stats()
    want = {("a", "b"): 3, ("a", "c"): 7, ("b", "d e"): 6}
    got = {(r["tip1"], r["tip2"]): r["distance"] for r in patristic_distances(spark, tree).collect()}
    assert all(got[k] == v for k, v in want.items())
    moved = {frozenset((r["tip1"], r["tip2"])): r["distance"] for r in patristic_distances(spark, tree.reroot("a")).collect()}
    assert all(moved[frozenset(k)] == pytest.approx(v) for k, v in got.items())
    assert tree.prune(["a", "c"]).tips() == ["a", "c"]
    with pytest.raises(AlignmentError):
        parse_newick("(a,b")

"""Queries that write a file of the genotype bridge, read it back and return what the reader found."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..genotypes import GenotypeFrame
from ..shared import _path, shared_dir
from ..sources import readers, writers
from ..streaming.ingest import ingest_vcf_shards
from .bridge import bridge
from .genomics import _CHAIN, _COPIES, METRICS, _add


def _folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared one, which goes when the driver's file system is closed."""
    path = f"{shared_dir(spark)}/lociflow-{kind}-{uuid.uuid4().hex}"
    target, files = _path(spark, path)
    files.deleteOnExit(target)
    return path


def _cells(frame: GenotypeFrame, *keys: str) -> DataFrame:
    """Calls with the samples' names and, for VCF, the loci's places."""
    cells = frame.calls.join(frame.samples.select("sample_idx", "sample_id", "population"), "sample_idx")
    cells = cells.join(frame.loci.select("locus_idx", *[k for k in keys if k in ("chrom", "pos")]), "locus_idx")
    return cells.select(*keys, "sample_id", "gt")


def _written(s, d, kind: str, **options) -> str:
    """A file of the bridge. Names of populations have no spaces there, which would end a column in some kinds."""
    path, frame = _folder(s, kind), bridge(s, d)
    if kind != "popmap":
        frame = GenotypeFrame(frame.calls, frame.loci, frame.samples.withColumn("population", F.translate("population", " ", "_")))
    getattr(writers, f"write_{kind}")(frame, path, **options)
    return path


_SAMPLE = "CAST(sample_id AS VARCHAR) AS sample_id"
_MATRIX = f"SELECT locus_id AS locus_idx, {_SAMPLE}, gt FROM calls"
_add("vcf_calls", lambda s, d: _cells(readers.read_vcf(s, _written(s, d, "vcf")), "chrom", "pos"), f"SELECT CAST(chrom AS VARCHAR) AS chrom, pos, {_SAMPLE}, gt FROM calls")
_add("vcf_calls_of_parts", lambda s, d: _cells(readers.read_vcf(s, _written(s, d, "vcf", single=False)), "chrom", "pos"), f"SELECT CAST(chrom AS VARCHAR) AS chrom, pos, {_SAMPLE}, gt FROM calls")
_add(
    "vcf_loci",
    lambda s, d: readers.read_vcf(s, _written(s, d, "vcf")).loci.select("locus_idx", "chrom", "pos", "id", "ref", F.array_join("alt", ",").alias("alt"), "qual", "filter", F.col("info")["NS"].cast("long").alias("ns"), "format", "marker_name"),
    """, ns AS (SELECT locus_id, count(gt) AS ns FROM calls GROUP BY 1)
    SELECT row_number() OVER (ORDER BY chrom, pos) - 1 AS locus_idx, CAST(chrom AS VARCHAR) AS chrom, pos, 'locus' || (locus_id + 1) AS id, ref, CASE WHEN locus_id % 17 = 0 THEN alt || ',' || alt2 ELSE alt END AS alt,
        '.' AS qual, 'PASS' AS filter, ns, 'GT' AS format, chrom || ':' || pos AS marker_name FROM loc JOIN ns USING (locus_id)""",
)


def _incremental(s, d):
    """Two shards that come one after the other, and a call without news."""
    source, target, log = (_folder(s, x) for x in ("shards", "ingested", "log"))
    frame = bridge(s, d)
    for k in (0, 1):
        part = GenotypeFrame(frame.calls.filter(F.col("locus_idx") % 2 == k), frame.loci.filter(F.col("locus_idx") % 2 == k), frame.samples)
        writers.write_vcf(part, f"{source}/{k}")
        ingest_vcf_shards(s, f"{source}/*", target, log)
    ingest_vcf_shards(s, f"{source}/*", target, log)
    return s.read.parquet(target).drop("batch")


_add("vcf_incremental", _incremental, f"SELECT CAST(chrom AS VARCHAR) AS chrom, pos, {_SAMPLE}, gt FROM calls")
_add("phylip_calls", lambda s, d: _cells(readers.read_phylip(s, _written(s, d, "phylip")), "locus_idx"), _MATRIX)
_add(
    "phylip_alleles",
    lambda s, d: readers.read_phylip(s, _written(s, d, "phylip")).loci.select("locus_idx", "marker_name", "ref", F.array_join("alt", ",").alias("alt")),
    _COPIES + ", r AS (SELECT *, row_number() OVER (PARTITION BY locus_id ORDER BY copies DESC, het, base) AS r FROM g) SELECT locus_id AS locus_idx, 'locus_' || (locus_id + 1) AS marker_name, max(base) FILTER (r = 1) AS ref, coalesce(string_agg(base, ',' ORDER BY r) FILTER (r > 1), '') AS alt FROM r GROUP BY 1, 2",
)
_POPULATED = f"SELECT locus_id AS locus_idx, population, {_SAMPLE}, gt FROM calls"
for _onerow in (True, False):
    _add(
        f"structure_calls_{'one' if _onerow else 'two'}_row",
        lambda s, d, o=_onerow: _cells(readers.read_structure(s, _written(s, d, "structure", onerow=o, popids=True, marker_names=True), has_popids=True, has_marker_names=True), "locus_idx", "population"),
        _POPULATED.replace("population,", "replace(population, ' ', '_') AS population,"),
    )
_add(
    "genepop_calls",
    lambda s, d: _cells(readers.read_genepop(s, _written(s, d, "genepop", by_population=True)), "locus_idx", "population"),
    f"SELECT locus_id AS locus_idx, 'Pop' || dense_rank() OVER (ORDER BY population) AS population, {_SAMPLE}, gt FROM calls",
)
_add("popmap_rows", lambda s, d: readers.read_popmap(s, _written(s, d, "popmap")), f"SELECT {_SAMPLE}, population FROM smp")
_add(
    "popmap_subset",
    lambda s, d: readers.subset_populations(bridge(s, d), ["ASIA", "EUROPE", "AFRICA"]).with_population().groupBy("population").agg(F.count("gt").alias("n_called")),
    "SELECT population, count(gt) AS n_called FROM calls WHERE population IN ('ASIA', 'EUROPE', 'AFRICA') GROUP BY 1",
)


def _report(s, d, kind: str):
    path = _folder(s, "report")
    frame = bridge(s, d)
    writers.write_report(frame.samples.groupBy("population").agg(F.count("*").alias("n"), F.max("sample_idx").alias("last")), path, kind, compress=True)
    return s.read.schema("population string, n long, last long").option("header", True).format(kind).load(path)


for _kind in ("csv", "json"):
    _add(f"report_{_kind}", lambda s, d, k=_kind: _report(s, d, k), "SELECT population, count(*) AS n, max(sample_id) AS last FROM smp GROUP BY 1")


def _saved(s, d):
    """Filtered, saved over the whole bundle, and loaded."""
    path = _folder(s, "bundle")
    writers.save_frame(bridge(s, d), path)
    writers.save_frame(readers.load_frame(s, path).filter_missing(0.3).filter_maf(0.05).filter_biallelic().filter_singletons().resolve(), path)
    return readers.load_frame(s, path).calls.groupBy("locus_idx").agg(F.count("gt").alias("n_called"))


_add("bundle_saved_again", _saved, _CHAIN + "SELECT locus_id AS locus_idx, c AS n_called FROM s4", METRICS)

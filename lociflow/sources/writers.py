"""Writers of bundles: each file is ordered text from one aggregate a line, written through Spark."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import iupac, sequences
from ..genotypes import GenotypeFrame
from ..shared import _path

__all__ = ["output_path", "save_frame", "write_genepop", "write_phylip", "write_popmap", "write_report", "write_structure", "write_vcf"]


def output_path(prefix: str, kind: str, operation: str | None = None) -> str:
    """``<prefix>_output/<kind>[/<operation>]``; kinds are data, logs, plots and reports."""
    if kind not in ("data", "logs", "plots", "reports"):
        raise ValueError(f"unknown kind: {kind}")
    if operation is not None and not re.fullmatch(r"[A-Za-z0-9_-]+", operation):
        raise ValueError(f"bad operation name: {operation}")
    return str(PurePosixPath(f"{prefix}_output", kind, *([operation] if operation else [])))


def _write_lines(lines: DataFrame, header: list[str], path: str, single: bool = True) -> None:
    """``lines(order.., line)`` in order, after the header, as text in the folder ``path``: one file, or the parts of one in the order of their names."""
    spark = lines.sparkSession
    order = [c for c in lines.columns if c != "line"]
    body = lines.select(F.lit(1).alias("__part"), *order, "line")
    if header:
        top = spark.createDataFrame([(k, h) for k, h in enumerate(header)], "k long, line string")
        names = {c: F.col("k").cast(t) if t in ("bigint", "int") else F.lit(None).cast(t) for c, t in lines.select(*order).dtypes}
        body = body.unionByName(top.select(F.lit(0).alias("__part"), *[v.alias(c) for c, v in names.items()], "line"))
    # Most programs demand one file; a range sort feeds it, so that no task sorts all lines.
    ordered = body.orderBy("__part", *order).select("line")
    (ordered.coalesce(1) if single else ordered).write.mode("overwrite").text(path)


def _by_sample(frame: GenotypeFrame, value: Column, join: str) -> DataFrame:
    kept = frame.calls.join(frame.loci.select("locus_idx"), "locus_idx", "left_semi")
    cells = kept.groupBy("sample_idx").agg(F.array_sort(F.collect_list(F.struct("locus_idx", value.alias("v")))).alias("c"))
    return frame.samples.join(cells, "sample_idx").withColumn("text", F.array_join(F.transform("c", lambda x: x["v"]), join)).drop("c")


def write_phylip(frame: GenotypeFrame, path: str) -> None:
    rows = _by_sample(frame, F.coalesce("gt", F.lit("N")), "")
    _write_lines(rows.select("sample_idx", F.concat_ws("\t", "sample_id", "text").alias("line")), [f"{frame.samples.count()} {frame.loci.count()}"], path)


def write_structure(frame: GenotypeFrame, path: str, onerow: bool = False, popids: bool = False, marker_names: bool = False) -> None:
    a1, a2 = iupac.two_channel(F.col("gt"))
    number = lambda a: F.when(a < 0, "-9").otherwise((a + 1).cast("string"))
    lead = ["sample_id", "population"] if popids else ["sample_id"]
    header = ["\t" * len(lead) + "\t".join(r["marker_name"] for r in frame.loci.select("locus_idx", "marker_name").orderBy("locus_idx").collect())] if marker_names else []
    if onerow:
        rows = _by_sample(frame, F.concat_ws("\t", number(a1), number(a2)), "\t")
        lines = rows.select("sample_idx", F.lit(0).alias("part"), F.concat_ws("\t", *lead, "text").alias("line"))
    else:
        lines = None
        for k, a in enumerate((a1, a2)):
            part = _by_sample(frame, number(a), "\t").select("sample_idx", F.lit(k).alias("part"), F.concat_ws("\t", *lead, "text").alias("line"))
            lines = part if lines is None else lines.unionByName(part)
    _write_lines(lines, header, path)


def write_genepop(frame: GenotypeFrame, path: str, title: str = "Genotypes", by_population: bool = False) -> None:
    """One ``Pop`` section, or one a population."""
    a1, a2 = iupac.two_channel(F.col("gt"))
    number = lambda a: F.lpad(F.greatest(a + 1, F.lit(0)).cast("string"), 2, "0")
    rows = _by_sample(frame, F.concat(number(a1), number(a2)), " ").select("population", "sample_idx", F.concat_ws(" ", F.concat("sample_id", F.lit(" ,")), "text").alias("line"))
    markers = [r["marker_name"] for r in frame.loci.select("locus_idx", "marker_name").orderBy("locus_idx").collect()]
    if by_population:
        pops = frame.samples.select("population").distinct().select("population", F.lit(-1).cast("long").alias("sample_idx"), F.lit("Pop").alias("line"))
        _write_lines(rows.unionByName(pops).select("population", "sample_idx", "line"), [title, *markers], path)
    else:
        _write_lines(rows.select("sample_idx", "line"), [title, *markers, "Pop"], path)


def write_vcf(frame: GenotypeFrame, path: str, header: list[str] | None = None, single: bool = True) -> None:
    """Fixed fields of the loci (synthetic where they have none) and a genotype a sample; calls outside ref and alts are ``./.``.

    Calls that kept their other FORMAT values (``extra``) are written with them; ``header`` takes the definitions that
    ``vcf_header`` reads. Not ``single``: parts of the file, each written by a task of its own.
    """
    alleles = F.concat(F.array("ref"), F.col("alt"))
    own = iupac.bases_of(F.col("gt"))
    index = lambda b: (F.array_position("alleles", b) - 1).cast("int")
    i, j = index(F.element_at(own, 1)), index(F.element_at(own, -1))
    known = F.size(own).between(1, 2) & (F.size(F.array_except(own, F.col("alleles"))) == 0)
    field = F.when(known, F.concat_ws("/", F.least(i, j).cast("string"), F.greatest(i, j).cast("string"))).otherwise("./.")
    cells = frame.calls.join(frame.samples.select("sample_idx"), "sample_idx", "left_semi").join(frame.loci.select("locus_idx", alleles.alias("alleles")), "locus_idx").withColumn("v", F.when(F.size(own) > 0, field).otherwise("./."))
    kept = "extra" in cells.columns and "format" in frame.loci.columns
    if kept:
        cells = cells.withColumn("v", F.concat_ws(":", "v", F.nullif("extra", F.lit(""))))
    lines = cells.groupBy("locus_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "v"))), lambda x: x["v"]), "\t").alias("cells"), F.count("gt").alias("ns"))
    has = lambda c, other: sequences.clean_vcf_id(F.col(c)) if c in frame.loci.columns else other
    loci = frame.loci.join(lines, "locus_idx")
    info = F.when(F.size("info") > 0, F.array_join(F.transform(F.map_entries("info"), lambda e: F.when(e["value"] == ".", e["key"]).otherwise(F.concat_ws("=", e["key"], e["value"]))), ";")).otherwise(".") if "info" in frame.loci.columns else F.concat(F.lit("NS="), F.col("ns"))
    fixed = [F.col("chrom"), F.col("pos").cast("string"), has("id", F.concat(F.lit("locus"), F.col("locus_idx") + 1)), F.coalesce("ref", F.lit("N")), F.when(F.size("alt") > 0, F.array_join("alt", ",")).otherwise("."), has("qual", F.lit(".")), F.coalesce(F.col("filter"), F.lit("PASS")) if "filter" in frame.loci.columns else F.lit("PASS"), info, F.array_join(F.concat(F.array(F.lit("GT")), F.filter(F.split("format", ":"), lambda x: x != "GT")), ":") if kept else F.lit("GT"), F.col("cells")]
    names = [r["sample_id"] for r in frame.samples.orderBy("sample_idx").collect()]
    top = [h for h in header or ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">'] if not h.startswith("#CHROM")]
    _write_lines(loci.select("locus_idx", F.concat_ws("\t", *fixed).alias("line")), [*top, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])], path, single)


def save_frame(frame: GenotypeFrame, path: str) -> None:
    """The bundle as Parquet tables below ``path``: calls and loci that are kept, and samples. An older bundle there is replaced as a whole."""
    spark = frame.spark
    fresh, target = f"{path}.new", path
    kept = frame.calls.join(frame.loci.select("locus_idx"), "locus_idx", "left_semi").join(frame.samples.select("sample_idx"), "sample_idx", "left_semi")
    for name, table in (("calls", kept), ("loci", frame.loci), ("samples", frame.samples)):
        table.write.mode("overwrite").parquet(f"{fresh}/{name}")
    old, files = _path(spark, target)
    files.delete(old, True)
    files.rename(_path(spark, fresh)[0], old)


def write_popmap(frame: GenotypeFrame, path: str) -> None:
    """``sample,population`` lines by population."""
    _write_lines(frame.samples.select("population", "sample_idx", F.concat_ws(",", "sample_id", "population").alias("line")), [], path)


def write_report(rows: DataFrame, path: str, kind: str = "csv", compress: bool = False) -> None:
    """A result as CSV with a header, or JSON lines; gzip on demand."""
    if kind not in ("csv", "json"):
        raise ValueError(f"unknown kind: {kind}")
    writer = rows.write.mode("overwrite").option("compression", "gzip" if compress else "none")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)

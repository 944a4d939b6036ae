"""Encodings of calls as DataFrames over (locus_idx, sample_idx)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import ConfigurationError
from ..functions import iupac
from ..genotypes import GenotypeFrame

__all__ = ["decode_frame", "decode_012", "encode_012", "encode_int", "encode_onehot", "observed_bases", "predicates", "reference_alleles", "reference_alleles_by_homozygotes", "resolved_alleles", "two_channel", "with_calls"]


def _kept(frame: GenotypeFrame) -> DataFrame:
    return frame.calls.join(frame.samples.select("sample_idx"), "sample_idx", "left_semi")


def encode_012(frame: GenotypeFrame) -> DataFrame:
    """``dosage``: copies of non-reference bases; null if missing, of more than two bases, or with a base that is neither
    the locus' ref nor one of its alts."""
    alleles = F.concat(F.array("ref"), F.col("alt"))
    own = iupac.bases_of(F.col("gt"))
    joined = _kept(frame).join(frame.loci.select("locus_idx", "ref", "alt"), "locus_idx")
    known = F.size(own).between(1, 2) & (F.size(F.array_except(own, alleles)) == 0)
    count = F.when(iupac.is_hom(F.col("gt")), F.when(F.col("gt") == F.col("ref"), 0).otherwise(2)).otherwise(F.when(F.array_contains(own, F.col("ref")), 1).otherwise(2))
    return joined.select("locus_idx", "sample_idx", F.when(known, count).alias("dosage"))


def decode_012(dosages: DataFrame, loci: DataFrame) -> DataFrame:
    """Codes of dosages with the locus' ref and first alt; ``N`` for all else."""
    joined = dosages.join(loci.select("locus_idx", "ref", F.get("alt", 0).alias("a")), "locus_idx")
    gt = F.when(F.col("dosage") == 0, F.col("ref")).when(F.col("dosage") == 1, iupac.from_pair(F.col("ref"), F.col("a"))).when(F.col("dosage") == 2, F.col("a"))
    return joined.select("locus_idx", "sample_idx", F.coalesce(gt, F.lit("N")).alias("gt"))


def resolved_alleles(frame: GenotypeFrame) -> DataFrame:
    """(locus_idx, ref, alt): one base each for decoding. A base of the locus stays; an ambiguous code gives the most frequent of
    its bases in the calls, then the first by name; what is lacking comes from the calls' bases by their number."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("copies")).alias("n"), "base")))
    seen = _base_rows(frame).groupBy("locus_idx").agg(F.transform(ranked, lambda x: x["base"]).alias("seen"))
    loci = frame.loci.select("locus_idx", "ref", F.get("alt", 0).alias("alt")).join(seen, "locus_idx", "left")
    bases = F.coalesce("seen", F.array().cast("array<string>"))

    def pick(code: Column, other: Column | None) -> Column:
        free = lambda b: F.coalesce(b != other, F.lit(True)) if other is not None else F.lit(True)
        own = F.filter(F.coalesce(iupac.bases_of(code), F.array().cast("array<string>")), free)
        left = F.filter(bases, free)
        return F.coalesce(F.get(F.concat(F.filter(left, lambda b: F.array_contains(own, b)), own), 0), F.get(left, 0))

    loci = loci.withColumn("ref", pick(F.col("ref"), None))
    return loci.select("locus_idx", "ref", pick(F.col("alt"), F.col("ref")).alias("alt"))


def decode_frame(frame: GenotypeFrame, dosages: DataFrame) -> DataFrame:
    """Codes of ``dosages(locus_idx, sample_idx, dosage)`` with the resolved alleles of the frame's loci."""
    return decode_012(dosages, resolved_alleles(frame).withColumn("alt", F.array("alt")))


def with_calls(frame: GenotypeFrame, rows: DataFrame, value: str, kind: str) -> GenotypeFrame:
    """The frame with its calls replaced by decoded ``rows(locus_idx, sample_idx, value)``; ``kind``: 012, onehot, int or code."""
    if kind == "012":
        made = decode_frame(frame, rows.withColumnRenamed(value, "dosage"))
    else:
        decoders = {"onehot": iupac.onehot_to_code, "int": iupac.int_to_code, "code": iupac.normalise}
        if kind not in decoders:
            raise ConfigurationError(f"unknown encoding: {kind}")
        made = rows.select("locus_idx", "sample_idx", decoders[kind](F.col(value)).alias("gt"))
    return GenotypeFrame(made.withColumn("gt", F.when(F.col("gt") != "N", F.col("gt"))), frame.loci, frame.samples)


def encode_onehot(frame: GenotypeFrame, het_value: float = 1.0) -> DataFrame:
    if not 0 < het_value <= 1:
        raise ValueError("het_value must be in (0, 1]")
    return _kept(frame).select("locus_idx", "sample_idx", iupac.onehot(F.col("gt"), het_value).alias("onehot"))


def encode_int(frame: GenotypeFrame) -> DataFrame:
    return _kept(frame).select("locus_idx", "sample_idx", iupac.int_code(F.coalesce("gt", F.lit("N"))).alias("code"))


def two_channel(frame: GenotypeFrame) -> DataFrame:
    a1, a2 = iupac.two_channel(F.col("gt"))
    return _kept(frame).select("locus_idx", "sample_idx", a1.alias("a1"), a2.alias("a2"))


def _base_rows(frame: GenotypeFrame) -> DataFrame:
    """(locus_idx, base, copies, het carriers) by partial aggregate of a row for each base of a call."""
    own = iupac.bases_of(F.col("gt"))
    rows = _kept(frame).filter(F.size(own).between(1, 2)).select("locus_idx", F.explode(own).alias("base"), F.size(own).alias("k"))
    return rows.groupBy("locus_idx", "base").agg(F.sum(F.when(F.col("k") == 1, 2).otherwise(1)).alias("copies"), F.sum((F.col("k") == 2).cast("int")).alias("het"), F.sum(F.lit(1)).alias("codes"))


def reference_alleles(frame: GenotypeFrame) -> DataFrame:
    """ref and alts from the calls: most copies first, of equal ones the fewest heterozygous carriers, then by name."""
    by_rank = Window.partitionBy("locus_idx").orderBy(F.desc("copies"), "het", "base")
    ranked = _base_rows(frame).withColumn("r", F.row_number().over(by_rank))
    alts = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") > 1, F.struct("r", "base")))), lambda x: x["base"])
    return ranked.groupBy("locus_idx").agg(F.max(F.when(F.col("r") == 1, F.col("base"))).alias("ref"), alts.alias("alt"))


def reference_alleles_by_homozygotes(frame: GenotypeFrame) -> DataFrame:
    """ref and alts by number of homozygous calls alone, then by name; ``N`` and ``.`` where there is none."""
    own = _kept(frame).filter(iupac.is_hom(F.col("gt"))).groupBy("locus_idx", "gt").agg(F.count("*").alias("n"))
    listed = own.groupBy("locus_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "gt"))), lambda x: x["gt"]).alias("b"))
    joined = frame.loci.select("locus_idx").join(listed, "locus_idx", "left")
    alt = F.when(F.size("b") > 1, F.slice("b", 2, 3)).otherwise(F.array(F.lit(".")))
    return joined.select("locus_idx", F.coalesce(F.get("b", 0), F.lit("N")).alias("ref"), alt.alias("alt"))


def observed_bases(frame: GenotypeFrame) -> DataFrame:
    """Bases seen at each locus, in order, and whether two of them are (``biallelic``), counting heterozygotes or not."""
    own = iupac.bases_of(F.col("gt"))
    rows = _kept(frame).select("locus_idx", F.explode_outer(own).alias("base"), iupac.is_hom(F.col("gt")).alias("hom"))
    found = rows.groupBy("locus_idx").agg(F.array_join(F.array_sort(F.collect_set("base")), "").alias("bases"), F.size(F.collect_set(F.when(F.col("hom"), F.col("base")))).alias("hom_bases"))
    return found.select("locus_idx", "bases", (F.length("bases") == 2).alias("biallelic"), (F.col("hom_bases") == 2).alias("biallelic_by_homozygotes"), (F.length("bases") > 2).alias("multiallelic"))


def predicates(frame: GenotypeFrame) -> DataFrame:
    """Cell by cell: heterozygous, missing, valid."""
    gt = F.col("gt")
    return _kept(frame).select("locus_idx", "sample_idx", F.coalesce(iupac.is_het(gt), F.lit(False)).alias("het"), gt.isNull().alias("missing"), gt.isNotNull().alias("valid"))

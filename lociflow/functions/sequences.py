"""Text functions over sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .iupac import CODES, bases_of

__all__ = ["allele_counts", "clean_vcf_id", "format_pvalue", "format_interval", "n_alleles", "reverse_complement", "safe_divide", "sequence_counts", "significance_stars", "simplify", "without"]


def safe_divide(a: Column, b: Column) -> Column:
    """``a / b`` as a double; null unless both are finite and ``b`` is above zero."""
    fine = (b > 0) & ~F.isnan(b.cast("double")) & (b.cast("double") < float("inf")) & ~F.isnan(a.cast("double")) & (F.abs(a.cast("double")) < float("inf"))
    return F.when(fine, a.cast("double") / b.cast("double"))


def _upper(text: Column) -> Column:
    """Letters a-z only: sequences are ASCII, and other letters stay as they are."""
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def simplify(text: Column) -> Column:
    """Upper case, plain bases dropped, each ambiguity code a star."""
    return F.translate(F.regexp_replace(_upper(text), "[ACGT]", ""), "RYSWKMBDHV", "**********")


def sequence_counts(text: Column, symbols: str = "ACGTN-RYSWKMBDHV") -> dict[str, Column]:
    """Occurrences of each symbol of the upper-cased text, and ``VAR``: those of all ambiguity codes."""
    up = _upper(text)
    out = {s: F.length(up) - F.length(F.replace(up, F.lit(s), F.lit(""))) for s in symbols}
    out["VAR"] = F.length(up) - F.length(F.translate(up, "RYSWKMBDHV", ""))
    return out


def reverse_complement(text: Column) -> Column:
    return F.reverse(F.translate(text, "ACGTRYKMBVDHacgtrykmbvdh", "TGCAYRMKVBHDtgcayrmkvbhd"))


def n_alleles(codes: Column) -> Column:
    """Distinct bases over an array of codes."""
    return F.size(F.array_distinct(F.flatten(F.transform(codes, bases_of))))


def allele_counts(codes: Column) -> Column:
    """Bases of an array of codes, most frequent first, equal ones by name."""
    flat = F.flatten(F.transform(codes, bases_of))
    pairs = F.transform(F.array_distinct(flat), lambda b: F.struct((-F.size(F.filter(flat, lambda x: x == b))).alias("n"), b.alias("b")))
    return F.transform(F.array_sort(pairs), lambda p: p["b"])


def without(items: Column, drop: Column) -> Column:
    """Items that are not in ``drop``, duplicates kept."""
    return F.filter(items, lambda x: ~F.array_contains(drop, x))


def clean_vcf_id(name: Column) -> Column:
    """``.`` for null and what stands for null in text."""
    return F.when(name.isNull() | F.lower(F.trim(name)).isin("", ".", "none", "nan", "na", "null"), F.lit(".")).otherwise(name)


def significance_stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def format_pvalue(p: Column, digits: int = 3) -> Column:
    return F.when(p.isNull(), "").when(p < 0.001, "<0.001").otherwise(F.format_number(p, digits))


def format_interval(low: Column, high: Column, digits: int = 3) -> Column:
    return F.when(low.isNull() | high.isNull(), "").otherwise(F.concat(F.lit("("), F.format_number(low, digits), F.lit(", "), F.format_number(high, digits), F.lit(")")))


assert len(CODES) == 15

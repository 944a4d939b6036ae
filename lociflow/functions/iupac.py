"""Genotype codes: tables and column functions.

A code is a set of bases. As a bit mask (A 1, C 2, G 4, T 8) the union, intersection and complement of codes are integer
operations that stay inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "BASES", "CODES", "HET_CODES", "INT_CODES", "MISSING", "base_mask", "bases_of", "code_of_mask", "complement", "copies", "from_pair",
    "int_code", "int_to_code", "is_het", "is_hom", "map_lookup", "mask_of_code", "normalise", "onehot", "onehot_to_code", "set_distance",
    "structure_pair", "structure_to_code", "token_to_code", "two_channel", "two_channel_to_code",
]

# The public IUPAC nucleotide codes, by bit mask 1 to 15.
CODES = "ACMGRSVTWYHKDBN"
BASES = "ACGT"
HET_CODES = "MRWSYK"
MISSING = ("N", "-", ".", "?")
# Integer codes of calls.
INT_CODES = {"A": 0, "T": 1, "G": 2, "C": 3, "W": 4, "R": 5, "M": 6, "K": 7, "Y": 8, "S": 9, "N": -9}
# Two-channel allele numbers.
CHANNELS = {"A": 0, "C": 1, "G": 2, "T": 3}
# STRUCTURE allele numbers.
STRUCTURE_ALLELES = {"A": 1, "C": 2, "G": 3, "T": 4}


def map_lookup(key: Column, table: dict) -> Column:
    """``table[key]`` as a literal map; null where there is no such key."""
    return F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def normalise(raw: Column) -> Column:
    """Upper-case call with every missing token as null."""
    up = F.upper(F.trim(raw))
    return F.when(up.isin(*MISSING) | (up == ""), F.lit(None).cast("string")).otherwise(up)


def base_mask(base: Column) -> Column:
    return F.when(base == "A", 1).when(base == "C", 2).when(base == "G", 4).when(base == "T", 8)


def mask_of_code(gt: Column) -> Column:
    """Bit mask of a code; null for missing, ``N`` and what is no code."""
    at = F.instr(F.lit(CODES[:14]), gt)
    return F.when((at > 0) & (F.length(gt) == 1), at)


def code_of_mask(mask: Column) -> Column:
    return F.when(mask.between(1, 14), F.substring(F.lit(CODES), mask, F.lit(1)))


def from_pair(a1: Column, a2: Column) -> Column:
    """Code of two bases; null if either is missing or no base."""
    return code_of_mask(base_mask(a1).bitwiseOR(base_mask(a2)))


def bases_of(gt: Column) -> Column:
    """The code's bases in the order A, C, G, T; empty for a missing call."""
    mask = F.coalesce(mask_of_code(gt), F.lit(0))
    return F.array_compact(F.array(*(F.when(mask.bitwiseAND(1 << k) > 0, F.lit(b)) for k, b in enumerate(BASES))))


def is_hom(gt: Column) -> Column:
    return gt.isin(*BASES)


def is_het(gt: Column) -> Column:
    """Two-base codes only."""
    return gt.isin(*HET_CODES)


def copies(gt: Column, base: str, with_het: bool = True) -> Column:
    """Copies of ``base`` that a call adds to allele counts: 2 if it is homozygous, 1 for each base of any other code."""
    codes = [c for k, c in enumerate(CODES[:14], 1) if k & (1 << BASES.index(base)) and c not in BASES]
    one = F.when(gt.isin(*codes), 1) if with_het else F
    return one.when(gt == base, 2).otherwise(0)


def two_channel(gt: Column) -> tuple[Column, Column]:
    """Allele numbers 0..3 of a call of one or two bases; (-1, -1) otherwise."""
    own = bases_of(gt)
    number = lambda b: map_lookup(b, CHANNELS)
    few = F.size(own).between(1, 2)
    first, last = F.when(few, number(F.element_at(own, 1))), F.when(few, number(F.element_at(own, -1)))
    return F.coalesce(first, F.lit(-1)), F.coalesce(last, F.lit(-1))


def two_channel_to_code(a1: Column, a2: Column) -> Column:
    base = lambda n: F.when(n.between(0, 3), F.substring(F.lit(BASES), n + 1, F.lit(1)))
    return F.coalesce(from_pair(base(a1), base(a2)), F.lit("N"))


def onehot(gt: Column, het_value: float = 1.0) -> Column:
    """Weights of A, C, G, T: 1 for the base of a homozygous call, ``het_value`` for those of another; zeros if missing."""
    mask = F.coalesce(mask_of_code(gt), F.lit(0))
    weight = F.when(is_hom(gt), F.lit(1.0)).otherwise(F.lit(float(het_value)))
    return F.array(*(F.when(mask.bitwiseAND(1 << k) > 0, weight).otherwise(F.lit(0.0)) for k in range(4)))


def onehot_to_code(vector: Column) -> Column:
    mask = reduce(lambda a, b: a + b, (F.when(F.element_at(vector, k + 1) > 0, 1 << k).otherwise(0) for k in range(4)))
    return F.coalesce(code_of_mask(mask), F.lit("N"))


def int_code(gt: Column) -> Column:
    return F.coalesce(map_lookup(gt, INT_CODES), F.lit(-9))


def int_to_code(n: Column) -> Column:
    return F.coalesce(map_lookup(n, {v: k for k, v in INT_CODES.items()}), F.lit("N"))


def complement(text: Column) -> Column:
    """Complement of each code, case kept."""
    return F.translate(text, "ACGTRYKMBVDHacgtrykmbvdh", "TGCAYRMKVBHDtgcayrmkvbhd")


def set_distance(a: Column, b: Column) -> Column:
    """0 if the codes share a base, else 1; a missing call is at distance 1 from all."""
    return F.when(F.coalesce(mask_of_code(a), F.lit(0)).bitwiseAND(F.coalesce(mask_of_code(b), F.lit(0))) > 0, 0).otherwise(1)


def structure_pair(gt: Column) -> Column:
    """``i/j`` with allele numbers 1..4, ``-9/-9`` if missing."""
    own = bases_of(gt)
    number = lambda b: map_lookup(b, STRUCTURE_ALLELES).cast("string")
    return F.when(F.size(own).between(1, 2), F.concat_ws("/", number(F.element_at(own, 1)), number(F.element_at(own, -1)))).otherwise(F.lit("-9/-9"))


def structure_to_code(pair: Column, symmetric: bool = False) -> Column:
    """Inverse of ``structure_pair``. Only ascending pairs are known unless ``symmetric``; all else is ``N``."""
    table = {}
    for a, x in STRUCTURE_ALLELES.items():
        for b, y in STRUCTURE_ALLELES.items():
            if symmetric or x <= y:
                table[f"{x}/{y}"] = CODES[((1 << BASES.index(a)) | (1 << BASES.index(b))) - 1]
    return F.coalesce(map_lookup(pair, table), F.lit("N"))


def token_to_code(token: Column, ref: Column | None = None, alt: Column | None = None) -> Column:
    """A code from a code, ``A/G``, ``A|G`` or, with ``ref`` and ``alt`` (array), VCF indices; null if none fits."""
    parts = F.split(F.upper(token), "[/|]")
    first, second = F.get(parts, 0), F.get(parts, 1)
    if ref is not None:
        alleles = F.concat(F.array(ref), F.coalesce(alt, F.array().cast("array<string>")))
        pick = lambda p: F.when(p.rlike("^[0-9]+$"), F.get(alleles, F.try_to_number(p, F.lit("9999")).cast("int"))).otherwise(p)
        first, second = pick(first), pick(second)
    code = F.upper(token)
    return F.when(F.size(parts) == 2, from_pair(first, second)).when(mask_of_code(code).isNotNull(), code)

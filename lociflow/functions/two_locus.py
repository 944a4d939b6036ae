"""Unbiased two-locus statistics from the nine genotype counts.

Each statistic is a sum of products of linear forms in the genotype frequencies. The unbiased estimate of a product is its
mean over ordered draws of different individuals, one for each factor. That mean follows from sums over draws that may
repeat: draws whose individuals coincide are taken off by the partitions of the factors (Moebius inversion), and each
part of a partition is one dot product of the counts with the product of its forms. All dot products of all statistics
are one matrix product.
"""

from __future__ import annotations

from functools import cache
from math import factorial, prod

import numpy as np

__all__ = ["STATISTICS", "sql_terms", "unbiased"]

# What a genotype of state 3 * left + right adds to the frequency of each haplotype.
_HAPLOTYPES = {
    "AB": (1, 0.5, 0, 0.5, 0.25, 0, 0, 0, 0),
    "Ab": (0, 0.5, 1, 0, 0.25, 0.5, 0, 0, 0),
    "aB": (0, 0, 0, 0.5, 0.25, 0, 1, 0.5, 0),
    "ab": (0, 0, 0, 0, 0.25, 0.5, 0, 0.5, 1),
}
_H = {k: np.array(v) for k, v in _HAPLOTYPES.items()}
_FORMS = _H | {"A": _H["AB"] + _H["Ab"], "a": _H["aB"] + _H["ab"], "B": _H["AB"] + _H["aB"], "b": _H["Ab"] + _H["ab"]}
_FORMS |= {"a-A": _FORMS["a"] - _FORMS["A"], "b-B": _FORMS["b"] - _FORMS["B"]}
#: Each statistic as (coefficient, factors): D, its square, D with both allele differences, and the product of both loci's variances.
_PRODUCTS = {
    "d": ((2, ("AB", "ab")), (-2, ("Ab", "aB"))),
    "d2": ((4, ("AB", "ab", "AB", "ab")), (-8, ("AB", "ab", "Ab", "aB")), (4, ("Ab", "aB", "Ab", "aB"))),
    "dz": ((2, ("AB", "ab", "a-A", "b-B")), (-2, ("Ab", "aB", "a-A", "b-B"))),
    "pi2": ((1, ("A", "a", "B", "b")),),
}
#: Individuals that a statistic draws.
STATISTICS = {name: len(products[0][1]) for name, products in _PRODUCTS.items()}


def _partitions(items: tuple) -> list[list[tuple]]:
    if not items:
        return [[]]
    first, out = items[0], []
    for parts in _partitions(items[1:]):
        out.append([(first,), *parts])
        out += [[*parts[:k], (first, *parts[k]), *parts[k + 1 :]] for k in range(len(parts))]
    return out


@cache
def _plan(names: tuple[str, ...]) -> tuple[np.ndarray, dict[str, list[tuple[float, tuple[int, ...]]]]]:
    """The vectors to multiply the counts with, and each statistic as (coefficient, vectors whose products are multiplied)."""
    vectors: dict[tuple[str, ...], int] = {}
    plan: dict[str, dict[tuple[int, ...], float]] = {}
    for name in names:
        sums = plan[name] = {}
        for coefficient, factors in _PRODUCTS[name]:
            for parts in _partitions(factors):
                if not all(np.prod([_FORMS[f] for f in p], axis=0).any() for p in parts):
                    continue  # no genotype has all of a part's forms
                weight = coefficient * prod((-1) ** (len(p) - 1) * factorial(len(p) - 1) for p in parts)
                key = tuple(sorted(vectors.setdefault(tuple(sorted(p)), len(vectors)) for p in parts))
                sums[key] = sums.get(key, 0) + weight
    matrix = np.stack([np.prod([_FORMS[f] for f in v], axis=0) for v in vectors], axis=1)
    return matrix, {name: [(w, k) for k, w in sums.items() if w] for name, sums in plan.items()}


def unbiased(counts: np.ndarray, *names: str) -> np.ndarray:
    """The statistics of each row of ``counts`` (rows, 9), one column each; NaN with fewer individuals than a statistic draws."""
    unknown = set(names) - set(_PRODUCTS)
    if unknown:
        raise ValueError(f"unknown statistics: {sorted(unknown)}")
    counts = np.asarray(counts, float).reshape(-1, 9)
    matrix, plan = _plan(names)
    sums = np.ascontiguousarray((counts @ matrix).T)
    n = counts.sum(1)
    out = np.empty((len(counts), len(names)))
    for column, name in enumerate(names):
        total = np.zeros(len(counts))
        for weight, parts in plan[name]:
            term = weight * sums[parts[0]]
            for k in parts[1:]:
                term *= sums[k]
            total += term
        draws = np.ones(len(counts))
        for k in range(STATISTICS[name]):
            draws *= n - k
        with np.errstate(all="ignore"):
            out[:, column] = np.where(n >= STATISTICS[name], total / draws, np.nan)
    return out


def sql_terms(state: str = "n{k}", total: str = "n", sums: str = "v{k}") -> tuple[list[str], dict[str, str]]:
    """The same as SQL text: the dot products of the counts, and each statistic from them (null with too few individuals)."""
    matrix, plan = _plan(tuple(STATISTICS))
    dots = ["(" + " + ".join(f"{float(x)} * {state.format(k=k)}" for k, x in enumerate(v) if x) + ")::DOUBLE" for v in matrix.T]
    out = {}
    for name, terms in plan.items():
        top = " + ".join(f"({float(w)}) * " + " * ".join(sums.format(k=k) for k in parts) for w, parts in terms)
        bottom = " * ".join(f"({total} - {k})" for k in range(STATISTICS[name]))
        out[name] = f"CASE WHEN {total} >= {STATISTICS[name]} THEN ({top}) / ({bottom})::DOUBLE END"
    return dots, out

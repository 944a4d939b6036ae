"""Differentiation between populations: variance components and Fst, Nei's distance, AMOVA."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.iupac import BASES, copies, is_het, mask_of_code
from ..genotypes import GenotypeFrame, portable_hash
from ..shared import write_shared
from .packed import packed, unpacked
from .resampling import _STEP, dense_index, locus_weights, percentile_interval, permuted_labels

__all__ = [
    "amova", "amova_bootstrap", "fst_bootstrap", "fst_components", "fst_observed", "fst_permutation", "fst_permuted_per_locus", "nei_bootstrap", "nei_components", "nei_observed", "nei_permutation", "per_locus_fst",
    "population_alleles", "symmetric_table", "triangle_intervals",
]


def population_alleles(cells: DataFrame, *keys: str) -> DataFrame:
    """Per (keys.., locus): diploids with a call of one or two bases, copies and heterozygous carriers of each base."""
    gt = F.col("gt")
    used = cells.filter(gt.isin(*BASES) | is_het(gt))
    carriers = {b: is_het(gt) & (mask_of_code(gt).bitwiseAND(1 << k) > 0) for k, b in enumerate(BASES)}
    return used.groupBy(*keys, "locus_idx").agg(F.count("*").alias("n"), *(F.sum(copies(gt, b)).alias(f"c{b}") for b in BASES), *(F.sum(c.cast("int")).alias(f"h{b}") for b, c in carriers.items()))


def _pairs(table: DataFrame, populations: DataFrame, *keys: str) -> DataFrame:
    """Rows of two populations side by side for each pair in order and each locus; a missing side has no calls."""
    pops = populations.select("population").distinct()
    both = pops.select(F.col("population").alias("pop1")).join(pops.select(F.col("population").alias("pop2")), F.col("pop1") < F.col("pop2"))
    values = [c for c in table.columns if c not in (*keys, "population", "locus_idx")]
    loci = table.select(*keys, "locus_idx").distinct()
    side = lambda k: table.select(*keys, "locus_idx", F.col("population").alias(f"pop{k}"), *[F.col(c).alias(f"{c}{k}") for c in values])
    grid = loci.crossJoin(F.broadcast(both))  # pairs of populations, not of rows
    joined = grid.join(side(1), [*keys, "locus_idx", "pop1"], "left").join(side(2), [*keys, "locus_idx", "pop2"], "left")
    return joined.fillna(0, [f"{c}{k}" for c in values for k in (1, 2)])


def _components(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys.., a, b, c): Weir and Cockerham's components summed over alleles; 0 with one allele, null where not estimable.

    Each row becomes one of each base, so that the formulas stand in the plan once; rows of one key stay in their task.
    """
    counts = [F.struct(*(F.col(f"{x}{base}{k}").cast("double").alias(f"{x}{k}") for x in "ch" for k in (1, 2))) for base in BASES]
    sides = [F.col(f"n{k}").cast("double").alias(f"n{k}") for k in (1, 2)]
    c1, c2, h1, h2, n1, n2 = map(F.col, ("c1", "c2", "h1", "h2", "n1", "n2"))
    total = n1 + n2
    p1, p2 = c1 / (2 * n1), c2 / (2 * n2)
    m1, m2 = (c1 - h1) / 2, (c2 - h2) / 2
    mean = (n1 * p1 + n2 * p2) / total
    msg = (n1 * p1 - m1 + n2 * p2 - m2) / total
    msi = (n1 * (p1 - 2 * p1 * p1) + m1 + n2 * (p2 - 2 * p2 * p2) + m2) / (total - 2)
    msp = 2 * (n1 * (p1 - mean) * (p1 - mean) + n2 * (p2 - mean) * (p2 - mean))
    nc = total - (n1 * n1 + n2 * n2) / total
    fine = (n1 > 0) & (n2 > 0)
    usable = fine & (total > 2) & F.when(fine, nc > 0).otherwise(False)
    seen = c1 + c2 > 0
    parts = {"a": (msp - msi) / (2 * nc), "b": (msi - msg) / 2, "c": msg}
    alleles = rows.select(*keys, *sides, F.inline(F.array(*counts)))
    sums = alleles.groupBy(*keys, "n1", "n2").agg(F.count_if(seen).alias("present"), *(F.sum(F.when(usable, F.when(seen, v).otherwise(0.0))).alias(k) for k, v in parts.items()))
    return sums.select(*keys, *[F.when(usable, F.when(F.col("present") < 2, 0.0).otherwise(F.col(k))).alias(k) for k in parts])


def fst_components(frame: GenotypeFrame) -> DataFrame:
    """(pop1, pop2, locus_idx, a, b, c)"""
    table = population_alleles(frame.with_population(), "population")
    return _components(_pairs(table, frame.samples), "pop1", "pop2", "locus_idx")


def _ratio(a: str = "a", total: str = "t") -> Column:
    return F.when(F.col(total).isNull(), None).when(F.col(total) == 0, 0.0).otherwise(F.col(a) / F.col(total))


def fst_observed(frame: GenotypeFrame) -> DataFrame:
    """Ratio of sums over loci."""
    sums = fst_components(frame).groupBy("pop1", "pop2").agg(F.sum("a").alias("a"), F.sum(F.col("a") + F.col("b") + F.col("c")).alias("t"))
    return sums.select("pop1", "pop2", _ratio().alias("fst"))


def per_locus_fst(frame: GenotypeFrame, compat: bool = False) -> DataFrame:
    """a / (a + b + c) by pair and locus; ``compat`` gives a / b."""
    bottom = F.col("b") if compat else F.col("a") + F.col("b") + F.col("c")
    return fst_components(frame).select("pop1", "pop2", "locus_idx", F.when(bottom != 0, F.col("a") / bottom).alias("fst"))


def _weighted(components: DataFrame, loci: DataFrame, n_reps: int, seed: int, values: list[str], keys: list[str]) -> DataFrame:
    slots = dense_index(loci.select("locus_idx"), "locus_idx")
    weights = locus_weights(loci.sparkSession, slots.count(), n_reps, seed)
    joined = components.join(slots, "locus_idx").join(weights, "slot")
    return joined.groupBy(*keys, "rep").agg(*(F.sum(F.col(v) * F.col("w")).alias(v) for v in values))


def fst_bootstrap(frame: GenotypeFrame, n_reps: int = 100, seed: int = 0) -> DataFrame:
    """95 percent interval over replicates that draw loci; the components are made once."""
    c = fst_components(frame).withColumn("t", F.col("a") + F.col("b") + F.col("c"))
    reps = _weighted(c, frame.loci, n_reps, seed, ["a", "t"], ["pop1", "pop2"])
    return percentile_interval(reps.withColumn("fst", _ratio()), "fst", "pop1", "pop2")


def _pair_samples(frame: GenotypeFrame) -> DataFrame:
    s = frame.samples.select("sample_idx", "population")
    pops = s.select("population").distinct()
    both = pops.select(F.col("population").alias("pop1")).join(pops.select(F.col("population").alias("pop2")), F.col("pop1") < F.col("pop2"))
    return both.join(s, (F.col("population") == F.col("pop1")) | (F.col("population") == F.col("pop2")))


#: Samples, loci and labelled rows (a pair in a replicate) of which a task multiplies one block at a time.
BLOCK_SAMPLES, BLOCK_LOCI, BLOCK_ROWS = 8_192, 256, 256
#: Blocks that are tasks of their own; beyond, tasks get several.
MOST_BLOCKS = 1 << 16
_COUNTED = ["n", *(f"{x}{b}" for x in "ch" for b in BASES)]


def _by_block(rows: DataFrame, blocks: int, make: Callable, schema: str, name: str) -> DataFrame:
    """A table of what ``make`` gives of the rows ``(block, ..)`` of each of so many blocks. A block is dealt to a task of
    its own and gathered there in arrays: no task sorts rows, or has those of several blocks because they are few."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            at, *values = (np.asarray(c) for c in batch.columns)
            for k in np.unique(at).tolist():
                held.setdefault(k, []).append([v[at == k] for v in values])
        for k in sorted(held):
            yield make(k, *map(np.concatenate, zip(*held.pop(k), strict=True)))

    return write_shared(rows.repartitionById(min(max(1, blocks), MOST_BLOCKS), "block").mapInArrow(run, schema), name)


def _side_counts(masks: np.ndarray, sides: np.ndarray) -> list[np.ndarray]:
    """For both sides: calls, copies and heterozygous carriers by base (rows of ``sides``, loci) of calls as sets of bases, (samples, loci), -1: none."""
    homozygous = [(masks == 1 << k).astype(np.float32) for k in range(4)]
    pairs = np.isin(masks, [m for m in range(16) if m.bit_count() == 2])
    carriers = [(pairs & (masks >> k & 1 > 0)).astype(np.float32) for k in range(4)]
    out = []
    for side in (1, 2):
        own = (sides == side).astype(np.float32)
        het = [own @ h for h in carriers]
        copies = [2 * (own @ x) + h for x, h in zip(homozygous, het, strict=True)]
        out.append([sum(copies) / 2, *copies, *het])
    return out


def _label_blocks(slots: DataFrame, pairs: DataFrame, chunks: int, parts: int, n_reps: int, seed: int, observed: bool) -> DataFrame:
    """(chunk, rows, sides): matrices of sides, 0 for neither, of a chunk of samples in some rows. Labels are dealt as by
    ``permuted_labels``: of a pair, whose labels in id order are the first population's, then the second's, the first samples
    in hash order get the first's."""
    members = slots.join(F.broadcast(pairs), (F.col("population") == F.col("pop1")) | (F.col("population") == F.col("pop2")))
    n = n_reps + observed
    reps = slots.sparkSession.range(n_reps).select(F.col("id").cast("int").alias("rep"))
    by_hash = Window.partitionBy("pair", "rep").orderBy(portable_hash(F.col("rep") * _STEP + F.col("sample_idx"), seed), "sample_idx")
    dealt = members.select("pair", "slot", "sample_idx", "n1").crossJoin(F.broadcast(reps)).withColumn("side", F.when(F.row_number().over(by_hash) <= F.col("n1"), 1).otherwise(2))
    labels = dealt.select((F.col("pair") * n + F.col("rep") + int(observed)).alias("row"), "slot", "side")
    if observed:
        labels = labels.unionByName(members.select((F.col("pair") * n).alias("row"), "slot", F.when(F.col("population") == F.col("pop1"), 1).otherwise(2).alias("side")))

    def block(k: int, row: np.ndarray, place: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        own, at = np.unique(row, return_inverse=True)
        sides = np.zeros((len(own), BLOCK_SAMPLES), np.int8)
        sides[at, place] = side
        return pa.RecordBatch.from_arrays([pa.array([k // parts]), pa.array([own.astype("<i8").tobytes()]), pa.array([sides.tobytes()])], names=["chunk", "rows", "sides"])

    at = (F.floor(F.col("slot") / BLOCK_SAMPLES) * parts + F.floor(F.col("row") / BLOCK_ROWS)).cast("int").alias("block")
    dealt = labels.select(at, "row", (F.col("slot") % BLOCK_SAMPLES).cast("int").alias("place"), F.col("side").cast("tinyint").alias("side"))
    return _by_block(dealt, chunks * parts, block, "chunk long, rows binary, sides binary", "labels")


def _permuted(frame: GenotypeFrame, n_reps: int, seed: int, observed: bool = False) -> DataFrame:
    """Allele counts of the two sides of each pair in each replicate, side by side, by locus; ``observed`` adds the labels as they are, as replicate -1.

    Counts are matrix products of blocks of labels with blocks of calls, summed over chunks of samples: no call is copied
    for a replicate, and no task or driver holds all samples.
    """
    spark = frame.spark
    sizes = {r["population"]: r["count"] for r in frame.samples.filter("population is not null").groupBy("population").count().collect()}  # a row a population
    rows = [(k, one, two, sizes[one]) for k, (one, two) in enumerate(combinations(sorted(sizes), 2))]
    pairs = spark.createDataFrame(rows, "pair long, pop1 string, pop2 string, n1 long")
    slots = dense_index(frame.samples.filter("population is not null").select("sample_idx", "population"), "sample_idx")
    n = n_reps + observed
    chunks = -(-sum(sizes.values()) // BLOCK_SAMPLES)
    labels = _label_blocks(slots, pairs, chunks, -(-len(rows) * n // BLOCK_ROWS), n_reps, seed, observed)
    parts = max(1, -(-frame.loci.count() // BLOCK_LOCI))
    kept = frame.calls.join(frame.loci.select("locus_idx"), "locus_idx", "left_semi").join(slots.select("sample_idx", "slot"), "sample_idx")
    at = (F.floor(F.col("slot") / BLOCK_SAMPLES) * parts + F.pmod(F.xxhash64("locus_idx"), F.lit(parts))).cast("int").alias("block")
    cells = kept.select(at, F.col("locus_idx").cast("long").alias("locus_idx"), (F.col("slot") % BLOCK_SAMPLES).cast("int").alias("place"), mask_of_code(F.col("gt")).cast("tinyint").alias("mask"))

    def pack(k: int, locus: np.ndarray, place: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
        loci, at = np.unique(locus, return_inverse=True)
        masks = np.full((BLOCK_SAMPLES, len(loci)), -1, np.int8)
        masks[place, at] = mask
        return pa.RecordBatch.from_arrays([pa.array([k // parts]), pa.array([loci.astype("<i8").tobytes()]), pa.array([masks.tobytes()])], names=["chunk", "loci", "masks"])

    calls = _by_block(cells.filter("mask is not null"), chunks * parts, pack, "chunk long, loci binary, masks binary", "codes")
    names = [f"{v}{k}" for k in (1, 2) for v in _COUNTED]

    def count(batches):
        for batch in batches:
            for own, sides, loci, masks in zip(*(batch.column(c) for c in ("rows", "sides", "loci", "masks")), strict=True):
                own, loci = np.frombuffer(own.as_py(), "<i8"), np.frombuffer(loci.as_py(), "<i8")
                made = _side_counts(np.frombuffer(masks.as_py(), np.int8).reshape(BLOCK_SAMPLES, -1), np.frombuffer(sides.as_py(), np.int8).reshape(-1, BLOCK_SAMPLES))
                there = (made[0][0] + made[1][0] > 0).ravel()
                columns = [np.repeat(own, len(loci))[there], np.tile(loci, len(own))[there], *(v.ravel()[there].astype(np.int64) for side in made for v in side)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "locus_idx", *names])

    counted = labels.join(calls, "chunk").mapInArrow(count, ", ".join(f"{c} long" for c in ("row", "locus_idx", *names)))
    sums = counted.groupBy("row", "locus_idx").agg(*(F.sum(c).alias(c) for c in names))
    named = sums.withColumn("pair", F.floor(F.col("row") / n).cast("long")).withColumn("rep", (F.col("row") % n - int(observed)).cast("int")).join(F.broadcast(pairs.drop("n1")), "pair")  # a row a pair
    return named.select("pop1", "pop2", "rep", "locus_idx", *names)


#: Labels of samples in pairs and replicates up to which they are a broadcast matrix; more stay in blocks of a table.
MAX_LABELS = 500_000


class _Labels:
    """Sides (0: neither) of the samples in each replicate of each pair, the labels as they are first."""

    def __init__(self, frame: GenotypeFrame, n_reps: int, seed: int):
        samples = _pair_samples(frame)
        labels = permuted_labels(samples, n_reps, seed, "pop1", "pop2").unionByName(samples.withColumn("rep", F.lit(-1)))
        side = F.when(F.col("population") == F.col("pop1"), 1).otherwise(2).cast("tinyint")
        rows = labels.select("pop1", "pop2", "rep", "sample_idx", side.alias("side")).toArrow()  # MAX_LABELS at most
        names = list(zip(rows.column("pop1").to_pylist(), rows.column("pop2").to_pylist(), strict=True))
        self.pairs, self.reps = sorted(set(names)), n_reps + 1
        self.samples = np.unique(np.asarray(rows.column("sample_idx")))
        number = {p: k for k, p in enumerate(self.pairs)}
        self.sides = np.zeros((len(self.pairs) * self.reps, len(self.samples)), np.int8)
        row = np.array([number[p] for p in names], np.int64) * self.reps + np.asarray(rows.column("rep")) + 1
        self.sides[row, np.searchsorted(self.samples, np.asarray(rows.column("sample_idx")))] = np.asarray(rows.column("side"))

    def components(self, masks: np.ndarray) -> np.ndarray:
        """(a, b, c) by pair, replicate and locus for calls as sets of bases (-1: none); NaN where not estimable."""
        counts = [([x.astype(float) for x in own[1:5]], [x.astype(float) for x in own[5:]]) for own in _side_counts(masks.T, self.sides)]
        n1, n2 = (sum(c) / 2 for c, _ in counts)
        total, out, present = n1 + n2, np.zeros((3, *n1.shape)), np.zeros(n1.shape)
        with np.errstate(all="ignore"):
            nc = total - (n1 * n1 + n2 * n2) / total
            for c1, h1, c2, h2 in zip(*counts[0], *counts[1], strict=True):
                p1, p2, m1, m2 = c1 / (2 * n1), c2 / (2 * n2), (c1 - h1) / 2, (c2 - h2) / 2
                mean = (n1 * p1 + n2 * p2) / total
                msg = (n1 * p1 - m1 + n2 * p2 - m2) / total
                msi = (n1 * (p1 - 2 * p1 * p1) + m1 + n2 * (p2 - 2 * p2 * p2) + m2) / (total - 2)
                msp = 2 * (n1 * (p1 - mean) * (p1 - mean) + n2 * (p2 - mean) * (p2 - mean))
                seen = c1 + c2 > 0
                present += seen
                out += np.where(seen, np.stack([(msp - msi) / (2 * nc), (msi - msg) / 2, msg]), 0.0)
            usable = (n1 > 0) & (n2 > 0) & (total > 2) & (nc > 0)
        out[:, present < 2] = 0.0
        out[:, ~usable] = np.nan
        return out.reshape(3, len(self.pairs), self.reps, -1)


def _packed_labels(frame: GenotypeFrame, n_reps: int, seed: int) -> tuple[_Labels, DataFrame] | None:
    """Labels and packed calls, or nothing if there are too many labels for a broadcast."""
    if _pair_samples(frame).count() * (n_reps + 1) > MAX_LABELS:
        return None
    labels = _Labels(frame, n_reps, seed)
    kept = frame.calls.join(frame.loci.select("locus_idx"), "locus_idx", "left_semi").join(_pair_samples(frame).select("sample_idx").distinct(), "sample_idx", "left_semi")
    cells = kept.select("locus_idx", "sample_idx", mask_of_code(F.col("gt")).alias("value")).filter("value is not null")
    return labels, packed(cells, labels.samples.tolist(), frame.loci.count(), "codes")


def fst_permutation(frame: GenotypeFrame, n_reps: int = 99, seed: int = 0) -> DataFrame:
    """(pop1, pop2, fst, p): share of relabelled replicates at or above the observed value, both counts plus one.

    Counts of all replicates are matrix products of the labels with packed calls; with more than ``MAX_LABELS`` labels,
    of blocks of both.
    """
    found = _packed_labels(frame, n_reps, seed)
    if found is None:
        parts = _components(_permuted(frame, n_reps, seed, observed=True), "pop1", "pop2", "rep", "locus_idx")
        sums = parts.groupBy("pop1", "pop2", "rep").agg(F.sum("a").alias("a"), F.sum(F.col("a") + F.col("b") + F.col("c")).alias("t"))
    else:
        labels, rows = found
        shared = frame.spark.sparkContext.broadcast(labels)

        def add(batches):
            labels, total = shared.value, None
            for batch in batches:
                for _, masks in unpacked(batch, len(labels.samples)):
                    a, b, c = labels.components(masks)
                    made = np.stack([np.nansum(a, -1), np.nansum(a + b + c, -1), np.isfinite(a).sum(-1)])
                    total = made if total is None else total + made
            for k, (one, two) in enumerate(labels.pairs if total is not None else []):
                n = labels.reps
                columns = [[one] * n, [two] * n, pa.array(np.arange(-1, n - 1), pa.int32()), total[0, k], total[1, k], pa.array(total[2, k].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["pop1", "pop2", "rep", "a", "t", "n"])

        sums = rows.mapInArrow(add, "pop1 string, pop2 string, rep int, a double, t double, n long").groupBy("pop1", "pop2", "rep").agg(*(F.sum(c).alias(c) for c in ("a", "t", "n")))
        sums = sums.select("pop1", "pop2", "rep", "a", F.when(F.col("n") > 0, F.col("t")).alias("t"))
    values = sums.select("pop1", "pop2", "rep", _ratio().alias("f"))
    # A row a pair: its own value and those of its replicates.
    both = values.groupBy("pop1", "pop2").agg(F.max(F.when(F.col("rep") < 0, F.col("f"))).alias("fst"), F.collect_list(F.when(F.col("rep") >= 0, F.col("f"))).alias("reps"))
    return both.select("pop1", "pop2", "fst", ((F.size(F.filter("reps", lambda f: f >= F.col("fst") - 1e-12)) + 1) / (F.size("reps") + 1)).alias("p"))


_PERMUTED = "pop1 string, pop2 string, locus_idx long, fst double, n int, up int, down int, sd double"


def fst_permuted_per_locus(frame: GenotypeFrame, n_reps: int, seed: int = 0) -> DataFrame:
    """(pop1, pop2, locus_idx, fst, n, up, down, sd): observed Fst of a locus, and of its replicates with one: how many,
    how many at or above and at or below the observed value, and their standard deviation. Made as in ``fst_permutation``."""
    found = _packed_labels(frame, n_reps, seed)
    if found is not None:
        labels, rows = found
        shared = frame.spark.sparkContext.broadcast(labels)

        def judge(batches):
            labels = shared.value
            for batch in batches:
                for loci, masks in unpacked(batch, len(labels.samples)):
                    a, b, c = labels.components(masks)
                    with np.errstate(all="ignore"):
                        r = np.where(a + b + c != 0, a / (a + b + c), np.nan)
                    for (one, two), values in zip(labels.pairs, r, strict=True):
                        own = np.flatnonzero(np.isfinite(values[0]))
                        fst, reps = values[0, own], values[1:, own]
                        there = np.isfinite(reps)
                        n = there.sum(0)
                        mean = np.where(there, reps, 0.0).sum(0) / np.maximum(n, 1)
                        sd = np.sqrt((np.where(there, reps - mean, 0.0) ** 2).sum(0) / np.maximum(n, 1))
                        up, down = (np.where(there, reps, -np.inf) >= fst - 1e-12).sum(0), (np.where(there, reps, np.inf) <= fst + 1e-12).sum(0)
                        whole = [pa.array(x.astype(np.int32)) for x in (n, up, down)]
                        columns = [pa.array([one] * len(own), pa.string()), pa.array([two] * len(own), pa.string()), pa.array(loci[own]), pa.array(fst), *whole, pa.array(np.where(sd < 1e-15, 0.0, sd))]
                        yield pa.RecordBatch.from_arrays(columns, names=["pop1", "pop2", "locus_idx", "fst", "n", "up", "down", "sd"])

        return rows.mapInArrow(judge, _PERMUTED)
    bottom = F.col("a") + F.col("b") + F.col("c")
    parts = _components(_permuted(frame, n_reps, seed, observed=True), "pop1", "pop2", "rep", "locus_idx")
    own, other = (F.when(F.col("rep") < 0, F.col("r")), F.when(F.col("rep") >= 0, F.col("r")))
    values = parts.select("pop1", "pop2", "rep", "locus_idx", F.when(bottom != 0, F.col("a") / bottom).alias("r")).filter("r is not null")
    both = values.groupBy("pop1", "pop2", "locus_idx").agg(F.max(own).alias("fst"), F.collect_list(other).alias("reps"), F.stddev_pop(other).alias("sd")).filter("fst is not null")
    count = lambda f: F.size(F.filter("reps", f))
    both = both.withColumn("sd", F.when(F.col("sd") < 1e-15, 0.0).otherwise(F.col("sd")))  # as above
    return both.select("pop1", "pop2", "locus_idx", "fst", F.size("reps").alias("n"), count(lambda r: r >= F.col("fst") - 1e-12).alias("up"), count(lambda r: r <= F.col("fst") + 1e-12).alias("down"), "sd")


def nei_components(frame: GenotypeFrame) -> DataFrame:
    """(pop1, pop2, locus_idx, jxy, jx, jy) of loci with calls in both."""
    return _nei(_pairs(population_alleles(frame.with_population(), "population"), frame.samples)).select("pop1", "pop2", "locus_idx", "jxy", "jx", "jy")


def _nei(rows: DataFrame) -> DataFrame:
    p = {(b, k): F.col(f"c{b}{k}") / (2.0 * F.col(f"n{k}")) for b in BASES for k in (1, 2)}
    total = lambda i, j: reduce(lambda x, y: x + y, (p[b, i] * p[b, j] for b in BASES))
    return rows.filter("n1 > 0 and n2 > 0").select("*", total(1, 2).alias("jxy"), total(1, 1).alias("jx"), total(2, 2).alias("jy"))


def _identity() -> Column:
    identity = F.least(F.col("jxy") / F.sqrt(F.col("jx") * F.col("jy")), F.lit(1.0))
    return F.when(identity > 0, -F.log(identity)).when(identity.isNotNull(), float("inf"))


def nei_observed(frame: GenotypeFrame) -> DataFrame:
    """Nei's 1972 distance from sums over loci; infinite where nothing is shared."""
    sums = nei_components(frame).groupBy("pop1", "pop2").agg(*(F.sum(c).alias(c) for c in ("jxy", "jx", "jy")))
    return sums.select("pop1", "pop2", _identity().alias("nei"))


def nei_bootstrap(frame: GenotypeFrame, n_reps: int = 100, seed: int = 0) -> DataFrame:
    reps = _weighted(nei_components(frame), frame.loci, n_reps, seed, ["jxy", "jx", "jy"], ["pop1", "pop2"])
    return percentile_interval(reps.withColumn("nei", _identity()), "nei", "pop1", "pop2")


def nei_permutation(frame: GenotypeFrame, n_reps: int = 99, seed: int = 0) -> DataFrame:
    sums = _nei(_permuted(frame, n_reps, seed)).groupBy("pop1", "pop2", "rep").agg(*(F.sum(c).alias(c) for c in ("jxy", "jx", "jy")))
    joined = nei_observed(frame).join(sums.select("pop1", "pop2", _identity().alias("rep_nei")), ["pop1", "pop2"])
    p = (F.count_if(F.col("rep_nei") >= F.col("nei") - 1e-12) + 1) / (F.count("rep_nei") + 1)
    return joined.groupBy("pop1", "pop2", "nei").agg(p.alias("p"))


def symmetric_table(pairs: DataFrame, value: str, diagonal: float = 0.0) -> DataFrame:
    """Long symmetric table (pop1, pop2, value) with a diagonal."""
    mirrored = pairs.select(F.col("pop2").alias("pop1"), F.col("pop1").alias("pop2"), value)
    pops = pairs.select(F.explode(F.array("pop1", "pop2")).alias("p")).distinct()
    return pairs.select("pop1", "pop2", value).unionByName(mirrored).unionByName(pops.select(F.col("p").alias("pop1"), F.col("p").alias("pop2"), F.lit(float(diagonal)).alias(value)))


def triangle_intervals(intervals: DataFrame, diagonal: float | None = None) -> DataFrame:
    """Upper bounds above the diagonal, lower bounds below."""
    above = intervals.select("pop1", "pop2", F.col("upper").alias("value"))
    below = intervals.select(F.col("pop2").alias("pop1"), F.col("pop1").alias("pop2"), F.col("lower").alias("value"))
    pops = intervals.select(F.explode(F.array("pop1", "pop2")).alias("p")).distinct()
    return above.unionByName(below).unionByName(pops.select(F.col("p").alias("pop1"), F.col("p").alias("pop2"), F.lit(diagonal).cast("double").alias("value")))


# -- AMOVA ---------------------------------------------------------------------------------------------------------------


def _different_pairs() -> Column:
    """Pairs of calls of a group that share no base, from counts of codes: at most 14 of them, whatever the group's size."""
    codes = F.col("codes")
    inner = lambda x: F.aggregate(codes, F.lit(0).cast("long"), lambda acc, y: acc + F.when((y["m"] > x["m"]) & (x["m"].bitwiseAND(y["m"]) == 0), x["n"] * y["n"]).otherwise(0))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda acc, x: acc + inner(x))


def _groups(cells: DataFrame, *keys: str) -> DataFrame:
    by_code = cells.groupBy("locus_idx", *keys, F.col("m")).agg(F.count("*").alias("n"))
    lists = by_code.groupBy("locus_idx", *keys).agg(F.sum("n").alias("size"), F.collect_list(F.struct("m", "n")).alias("codes"))
    s = 2.0 * _different_pairs()
    return lists.select("locus_idx", *keys, "size", s.alias("s2"), F.when(F.col("size") > 1, s / (F.col("size") * (F.col("size") - 1))).otherwise(0.0).alias("mean"))


def amova_per_locus(frame: GenotypeFrame, regions: DataFrame) -> DataFrame:
    """Sums of squares and degrees of freedom by locus; ``regions(population, region)``. Loci without calls are skipped."""
    cells = frame.with_population().withColumn("m", mask_of_code(F.col("gt"))).filter("m is not null").join(F.broadcast(regions), "population")
    total = _groups(cells).select("locus_idx", F.col("size").alias("n"), F.col("mean").alias("m"))
    region = _groups(cells, "region")
    pop = _groups(cells, "region", "population")
    by_region = region.join(total, "locus_idx").groupBy("locus_idx").agg(F.count("*").alias("r"), F.sum(F.col("size") * F.pow(F.col("mean") - F.col("m"), 2)).alias("ssr"), F.sum(F.col("size") * F.col("size")).alias("r2"))
    nested = pop.join(region.select("locus_idx", "region", F.col("mean").alias("mr")), ["locus_idx", "region"])
    by_pop = nested.groupBy("locus_idx").agg(
        F.count("*").alias("p"),
        F.sum(F.col("size") * F.pow(F.col("mean") - F.col("mr"), 2)).alias("ssp"),
        F.sum(F.col("s2") - F.col("s2") * F.col("s2") / (F.col("size") * F.col("size"))).alias("ssw"),
        F.sum(F.col("size") * F.col("size")).alias("p2"),
    )
    joined = total.join(by_region, "locus_idx").join(by_pop, "locus_idx")
    return joined.select("locus_idx", "ssr", "ssp", "ssw", (F.col("r") - 1).alias("dfr"), (F.col("p") - F.col("r")).alias("dfp"), (F.col("n") - F.col("p")).alias("dfw"))


def _phi(sums: DataFrame, sizes: dict, *keys: str) -> DataFrame:
    ms = {k: F.when(F.col(f"df{k}") > 0, F.col(f"ss{k}") / F.col(f"df{k}")) for k in "rpw"}
    s = {
        "r": F.greatest((ms["r"] - ms["p"]) / sizes["r"], F.lit(0.0)),
        "p": F.greatest((ms["p"] - ms["w"]) / sizes["p"], F.lit(0.0)),
        "w": F.greatest(ms["w"], F.lit(0.0)),
    }
    total = s["r"] + s["p"] + s["w"]
    ratio = lambda a, b: F.when(b > 0, a / b)
    return sums.select(*keys, "ssr", "ssp", "ssw", "dfr", "dfp", "dfw", s["r"].alias("sigma_r"), s["p"].alias("sigma_p"), s["w"].alias("sigma_w"), ratio(s["r"], total).alias("phi_rt"), ratio(s["p"], s["p"] + s["w"]).alias("phi_pr"), ratio(s["r"] + s["p"], total).alias("phi_pt"))


def _weights(frame: GenotypeFrame, regions: DataFrame) -> dict:
    sizes = frame.samples.join(F.broadcast(regions), "population").groupBy("region", "population").count().collect()  # a row a population
    n = sum(r["count"] for r in sizes)
    by_region: dict = {}
    for r in sizes:
        by_region[r["region"]] = by_region.get(r["region"], 0) + r["count"]
    few = len(by_region) < 2 or len(sizes) <= len(by_region)
    weight = lambda squares, df: max((n - squares / n) / df, 1e-9)
    return {"r": None, "p": None} if few else {"r": weight(sum(v * v for v in by_region.values()), len(by_region) - 1), "p": weight(sum(r["count"] ** 2 for r in sizes), len(sizes) - len(by_region))}


_SS = ["ssr", "ssp", "ssw", "dfr", "dfp", "dfw"]


def amova(frame: GenotypeFrame, regions: DataFrame) -> DataFrame:
    """One row: sums of squares, degrees of freedom, variance components and Phi; null without two regions and more populations."""
    sizes = {k: F.lit(v).cast("double") for k, v in _weights(frame, regions).items()}
    return _phi(amova_per_locus(frame, regions).agg(*(F.sum(c).alias(c) for c in _SS)), sizes)


def amova_bootstrap(frame: GenotypeFrame, regions: DataFrame, n_reps: int = 100, seed: int = 0) -> DataFrame:
    """Phi statistics with the share of locus bootstraps at or above them, kept within [0.0001, 0.9999]."""
    sizes = {k: F.lit(v).cast("double") for k, v in _weights(frame, regions).items()}
    reps = _phi(_weighted(amova_per_locus(frame, regions), frame.loci, n_reps, seed, _SS, []), sizes, "rep")
    names = ["phi_rt", "phi_pr", "phi_pt"]
    observed = amova(frame, regions).select(*names)
    joined = reps.select(*[F.col(c).alias(f"b_{c}") for c in names]).crossJoin(F.broadcast(observed))  # one row
    p = lambda c: F.greatest(F.lit(0.0001), F.least(F.lit(0.9999), (F.count_if(F.col(f"b_{c}") >= F.col(c)) + 1) / (F.count(f"b_{c}") + 1)))
    return joined.groupBy(*names).agg(*(p(c).alias(f"p_{c}") for c in names))

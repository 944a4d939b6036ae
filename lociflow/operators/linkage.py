"""Linkage disequilibrium between loci of different groups, and effective population size from it.

Loci are packed into chunks of a block, samples in a fixed order, so that a pair of chunks gives the counts of all its
pairs of loci by nine matrix products. A pair budget picks pairs before anything is counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..deploy import ship
from ..errors import ConfigurationError, InsufficientDataError
from ..functions.two_locus import STATISTICS, unbiased
from ..genotypes import GenotypeFrame, portable_hash
from ..shared import write_shared
from .encodings import encode_012
from .resampling import dense_index, largest_remainder, locus_weights, percentile_interval

__all__ = ["aggregate_ld", "block_shares", "block_sums", "budget_allocation", "informative_share", "ld_bootstrap", "ld_summary", "locus_blocks", "ne_from_r2d", "two_locus_counts", "two_locus_sums", "unbiased_d", "with_r2", "with_statistics"]

STATES = [f"n{k}" for k in range(9)]
MIN_SAMPLES = 4
#: Population that all samples together are.
OVERALL = "Overall"
#: Pairs of loci that are sampled for each population by default where a budget applies.
MAX_PAIRS = 1_000_000
#: Loci, and calls, in a chunk at most, and pairs that are counted at once.
CHUNK_LOCI, CHUNK_CALLS, TILE = 1_024, 4_000_000, 200_000
#: Share of a tile's pairs from which all are counted by matrix products.
DENSE = 0.05
_STEP = 1_000_003
_HASHES = (1 << 31) - 1


def _group(frame: GenotypeFrame, groups: DataFrame | None, assume_unlinked: bool) -> DataFrame:
    """(locus_idx, grp): given groups, else chromosomes (two at least), else each locus alone if that may be assumed."""
    if groups is not None:
        return groups.select("locus_idx", F.col("grp").cast("string").alias("grp"))
    loci = frame.loci.select("locus_idx", F.col("chrom").cast("string").alias("grp"))
    if loci.select("grp").distinct().limit(2).count() >= 2:
        return loci
    if assume_unlinked:
        return loci.select("locus_idx", F.col("locus_idx").cast("string").alias("grp"))
    raise ConfigurationError("loci of one chromosome only: give groups or assume_unlinked")


def locus_blocks(loci: DataFrame, n_blocks: int, seed: int = 0) -> DataFrame:
    """``block`` 0..n_blocks-1, balanced, in hash order."""
    return _numbered(loci, n_blocks, seed).drop("nth")


def _numbered(loci: DataFrame, n_blocks: int, seed: int) -> DataFrame:
    """``block``, and the locus' number ``nth`` within it."""
    slots = dense_index(loci.withColumn("__hash", portable_hash(F.col("locus_idx"), seed)), "__hash", "locus_idx")
    return slots.withColumn("block", (F.col("slot") % n_blocks).cast("int")).withColumn("nth", F.floor(F.col("slot") / n_blocks)).drop("__hash", "slot")


def _given(loci: DataFrame, blocks: DataFrame) -> DataFrame:
    """``loci`` with the blocks that ``blocks(locus_idx, block)`` names, as numbers in order of the names; loci without one go."""
    named = blocks.select("locus_idx", F.col("block").cast("string").alias("__name"))
    number = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("__name")) - 1  # a row a block
    numbers = named.select("__name").distinct().withColumn("block", number.cast("int"))
    nth = F.row_number().over(Window.partitionBy("block").orderBy("locus_idx")) - 1
    return loci.join(named, "locus_idx").join(F.broadcast(numbers), "__name").drop("__name").withColumn("nth", nth)


_PACKED = T.StructType([T.StructField("population", T.StringType()), T.StructField("block", T.IntegerType()), T.StructField("chunk", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("loci", "groups", "calls"))])


class _Chunk:
    """Loci of one block, in order, with their groups and a row of calls each (-1: none)."""

    def __init__(self, row: dict):
        self.block, self.loci, self.groups = row["block"], np.frombuffer(row["loci"], "<i8"), np.frombuffer(row["groups"], "<i8")
        self.calls = np.frombuffer(row["calls"] or bytes(len(self.loci)), np.int8).reshape(len(self.loci), -1)


def _chunks(frame: GenotypeFrame, populations: list[str] | None, groups: DataFrame | None, n_blocks: int, seed: int, assume_unlinked: bool, overall: bool, blocks: DataFrame | None) -> DataFrame:
    """The packed chunks of each population, in a table: loci with two alleles, samples in order of their numbers."""
    samples = frame.samples.select("sample_idx", "population")
    if overall:
        samples = samples.unionByName(samples.withColumn("population", F.lit(OVERALL)))
    if populations:
        samples = samples.filter(F.col("population").isin([*populations, *([OVERALL] if overall else [])]))
    sizes = {r["population"]: r["count"] for r in samples.groupBy("population").count().collect()}  # a row a population
    few = sorted(p for p, n in sizes.items() if n < MIN_SAMPLES)
    if few and populations:
        raise InsufficientDataError(f"populations need {MIN_SAMPLES} samples: {few}")
    samples = samples.filter(~F.col("population").isin(few))
    nth = F.row_number().over(Window.partitionBy("population").orderBy("sample_idx")) - 1
    samples = samples.withColumn("sample", nth.cast("int"))
    calls = encode_012(frame).filter("dosage is not null").join(samples, "sample_idx")
    seen = calls.groupBy("locus_idx").agg(F.min("dosage").alias("lo"), F.max("dosage").alias("hi"), F.max((F.col("dosage") == 1).cast("int")).alias("het"))
    loci = seen.filter("het = 1 or (lo = 0 and hi = 2)").select("locus_idx").join(frame.loci.filter(F.size("alt") == 1).select("locus_idx"), "locus_idx", "left_semi")
    loci = _numbered(loci, n_blocks, seed) if blocks is None else _given(loci, blocks)
    most = max(sizes.values(), default=1)
    width = max(1, min(CHUNK_LOCI, CHUNK_CALLS // most))
    loci = loci.join(_group(frame, groups, assume_unlinked), "locus_idx").select("locus_idx", "block", F.floor(F.col("nth") / width).cast("int").alias("chunk"), F.xxhash64("grp").alias("grp"))
    cells = calls.join(loci, "locus_idx").select("population", "block", "chunk", "locus_idx", "grp", "sample", F.col("dosage").cast("tinyint").alias("dosage"))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        population, block, chunk = (k.as_py() for k in key)
        names, first, own = np.unique(np.asarray(rows.column("locus_idx")), return_index=True, return_inverse=True)
        matrix = np.full((len(names), sizes[population]), -1, np.int8)
        matrix[own, np.asarray(rows.column("sample"))] = np.asarray(rows.column("dosage"))
        data = [names.astype("<i8").tobytes(), np.asarray(rows.column("grp"))[first].astype("<i8").tobytes(), matrix.tobytes()]
        return pa.table([[population], pa.array([block], pa.int32()), pa.array([chunk], pa.int32()), *([d] for d in data)], names=_PACKED.names)

    ship(frame.spark)
    return write_shared(cells.groupBy("population", "block", "chunk").applyInArrow(pack, _PACKED), "locus-chunks")


def _hash(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """``portable_hash`` of pairs of loci, broadcast."""
    one = ((a * _STEP + b) * 7919 + seed * 104729 + 12345) % _HASHES
    return (one * one + one) % _HASHES


def _chosen(left: _Chunk, right: _Chunk, seed: int, limit: int | None) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(rows of ``left``, places in them, rows of ``right``, hashes) of pairs of different groups, a tile at a time.

    With a ``limit``, only pairs whose hash is below it.
    """
    step = max(1, TILE // max(1, len(right.loci)))
    for at in range(0, len(left.loci), step):
        part = slice(at, min(at + step, len(left.loci)))
        take, hashes = left.groups[part, None] != right.groups[None], None
        if limit is not None:
            a, b = left.loci[part, None], right.loci[None]
            hashes = _hash(np.minimum(a, b), np.maximum(a, b), seed)
            take &= hashes < limit
        i, j = np.nonzero(take)
        if len(i):
            yield part, i, j, None if hashes is None else hashes[i, j]


def _counted(left: _Chunk, right: _Chunk, seed: int, limit: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of ``left``, rows of ``right``, counts of states, left first): by matrix products, or pair by pair where few are wanted."""
    states = None
    for part, i, j, _ in _chosen(left, right, seed, limit):
        if len(i) >= DENSE * (part.stop - part.start) * len(right.loci):
            states = states or [[(c.calls == k).astype(np.float32) for k in range(3)] for c in (left, right)]
            counts = np.stack([(x[part] @ y.T)[i, j] for x in states[0] for y in states[1]], 1).astype(np.int64)
        else:
            counts = np.zeros((len(i), 9), np.int64)
            step = max(1, CHUNK_CALLS // left.calls.shape[1])
            for low in range(0, len(i), step):
                x, y = left.calls[part][i[low : low + step]], right.calls[j[low : low + step]]
                state = np.where((x >= 0) & (y >= 0), 3 * x + y, 9) + 10 * np.arange(len(x))[:, None]
                counts[low : low + step] = np.bincount(state.ravel(), minlength=10 * len(x)).reshape(-1, 10)[:, :9]
        yield part.start + i, j, counts


_PAIR = "population string, i long, j long, id long, block int, loci binary, groups binary, calls binary"


def _beside(chunks: DataFrame, calls: bool = True) -> DataFrame:
    """Each chunk beside each chunk of other blocks of its population: two rows of one (population, i, j), which are in one task."""
    number = lambda block, chunk: block.cast("long") * (1 << 32) + chunk
    ids = sorted(r["id"] for r in chunks.select(number(F.col("block"), F.col("chunk")).alias("id")).distinct().collect())  # a row a chunk
    rows = chunks.withColumn("id", number(F.col("block"), F.col("chunk"))).withColumn("other", F.explode(F.array(*map(F.lit, ids)).cast("array<long>")))
    rows = rows.filter(F.shiftright("other", 32) != F.col("block"))
    rows = rows.select("population", F.least("id", "other").alias("i"), F.greatest("id", "other").alias("j"), "id", "block", "loci", "groups", "calls" if calls else F.lit(None).cast("binary").alias("calls"))
    return rows.repartition("population", "i", "j").sortWithinPartitions("population", "i", "j", "id")


def _by_pair(batches: Iterator[pa.RecordBatch], work: Callable) -> Iterator[pa.RecordBatch]:
    """``work(population, left, right)`` for each pair of rows of one (population, i, j)."""
    held = None
    for b in batches:
        for k in range(b.num_rows):
            row = b.slice(k, 1).to_pylist()[0]
            if held is not None and all(row[c] == held[c] for c in ("population", "i", "j")):
                yield from work(row["population"], _Chunk(held), _Chunk(row))
                held = None
            else:
                held = row


def _limits(chunks: DataFrame, seed: int, max_pairs: int) -> dict[tuple[str, int, int], int]:
    """By population and two blocks, the hash below which their pairs are taken.

    The budget is dealt over pairs of blocks in proportion to the pairs of loci they have. Hashes are first cut where
    some more than the share is sure to be left; the greatest of the share's hashes is the limit, and equal ones are taken too.
    """

    def tell(batches):
        for b in batches:
            for row in b.to_pylist():
                names, n = np.unique(np.frombuffer(row["groups"], "<i8"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([row["population"]] * len(n)), pa.array([row["block"]] * len(n), pa.int32()), pa.array(names), pa.array(n)], names=["population", "block", "grp", "n"])

    by = chunks.select("population", "block", "groups").mapInArrow(tell, "population string, block int, grp long, n long").groupBy("population", "block", "grp").agg(F.sum("n").alias("n"))
    side = lambda df, x, *keys: df.select("population", *keys, F.col("block").alias(x), F.col("n").alias(f"n{x}"))
    same = side(by, "a", "grp").join(side(by, "b", "grp"), ["population", "grp"]).filter("a < b").groupBy("population", "a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("same"))
    whole = by.groupBy("population", "block").agg(F.sum("n").alias("n"))
    both = side(whole, "a").join(side(whole, "b"), "population").filter("a < b").join(same, ["population", "a", "b"], "left")
    sizes = both.select("population", "a", "b", (F.col("a").cast("long") * (1 << 32) + F.col("b")).alias("pair"), (F.col("na") * F.col("nb") - F.coalesce("same", F.lit(0))).alias("n")).filter("n > 0")
    # A row a population and pair of blocks.
    found = {(r["population"], r["a"], r["b"]): (r["n"], r["share"]) for r in largest_remainder(sizes, "n", max_pairs, "pair", "population").collect()}
    first = {k: int(min(1.0, (share + 6 * share**0.5 + 20) / n) * _HASHES) + 1 for k, (n, share) in found.items() if share < n}

    def hashes(batches):
        def work(population, left, right):
            limit = first.get((population, left.block, right.block))
            for _, i, _, h in _chosen(left, right, seed, limit) if limit is not None else ():
                n = len(i)
                yield pa.RecordBatch.from_arrays([pa.array([population] * n), pa.array([left.block] * n, pa.int32()), pa.array([right.block] * n, pa.int32()), pa.array(h)], names=["population", "a", "b", "h"])

        return _by_pair(batches, work)

    if not first:
        return {}
    rank = F.row_number().over(Window.partitionBy("population", "a", "b").orderBy("h"))
    shares = chunks.sparkSession.createDataFrame([(*k, found[k][1]) for k in first], "population string, a int, b int, share long")
    ranked = _beside(chunks, calls=False).mapInArrow(hashes, "population string, a int, b int, h long").withColumn("r", rank)
    last = {(r["population"], r["a"], r["b"]): r["h"] + 1 for r in ranked.join(F.broadcast(shares), ["population", "a", "b"]).filter("r = share").collect()}
    return {k: last.get(k, limit) if found[k][1] else 0 for k, limit in first.items()}


_SWAPPED = [3 * (k % 3) + k // 3 for k in range(9)]


def two_locus_counts(
    frame: GenotypeFrame, populations: list[str] | None = None, groups: DataFrame | None = None, n_blocks: int = 10, seed: int = 0, assume_unlinked: bool = False, max_pairs: int | None = None,
    overall: bool = False, blocks: DataFrame | None = None,
) -> DataFrame:
    """(population, locus_a, locus_b, block_a, block_b, n0..n8): counts of 3 * left + right over individuals with both calls.

    Loci with two alleles; pairs of different groups and different blocks, for each population with ``MIN_SAMPLES``
    samples; ``overall`` adds all samples as one population. ``blocks(locus_idx, block)`` gives blocks by name instead of
    ``n_blocks`` in hash order. ``max_pairs`` takes so many pairs for each population, dealt over pairs of blocks in
    proportion to their pairs, those first in hash order; the others are never counted.
    """
    chunks = _chunks(frame, populations, groups, n_blocks, seed, assume_unlinked, overall, blocks)
    limits = _limits(chunks, seed, max_pairs) if max_pairs is not None else {}

    def run(batches):
        def work(population, left, right):
            for i, j, counts in _counted(left, right, seed, limits.get((population, left.block, right.block))):
                a, b = left.loci[i], right.loci[j]
                turn = a > b
                counts[turn] = counts[turn][:, _SWAPPED]
                a, b = np.minimum(a, b), np.maximum(a, b)
                some = counts.any(1)
                block = [np.where(turn, y, x)[some] for x, y in ((left.block, right.block), (right.block, left.block))]
                columns = [a[some], b[some], *(x.astype(np.int32) for x in block), *counts[some].T]
                yield pa.RecordBatch.from_arrays([pa.array([population] * len(columns[0])), *map(pa.array, columns)], names=["population", "locus_a", "locus_b", "block_a", "block_b", *STATES])

        return _by_pair(batches, work)

    return _beside(chunks).mapInArrow(run, "population string, locus_a long, locus_b long, block_a int, block_b int, " + ", ".join(f"{c} long" for c in STATES))


def two_locus_sums(
    frame: GenotypeFrame, populations: list[str] | None = None, groups: DataFrame | None = None, n_blocks: int = 10, seed: int = 0, assume_unlinked: bool = False, max_pairs: int | None = MAX_PAIRS,
    overall: bool = False, blocks: DataFrame | None = None,
) -> DataFrame:
    """``block_sums`` of all statistics of the pairs of ``two_locus_counts``: pairs are counted, judged and added in one pass, and none leaves its task."""
    chunks = _chunks(frame, populations, groups, n_blocks, seed, assume_unlinked, overall, blocks)
    limits = _limits(chunks, seed, max_pairs) if max_pairs is not None else {}
    names = list(STATISTICS)

    def run(batches):
        def work(population, left, right):
            pairs, least, total, sums = 0, 1 << 62, 0, np.zeros(len(names))
            for _, _, counts in _counted(left, right, seed, limits.get((population, left.block, right.block))):
                n = counts.sum(1)
                enough = n >= MIN_SAMPLES
                if enough.any():
                    pairs, least, total = pairs + int(enough.sum()), min(least, int(n[enough].min())), total + int(n[enough].sum())
                    sums += unbiased(counts[enough], *names).sum(0)
            if pairs:
                values = [population, min(left.block, right.block), max(left.block, right.block), pairs, least, total, *sums.tolist()]
                kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 3, *[pa.float64()] * len(names)]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["population", "block_a", "block_b", "n_pairs", "min_n", "sum_n", *(f"sum_{c}" for c in names)])

        return _by_pair(batches, work)

    parts = _beside(chunks).mapInArrow(run, "population string, block_a int, block_b int, n_pairs long, min_n long, sum_n long, " + ", ".join(f"sum_{c} double" for c in names))
    return parts.groupBy("population", "block_a", "block_b").agg(F.sum("n_pairs").alias("n_pairs"), F.min("min_n").alias("min_n"), F.sum("sum_n").alias("sum_n"), *(F.sum(f"sum_{c}").alias(f"sum_{c}") for c in names))


def unbiased_d(counts: DataFrame) -> DataFrame:
    """Composite disequilibrium in closed form: twice the haplotype determinant over n (n - 1)."""
    c = [F.col(x).cast("double") for x in STATES]
    n = sum(c[1:], c[0])
    ab = c[0] + (c[1] + c[3]) / 2 + c[4] / 4
    ab_ = c[2] + (c[1] + c[5]) / 2 + c[4] / 4
    a_b = c[6] + (c[3] + c[7]) / 2 + c[4] / 4
    a_b_ = c[8] + (c[5] + c[7]) / 2 + c[4] / 4
    return counts.withColumn("n", n.cast("long")).withColumn("d", F.when(n > 1, 2 * (ab * a_b_ - ab_ * a_b) / (n * (n - 1))))


def with_statistics(counts: DataFrame) -> DataFrame:
    """``counts`` with n, d, d2, dz, pi2 (NaN: too few individuals), from the polynomials in Arrow batches."""
    ship(counts.sparkSession)
    names = list(STATISTICS)

    @F.pandas_udf(", ".join(f"{s} double" for s in names))
    def statistics(*columns):
        import pandas as pd

        table = np.column_stack([c.to_numpy() for c in columns])
        return pd.DataFrame(unbiased(table, *names), columns=names)

    out = counts.withColumn("__s", statistics(*STATES)).withColumn("n", sum((F.col(x) for x in STATES[1:]), F.col(STATES[0])))
    return out.select(*counts.columns, "n", *[F.col(f"__s.{s}").alias(s) for s in names])


def block_sums(statistics: DataFrame, columns: tuple[str, ...] = ("d", "d2", "dz", "pi2")) -> DataFrame:
    """Sums over the valid pairs of each pair of blocks, in order."""
    fine = statistics.filter("n >= 4")
    for c in columns:
        fine = fine.filter(F.col(c).isNotNull() & ~F.isnan(c))
    a, b = F.least("block_a", "block_b").alias("block_a"), F.greatest("block_a", "block_b").alias("block_b")
    return fine.groupBy("population", a, b).agg(F.count("*").alias("n_pairs"), F.min("n").alias("min_n"), F.sum("n").alias("sum_n"), *(F.sum(c).alias(f"sum_{c}") for c in columns))


def ne_from_r2d(r2d: Column, mating: str = "random") -> Column:
    """Effective size: 1 / (3 r2D), twice that for monogamous mating; null unless r2D is above zero."""
    if mating not in ("random", "monogamous"):
        raise ConfigurationError(f"unknown mating system: {mating}")
    return F.when(r2d > 0, F.lit(1.0 if mating == "random" else 2.0) / (3 * r2d))


def aggregate_ld(sums: DataFrame, *keys: str, mating: str = "random") -> DataFrame:
    total = sums.groupBy("population", *keys).agg(F.sum("n_pairs").alias("n_pairs"), F.sum("sum_n").alias("sum_n"), *(F.sum(f"sum_{c}").alias(f"sum_{c}") for c in ("d", "d2", "dz", "pi2")))
    ratio = lambda c: F.when(F.col("sum_pi2") != 0, F.col(c) / F.col("sum_pi2"))
    out = total.select("population", *keys, "n_pairs", (F.col("sum_n") / F.col("n_pairs")).alias("mean_n"), (F.col("sum_d") / F.col("n_pairs")).alias("mean_d"), ratio("sum_d2").alias("r2d"), ratio("sum_dz").alias("rdz"))
    return out.withColumn("ne", ne_from_r2d(F.col("r2d"), mating))


def ld_bootstrap(sums: DataFrame, n_reps: int = 100, seed: int = 0, method: str = "pairs") -> DataFrame:
    """Replicates that draw pairs of blocks, or with ``node_cluster`` blocks: a pair then counts by the product of its blocks' draws."""
    if method not in ("pairs", "node_cluster"):
        raise ConfigurationError(f"unknown bootstrap: {method}")
    values = ["n_pairs", "sum_n", "sum_d", "sum_d2", "sum_dz", "sum_pi2"]
    alone = Window.partitionBy(F.lit(0))  # a row a block or pair of blocks
    if method == "pairs":
        blocks = sums.select("block_a", "block_b").distinct()
        slots = blocks.withColumn("slot", F.row_number().over(alone.orderBy("block_a", "block_b")) - 1)
        joined = sums.join(slots, ["block_a", "block_b"]).join(locus_weights(sums.sparkSession, blocks.count(), n_reps, seed), "slot")
    else:
        blocks = sums.select(F.explode(F.array("block_a", "block_b")).alias("block")).distinct()
        slots = blocks.withColumn("slot", F.row_number().over(alone.orderBy("block")) - 1)
        drawn = locus_weights(sums.sparkSession, blocks.count(), n_reps, seed).join(slots, "slot")
        side = lambda x: drawn.select("rep", F.col("block").alias(f"block_{x}"), F.col("w").alias(f"w_{x}"))
        joined = sums.join(side("a"), "block_a").join(side("b"), ["rep", "block_b"]).withColumn("w", F.col("w_a") * F.col("w_b"))
    return aggregate_ld(joined.select("population", "rep", *[(F.col(v) * F.col("w")).alias(v) for v in values]), "rep")


def ld_summary(sums: DataFrame, n_reps: int = 100, seed: int = 0, mating: str = "random", method: str = "pairs") -> DataFrame:
    """Estimates with 95 percent intervals; those of the effective size come from inverting those of r2D."""
    sums = write_shared(sums, "block-sums")  # a row a population and pair of blocks, read several times
    reps = ld_bootstrap(sums, n_reps, seed, method)
    interval = percentile_interval(reps.filter("r2d is not null"), "r2d", "population").withColumnsRenamed({"lower": "r2d_lower", "upper": "r2d_upper"})
    out = aggregate_ld(sums, mating=mating).join(interval, "population", "left")
    upper = F.when(F.col("r2d_lower") > 0, ne_from_r2d(F.col("r2d_lower"), mating)).when(F.col("r2d_lower").isNotNull(), float("inf"))
    status = F.when(F.col("ne").isNull(), "not estimable").when(F.col("r2d_lower") <= 0, "unbounded").otherwise("estimated")
    return out.select("*", ne_from_r2d(F.col("r2d_upper"), mating).alias("ne_lower"), upper.alias("ne_upper"), status.alias("ne_status"))


def informative_share(statistics: DataFrame) -> DataFrame:
    """(population, n_pairs, informative): the share of pairs whose pi2 is not zero."""
    fine = statistics.filter((F.col("n") >= MIN_SAMPLES) & ~F.isnan("pi2"))
    return fine.groupBy("population").agg(F.count("*").alias("n_pairs"), F.avg((F.col("pi2") != 0).cast("double")).alias("informative"))


def with_r2(statistics: DataFrame) -> DataFrame:
    """Pairs with ``r2_star``, their D squared over pi2."""
    return statistics.withColumn("r2_star", F.when(F.col("pi2") != 0, F.col("d2") / F.col("pi2")))


def block_shares(sums: DataFrame) -> DataFrame:
    """(population, block_a, block_b, n_pairs, pair_share, signal_share): what each pair of blocks adds to a population's pairs and to its sum of D squared."""
    total = sums.groupBy("population").agg(F.sum("n_pairs").alias("__n"), F.sum("sum_d2").alias("__s"))
    share = lambda c, t: F.when(F.col(t) != 0, F.col(c) / F.col(t))
    return sums.join(total, "population").select("population", "block_a", "block_b", "n_pairs", share("n_pairs", "__n").alias("pair_share"), share("sum_d2", "__s").alias("signal_share"))


def budget_allocation(counts: DataFrame, total: int, *by: str) -> DataFrame:
    """``total`` pairs (for each value of ``by``, if given) dealt over pairs of blocks in proportion to the pairs they have."""
    sizes = counts.groupBy(*by, (F.least("block_a", "block_b") * 1000 + F.greatest("block_a", "block_b")).alias("pair")).agg(F.count("*").alias("n"))
    return largest_remainder(sizes, "n", total, "pair", *by)

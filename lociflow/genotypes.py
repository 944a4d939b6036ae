"""The genotype bundle: calls, loci and samples as DataFrames, and chains of filters over them.

A frame never changes. Locus filters are predicates over one table of per-locus metrics, which depends on the kept
samples alone, so a chain of them costs one aggregate over the calls however long it is; a sample filter measures its
samples over the loci kept so far and starts a new metrics table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .errors import EmptyLocusSetError, InvalidThresholdError
from .functions.iupac import BASES, copies, is_het
from .shared import write_shared

__all__ = ["GenotypeFrame", "portable_hash"]


def portable_hash(key: Column, seed: int = 0) -> Column:
    """A pseudo-random order that any SQL engine gives alike: two rounds of integer arithmetic below 2^63."""
    one = (key.cast("long") * 7919 + F.lit(seed).cast("long") * 104729 + 12345) % 2147483647
    return (one * one + one) % 2147483647


def _threshold(t, low: float = 0.0, high: float = 1.0) -> float:
    if not isinstance(t, float):
        raise TypeError(f"threshold must be a float, got {type(t).__name__}")
    if not low <= t <= high:
        raise InvalidThresholdError(f"threshold {t} is outside [{low}, {high}]")
    return t


class GenotypeFrame:
    """``calls(locus_idx, sample_idx, gt[, depth])`` with a row for each cell (null: missing), ``loci(locus_idx, chrom, pos, ...)``
    and ``samples(sample_idx, sample_id, population)``.

    ``loci`` and ``samples`` are those kept so far; ``calls`` stay whole until ``resolve``. A filter only notes its
    predicate. What a chain keeps, and its audit, come from one aggregate over the metrics with a count for each step.
    """

    def __init__(self, calls: DataFrame, loci: DataFrame, samples: DataFrame, _done: tuple = (), _base: DataFrame | None = None, _pending: tuple = ()):
        self.calls, self.samples, self._all, self._done, self._base, self._pending = calls, samples, loci, _done, _base, _pending
        self._found: tuple | None = None

    def _with(self, **changes) -> GenotypeFrame:
        own = {"calls": self.calls, "loci": self._all, "samples": self.samples, "_done": self._done, "_base": self._base, "_pending": self._pending}
        return GenotypeFrame(**(own | changes))

    @property
    def loci(self) -> DataFrame:
        if not self._pending and self._base is None:
            return self._all
        return self._all.join(self._kept().select("locus_idx"), "locus_idx", "left_semi")

    # -- views ---------------------------------------------------------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self.calls.sparkSession

    def with_population(self) -> DataFrame:
        """Calls of kept samples with their population. Samples are few next to calls, but not bounded: Spark picks the join."""
        return self.calls.join(self.samples.select("sample_idx", "population"), "sample_idx")

    def stored(self) -> GenotypeFrame:
        """The bundle with its tables written to the shared folder: what follows reads them instead of making them again."""
        return GenotypeFrame(write_shared(self.calls, "calls"), write_shared(self.loci, "loci"), write_shared(self.samples, "samples"))

    def register(self) -> None:
        """Temporary views ``calls``, ``loci`` and ``samples``."""
        for name in ("calls", "loci", "samples"):
            getattr(self, name).createOrReplaceTempView(name)

    def metrics(self) -> DataFrame:
        """One row per kept locus: calls, missing and heterozygous calls, copies of each base with and without
        heterozygotes, the largest rates over populations, and total depth where calls have one."""
        if self._base is not None:
            return self._base
        gt = F.col("gt")
        sums = [
            F.count("*").alias("n_samples"),
            F.count("gt").alias("n_called"),
            F.sum(is_het(gt).cast("int")).alias("n_het"),
            *(F.sum(copies(gt, b)).alias(f"n_{b}") for b in BASES),
            *(F.sum(copies(gt, b, with_het=False)).alias(f"h_{b}") for b in BASES),
            (F.sum("depth") if "depth" in self.calls.columns else F.sum(F.lit(None).cast("long"))).alias("depth"),
        ]
        by_pop = self.with_population().groupBy("locus_idx", "population").agg(*sums)
        names = [c for c in by_pop.columns if c not in ("locus_idx", "population")]
        n = F.col("n_samples").cast("double")
        total = by_pop.groupBy("locus_idx").agg(
            *(F.sum(c).alias(c) for c in names),
            F.max((F.col("n_samples") - F.col("n_called")) / n).alias("pop_missing"),
            F.max(F.coalesce("n_het", F.lit(0)) / n).alias("pop_het"),
        )
        return self._all.select("locus_idx", "chrom", "pos").join(total.fillna(0, ["n_het"]), "locus_idx")

    # -- chain ---------------------------------------------------------------------------------------------------------

    def _keep_loci(self, method: str, keep: Column, threshold=None, base: DataFrame | None = None) -> GenotypeFrame:
        """Keep loci for which ``keep`` holds; a filter that would keep none keeps all and says so in the audit."""
        return self._with(_base=self.metrics() if base is None else base, _pending=(*self._pending, (method, threshold, F.coalesce(keep, F.lit(False)))))

    def _judged(self) -> tuple[list[tuple], list[Column]]:
        """Audit rows of the pending steps and the predicates that take effect: one job, and one more for each step that keeps none."""
        if self._found is None:
            # A row a locus, read by every count and by what the chain keeps.
            self._base = write_shared(self._base, "metrics") if self._pending else self._base
            rows, effective, todo, total = [], [], list(self._pending), None
            while todo:
                sums, conjunction = [F.count("*").alias("c0")] if total is None else [F.lit(total).alias("c0")], F.lit(True)
                for p in effective:
                    conjunction = conjunction & p
                for k, (_, _, keep) in enumerate(todo, 1):
                    conjunction = conjunction & keep
                    sums.append(F.count_if(conjunction).alias(f"c{k}"))
                counts = self._base.agg(F.count("*").alias("__n"), *sums).first()
                total = counts["c0"]
                for k, (method, threshold, keep) in enumerate(list(todo), 1):
                    kept = counts[f"c{k}"]
                    rows.append((method, threshold, total, kept))
                    todo.pop(0)
                    if not kept:
                        break  # keeps all: later counts are taken again without it
                    effective.append(keep)
                    total = kept
            self._found = rows, effective
        return self._found

    def _kept(self) -> DataFrame:
        """Metrics of kept loci."""
        kept = self.metrics()
        for keep in self._judged()[1]:
            kept = kept.filter(keep)
        return kept

    def _rebased(self) -> tuple[GenotypeFrame, DataFrame]:
        """The chain so far put behind: its rows in the audit, its kept metrics as the new base."""
        kept = self._kept()
        return self._with(_done=(*self._done, *self._judged()[0]), _base=kept, _pending=()), kept

    def resolve(self) -> GenotypeFrame:
        """End of a chain: calls of kept samples and loci only. Raises if no filter was applied or nothing is left."""
        if not self._pending and not self._done:
            raise RuntimeError("no filter has been applied")
        loci = self.loci
        if loci.isEmpty():
            raise EmptyLocusSetError("no locus is left")
        if self.samples.isEmpty():
            raise EmptyLocusSetError("no sample is left")
        kept = self.calls.join(loci.select("locus_idx"), "locus_idx", "left_semi").join(self.samples.select("sample_idx"), "sample_idx", "left_semi")
        return GenotypeFrame(kept, loci, self.samples)

    def audit(self) -> DataFrame:
        """One row per step: what it removed and kept, as counts and shares rounded to two places."""
        rows = [*self._done, *self._judged()[0]]
        made = [(k, method, None if t is None else float(t), total - kept, (total - kept) / total if total else None, kept, kept / total if total else None, total) for k, (method, t, total, kept) in enumerate(rows, 1)]
        out = self.spark.createDataFrame(made, "step int, filter_method string, threshold double, removed_count long, removed_prop double, kept_count long, kept_prop double, total_loci long")
        return out.withColumn("removed_prop", F.round("removed_prop", 2)).withColumn("kept_prop", F.round("kept_prop", 2))

    def flows(self) -> DataFrame:
        """Edges of a flow diagram: from the step before (or ``Unfiltered``) to each step's kept and removed loci."""
        audit = self.audit()
        before = F.coalesce(F.lag("filter_method").over(Window.partitionBy(F.lit(0)).orderBy("step")), F.lit("Unfiltered"))  # a row a step
        edges = audit.select("step", before.alias("source"), "filter_method", "kept_count", "removed_count")
        ends = F.explode(F.array(F.struct(F.col("filter_method").alias("target"), F.col("kept_count").alias("n_loci")), F.struct(F.lit("Removed").alias("target"), F.col("removed_count").alias("n_loci"))))
        return edges.select("step", "source", ends.alias("e")).select("step", "source", "e.target", "e.n_loci")

    # -- filters -------------------------------------------------------------------------------------------------------

    def filter_missing(self, threshold: float) -> GenotypeFrame:
        t = _threshold(threshold)
        return self._keep_loci("filter_missing", (F.col("n_samples") - F.col("n_called")) / F.col("n_samples") <= t, t)

    def filter_missing_pop(self, threshold: float) -> GenotypeFrame:
        return self._keep_loci("filter_missing_pop", F.col("pop_missing") <= threshold, threshold)

    def filter_het(self, threshold: float) -> GenotypeFrame:
        t = _threshold(threshold)
        return self._keep_loci("filter_het", F.col("n_het") / F.col("n_samples") <= t, t)

    def filter_het_pop(self, threshold: float) -> GenotypeFrame:
        return self._keep_loci("filter_het_pop", F.col("pop_het") <= threshold, threshold)

    def filter_missing_sample(self, threshold: float) -> GenotypeFrame:
        t = _threshold(threshold)
        frame, kept = self._rebased() if self._pending or self._base is not None else (self, self._all)
        cells = self.calls.join(kept.select("locus_idx"), "locus_idx", "left_semi").join(self.samples.select("sample_idx"), "sample_idx", "left_semi")
        rates = cells.groupBy("sample_idx").agg(((F.count("*") - F.count("gt")) / F.count("*") <= t).alias("keep"))
        found = rates.agg(F.count("*").alias("total"), F.count_if("keep").alias("kept")).first()
        samples = self.samples.join(rates.filter("keep"), "sample_idx", "left_semi") if found["kept"] else self.samples
        loci = self._all.join(kept.select("locus_idx"), "locus_idx", "left_semi") if frame._base is not None else self._all
        return frame._with(samples=samples, loci=loci, _base=None, _done=(*frame._done, ("filter_missing_sample", t, found["total"], found["kept"])))

    @staticmethod
    def _counts(exclude_heterozygous: bool) -> Column:
        return F.array(*(F.col(f"{'h' if exclude_heterozygous else 'n'}_{b}") for b in BASES))

    def _second(self, exclude_heterozygous: bool) -> tuple[Column, Column, Column]:
        """Second largest count, total, and number of bases present."""
        counts = self._counts(exclude_heterozygous)
        present = F.size(F.filter(counts, lambda n: n > 0))
        return F.get(F.sort_array(counts, asc=False), 1), F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b), present

    def filter_mac(self, min_count: int, exclude_heterozygous: bool = False) -> GenotypeFrame:
        second, _, present = self._second(exclude_heterozygous)
        return self._keep_loci("filter_mac", F.when(present < 2, 0).otherwise(second) >= min_count, min_count)

    def filter_maf(self, threshold: float, exclude_heterozygous: bool = False) -> GenotypeFrame:
        t = _threshold(threshold)
        second, total, present = self._second(exclude_heterozygous)
        return self._keep_loci("filter_maf", F.when((present < 2) | (total == 0), F.lit(0.0)).otherwise(second / total) >= t, t)

    def filter_monomorphic(self, exclude_heterozygous: bool = False) -> GenotypeFrame:
        return self._keep_loci("filter_monomorphic", self._second(exclude_heterozygous)[2] > 1)

    def filter_biallelic(self, exclude_heterozygous: bool = False) -> GenotypeFrame:
        return self._keep_loci("filter_biallelic", self._second(exclude_heterozygous)[2] == 2)

    def filter_singletons(self, exclude_heterozygous: bool = False) -> GenotypeFrame:
        second, _, present = self._second(exclude_heterozygous)
        return self._keep_loci("filter_singletons", ~((present == 2) & (second == 1)))

    def filter_allele_depth(self, min_total_depth: int = 10) -> GenotypeFrame:
        if "depth" not in self.calls.columns:
            raise KeyError("calls have no allele depth")
        return self._keep_loci("filter_allele_depth", F.coalesce("depth", F.lit(0)) >= min_total_depth, min_total_depth)

    def filter_linked(self, seed: int = 0) -> GenotypeFrame:
        """One pseudo-random locus of each chromosome: the least hash, by a partial aggregate."""
        frame, m = self._rebased()
        chosen = m.groupBy("chrom").agg(F.min(F.struct(portable_hash(F.col("locus_idx"), seed).alias("h"), "locus_idx"))["locus_idx"].alias("locus_idx"))
        m = m.drop("__one").join(chosen.select("locus_idx", F.lit(True).alias("__one")), "locus_idx", "left")
        return frame._keep_loci("filter_linked", F.col("__one"), None, m)

    def thin_loci(self, size: int, remove_all: bool = False, seed: int = 0) -> GenotypeFrame:
        """Drop both ends of each gap of at most ``size``, or keep one pseudo-random locus of each chain of such gaps."""
        by_pos = Window.partitionBy("chrom").orderBy("pos", "locus_idx")
        gap, after = F.col("pos") - F.lag("pos").over(by_pos), F.lead("pos").over(by_pos) - F.col("pos")
        frame, m = self._rebased()
        far = lambda c: F.coalesce(c, F.lit(size + 1)) > size
        if remove_all:
            return frame._keep_loci("thin_loci", F.col("__far"), size, m.withColumn("__far", far(gap) & far(after)))
        marked = m.withColumn("__island", far(gap).cast("int")).withColumn("__island", F.sum("__island").over(by_pos.rowsBetween(Window.unboundedPreceding, 0)))
        first = F.row_number().over(Window.partitionBy("chrom", "__island").orderBy(portable_hash(F.col("locus_idx"), seed), "locus_idx"))
        return frame._keep_loci("thin_loci", F.col("__first") == 1, size, marked.withColumn("__first", first))

    def random_subset_loci(self, size: int | float, seed: int = 0) -> GenotypeFrame:
        """Exactly ``size`` loci, or a share of them; more than there are changes nothing."""
        frame, m = self._rebased()
        if isinstance(size, float):
            if not 0 < size <= 1:
                raise InvalidThresholdError("a share must be in (0, 1]")
            size = round(m.count() * size)
            if size == 0:
                raise EmptyLocusSetError("the share leaves no locus")
        if size <= 0:
            raise ValueError("size must be positive")
        chosen = m.orderBy(portable_hash(F.col("locus_idx"), seed), "locus_idx").limit(size).select("locus_idx", F.lit(True).alias("__one"))
        return frame._keep_loci("random_subset_loci", F.col("__one"), size, m.drop("__one").join(chosen, "locus_idx", "left"))

    # -- search --------------------------------------------------------------------------------------------------------

    #: Steps that a threshold search may take, and its ranges.
    SEARCH_STEPS = ("filter_missing_sample", "filter_missing", "filter_missing_pop", "filter_maf", "filter_mac", "filter_monomorphic", "filter_biallelic", "filter_singletons")
    DEFAULT_MISSING = tuple(round(0.1 * k, 1) for k in range(1, 10))
    DEFAULT_MAF = (0.0, 0.01, 0.025, 0.05, 0.075, 0.1)
    DEFAULT_MAC = tuple(range(2, 11))

    def search_thresholds(self, thresholds=None, maf_thresholds=None, mac_thresholds=None, filter_order=("filter_missing", "filter_maf", "filter_monomorphic")) -> DataFrame:
        """Audit rows of the filters in order, for each combination of thresholds and of the heterozygote switch."""
        missing, mafs, macs = thresholds or self.DEFAULT_MISSING, maf_thresholds or self.DEFAULT_MAF, mac_thresholds or self.DEFAULT_MAC
        if unknown := [s for s in filter_order if s not in self.SEARCH_STEPS]:
            raise ValueError(f"unknown steps: {unknown}")
        if any(not 0 < t <= 1 for t in missing) or any(not 0 <= t < 1 for t in mafs) or any(t <= 1 for t in macs):
            raise InvalidThresholdError("missing must be in (0, 1], maf in [0, 1), mac above 1")
        base, _ = self._rebased()
        made = []
        grid = [(miss, maf, exclude, mac) for miss in missing for maf in mafs for exclude in (True, False) for mac in macs]
        chains = []
        for miss, maf, exclude, mac in grid:
            frame = base._with(_done=())
            for step in filter_order:
                args = {"filter_maf": (maf, exclude), "filter_mac": (mac, exclude)}.get(step, (miss,) if "missing" in step else (exclude,))
                frame = getattr(frame, step)(*args)
            chains.append(frame)
        if "filter_missing_sample" not in filter_order:
            _judge_together(base.metrics(), chains)
        for (miss, maf, exclude, mac), frame in zip(grid, chains, strict=True):
            made += [(miss, maf, exclude, mac, k, method, total - kept, kept) for k, (method, _, total, kept) in enumerate([*frame._done, *frame._judged()[0]], 1)]
        return self.spark.createDataFrame(made, "missing double, maf double, exclude_het boolean, mac int, step int, filter_method string, removed_count long, kept_count long")


def _judge_together(metrics: DataFrame, chains: list[GenotypeFrame]) -> None:
    """Counts of all steps of all chains in one aggregate; chains with a step that keeps none are left to judge themselves."""
    sums = [F.count("*").alias("n")]
    for c, frame in enumerate(chains):
        conjunction = F.lit(True)
        for k, (_, _, keep) in enumerate(frame._pending):
            conjunction = conjunction & keep
            sums.append(F.count_if(conjunction).alias(f"c{c}_{k}"))
    counts = metrics.agg(*sums).first()
    for c, frame in enumerate(chains):
        kept = [counts[f"c{c}_{k}"] for k in range(len(frame._pending))]
        if all(kept):
            totals = [counts["n"], *kept[:-1]]
            frame._found = [(m, t, total, n) for (m, t, _), total, n in zip(frame._pending, totals, kept, strict=True)], [p for _, _, p in frame._pending]

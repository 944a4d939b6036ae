"""Best-fit-decreasing packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import map_rows, read_table, write_shared
from .word_ids import WordIds

__all__ = ["BinTree", "op6_packing", "pack_pieces", "plan_bins", "token_pieces"]

CAPACITY = 4096
END_ID = 1
#: Rows that a packing plan may have to be broadcast; beyond, it is merged with the pieces, in runs of ``RANKS`` ranks.
BROADCAST_STEPS, RANKS = 1_000_000, 1 << 20


class BinTree:
    """Segment tree over remaining capacities 0..capacity: how many open bins have each, and the tightest that fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.sums[at] += n
            at >>= 1

    def count(self, room: int) -> int:
        return self.sums[room + self.size]

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least ``need`` that an open bin has: up while only left of it, then down leftmost."""
        at = need + self.size
        if self.sums[at]:
            return need
        while at > 1:
            if not at & 1 and self.sums[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan_bins(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths: steps (length, first rank, count, first bin, offset in the bin).

    Items of one length are alike, and so are bins of equal room, so a run of them is placed at once: the outcome is that
    of placing items one by one, longest first, each in the tightest open bin. The plan's size depends on the distinct
    lengths (at most ``capacity``), not on the number of items.
    """
    tree, open_bins, steps, bins = BinTree(capacity), defaultdict(list), [], 0

    def free(room: int, first: int, n: int) -> None:
        if room:
            tree.add(room, n)
            runs = open_bins[room]
            if runs and runs[-1][0] + runs[-1][1] == first:
                runs[-1] = (runs[-1][0], runs[-1][1] + n)
            else:
                runs.append((first, n))

    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                # A new bin takes as many of these items as fit, since it would be the tightest for each of them.
                fit = capacity // length
                full, rest = divmod(left, fit)
                for k in range(fit):
                    if full:
                        steps.append((length, rank + k * full, full, bins, k * length))
                if full:
                    free(capacity - fit * length, bins, full)
                for k in range(rest):
                    steps.append((length, rank + fit * full + k, 1, bins + full, k * length))
                if rest:
                    free(capacity - rest * length, bins + full, 1)
                bins += full + bool(rest)
                left = 0
                continue
            first, n = open_bins[room].pop()
            take = min(n, left)
            if take < n:
                open_bins[room].append((first + take, n - take))
            tree.add(room, -take)
            steps.append((length, rank, take, first, capacity - room))
            free(room - length, first, take)
            left, rank = left - take, rank + take
    return steps


PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of ``capacity`` tokens; only longer ones are cut.

    Null and empty texts are the end id alone; repeated rows and null ids are rows like others; an empty table gives no
    rows; other columns are not read.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def factory():
        words = WordIds.load(path)

        def work(ids, texts):
            out = [[], [], [], [], []]
            for d, blob in zip(ids, words.encode(texts), strict=True):
                blob += end
                for k, at in enumerate(range(0, len(blob), 4 * capacity)):
                    piece = blob[at : at + 4 * capacity]
                    for column, v in zip(out, (d, k, at // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                        column.append(v)
            return out

        return work

    return map_rows(docs, [docs[id_col].cast("long"), docs[text_col]], PIECES, factory)


PLAN = "length long, run long, rank long, bin long, place long"


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, broadcast_steps: int = BROADCAST_STEPS, ranks: int = RANKS) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` of 1 to ``capacity``; all other columns stay.

    Columns of these two names are replaced; other lengths, and nulls, are an error. Repeated rows are packed each; an
    empty table gives no rows. The driver gets the histogram of lengths only (at most ``capacity`` rows) and plans the
    bins of the whole table on it; ranks within a length come from counts by task and length, so one length may hold any
    share of the rows. Rows are written to the shared folder first, so that ranks stay the same if an executor is lost.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    mark = "__lociflow_"
    length, salt, base, row, rank = (f"{mark}{x}" for x in ("length", "salt", "base", "row", "rank"))
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = write_shared(pieces.withColumn(length, F.col("length").cast("long")).withColumn(salt, (F.spark_partition_id() % blocks).cast("int")), "pieces")
    before = Window.partitionBy(length).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.groupBy(length, salt).agg(F.count("*").alias("n")).withColumn(base, F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = write_shared(counts, "lengths")
    histogram = {r[length]: r["n"] for r in counts.groupBy(length).agg(F.sum("n").alias("n")).collect()}
    if any(not n or not 1 <= n <= capacity for n in histogram):
        raise ValueError(f"lengths must be between 1 and {capacity}")
    steps = np.asarray(plan_bins(histogram, capacity), np.int64).reshape(-1, 5)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    within = Window.partitionBy(length, salt).orderBy(*[F.col(c) for c in ("doc_id", "piece") if c in kept.columns] or [F.lit(0)])
    # The window's dealing and order serve the join too: only the counts are shuffled for it.
    ranked = kept.withColumn(row, F.row_number().over(within)).join(counts.drop("n").hint("merge"), [length, salt])
    ranked = ranked.withColumn(rank, F.col(base) + F.col(row) - 1).select(*pieces.columns, length, rank)
    if len(steps) <= broadcast_steps:
        shared = spark.sparkContext.broadcast(steps)
        place = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

        @F.pandas_udf(place)
        def find(lengths, ranks):
            import pandas as pd

            s = shared.value
            key = s[:, 0] * (1 << 40) + s[:, 1]
            at = np.searchsorted(key, lengths.to_numpy() * (1 << 40) + ranks.to_numpy(), "right") - 1
            return pd.DataFrame({"sequence_id": s[at, 3] + ranks.to_numpy() - s[at, 1], "offset": s[at, 4]})

        found = ranked.withColumn(f"{mark}at", find(length, rank))
        return found.select(*pieces.columns, F.col(f"{mark}at.sequence_id").alias("sequence_id"), F.col(f"{mark}at.offset").alias("offset"))
    # Steps that go on into a next run of ranks are told there again, so each rank finds the step before it in its own run.
    runs = (steps[:, 1] + steps[:, 2] - 1) // ranks - steps[:, 1] // ranks + 1
    own = np.repeat(np.arange(len(steps)), runs)
    nth = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    run = steps[own, 1] // ranks + nth
    first = np.maximum(steps[own, 1], run * ranks)
    plan = spark.createDataFrame(np.stack([steps[own, 0], run, first, steps[own, 3] + first - steps[own, 1], steps[own, 4]], 1).tolist(), PLAN)
    plan = plan.select(F.col("length").alias(length), F.col("run").alias(f"{mark}run"), F.col("rank").alias(rank), F.struct("rank", "bin", "place").alias(f"{mark}step"))
    both = ranked.withColumn(f"{mark}run", F.floor(F.col(rank) / ranks)).withColumn(f"{mark}piece", F.lit(True)).unionByName(plan, allowMissingColumns=True)
    order = Window.partitionBy(length, f"{mark}run").orderBy(rank, F.col(f"{mark}piece").asc_nulls_first())
    found = both.withColumn(f"{mark}at", F.last(f"{mark}step", ignorenulls=True).over(order)).filter(f"{mark}piece")
    return found.select(*pieces.columns, (F.col(f"{mark}at.bin") + F.col(rank) - F.col(f"{mark}at.rank")).alias("sequence_id"), F.col(f"{mark}at.place").alias("offset"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 4096 tokens; a row for each piece.

    Null and empty texts are the end id alone. Repeated rows are packed each; an empty table gives no rows.
    """
    import public_tokenizers

    return pack_pieces(token_pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))

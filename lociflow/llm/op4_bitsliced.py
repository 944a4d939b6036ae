"""Exact top-k inner products over a bit-sliced index."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import read_table, write_shared
from ..deploy import ship

__all__ = ["BitSlicedBlock", "op4_bitsliced_topk", "quantise", "top_k"]

#: Rows of an index block, and queries that meet a block in one task.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 256
#: Query blocks that meet an index block in one task.
TASK_GROUPS = 16
SCALE = 256


class BitSlicedBlock:
    """Bitmaps of one block's rows: for each attribute, one bitmap a binary digit of its value less the block's minimum.

    ``values`` is (rows, attributes) of int64; rows must be in ascending id order, so that the lowest set bits of a
    bitmap are the smallest ids.
    """

    def __init__(self, values: np.ndarray):
        self.rows = len(values)
        self.words = -(-self.rows // 64)
        self.low = values.min(0) if self.rows else np.zeros(values.shape[1], np.int64)
        shifted = (values - self.low).astype(np.uint64)
        self.slices = []
        for column in shifted.T:
            bits = int(column.max()).bit_length() if self.rows else 0
            self.slices.append([self._bitmap((column >> np.uint64(b)) & np.uint64(1)) for b in range(bits)])
        self.all = self._bitmap(np.ones(self.rows, np.uint64))

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        return np.frombuffer(packed.tobytes() + b"\0" * (8 * self.words - len(packed)), np.uint64)

    def _sum(self, factors: list[tuple[int, int]]) -> list[np.ndarray]:
        """Bit slices of the sum of ``factor * attribute`` over (attribute, factor > 0): carry-save adders, column by column."""
        columns: list[list[np.ndarray]] = []

        def put(weight: int, bitmap: np.ndarray) -> None:
            while len(columns) <= weight:
                columns.append([])
            columns[weight].append(bitmap)

        for attribute, factor in factors:
            digit = 0
            while factor:
                if factor & 1:
                    for b, bitmap in enumerate(self.slices[attribute]):
                        put(digit + b, bitmap)
                factor >>= 1
                digit += 1
        out, weight = [], 0
        while weight < len(columns):
            column = columns[weight]
            while len(column) > 2:  # a full adder: three bitmaps of one weight are one of it and one of the next
                a, b, c = column.pop(), column.pop(), column.pop()
                ab = a ^ b
                column.insert(0, ab ^ c)
                put(weight + 1, (a & b) | (ab & c))
            if len(column) == 2:
                a, b = column
                put(weight + 1, a & b)
                column[:] = [a ^ b]
            out.append(column[0] if column else np.zeros(self.words, np.uint64))
            weight += 1
        return out

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """``(slices, base)``: a row's score is the number its bits give, in two's complement, plus ``base``."""
        positive = [(j, int(q)) for j, q in enumerate(query) if q > 0]
        negative = [(j, -int(q)) for j, q in enumerate(query) if q < 0]
        base = int(sum(int(q) * int(low) for q, low in zip(query, self.low, strict=True)))
        plus, minus = self._sum(positive), self._sum(negative)
        size = max(len(plus), len(minus)) + 1
        zero = np.zeros(self.words, np.uint64)
        plus, minus = plus + [zero] * (size - len(plus)), minus + [zero] * (size - len(minus))
        out, borrow = [], zero
        for p, m in zip(plus, minus, strict=True):
            difference = p ^ m
            out.append(difference ^ borrow)
            borrow = (~p & m) | (~difference & borrow)
        return out, base

    def top(self, query: np.ndarray, k: int, without: int | None = None) -> list[tuple[int, int]]:
        """The ``k`` rows of highest score, ties to the first row, as (row, score); ``without`` is a row to leave out.

        From the most significant slice down, rows with a set bit come before all others that are still equal to them:
        they are taken if they are few enough, or else the others are dropped. What is equal in every slice at the
        boundary is resolved by row order.
        """
        slices, base = self.scores(query)
        equal, taken = self.all.copy(), np.zeros(self.words, np.uint64)
        if without is not None:
            equal[without // 64] &= ~(np.uint64(1) << np.uint64(without % 64))
        left = min(k, int(np.bitwise_count(equal).sum()))
        for i, bitmap in enumerate(reversed(slices)):
            ahead = equal & (~bitmap if i == 0 else bitmap)  # the sign: not set is more
            n = int(np.bitwise_count(ahead).sum())
            if n > left:
                equal = ahead
            else:
                taken, equal, left = taken | ahead, equal & ~ahead, left - n
            if not left:
                break
        rows = self._rows(taken) + (self._rows(equal, left) if left else [])
        out = []
        for r in rows:
            w, bit = r // 64, np.uint64(r % 64)
            digits = [int((s[w] >> bit) & np.uint64(1)) for s in slices]
            out.append((r, sum(d << i for i, d in enumerate(digits[:-1])) - (digits[-1] << (len(digits) - 1)) + base))
        return sorted(out, key=lambda x: (-x[1], x[0]))[:k]

    @staticmethod
    def _rows(bitmap: np.ndarray, most: int | None = None) -> list[int]:
        found = []
        for w in np.flatnonzero(bitmap).tolist():
            value = int(bitmap[w])
            while value:
                found.append(64 * w + (value & -value).bit_length() - 1)
                if len(found) == most:
                    return found
                value &= value - 1
        return found


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, v) with v = floor(scale * x) of each component as a double; unusable vectors and null ids are left out."""
    x = vectors[vector_col].cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = vectors.filter(fine & vectors[id_col].isNotNull())
    return usable.select(usable[id_col].cast("long").alias("vec_id"), F.transform(usable[vector_col].cast("array<double>"), lambda c: F.floor(c * scale)).alias("v"))


FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def _matrix(rows: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """For each row of ``queries`` (vec_id, v), its ``k`` highest inner products with rows of ``vectors`` (vec_id, v).

    Both come from ``quantise``. A row is never its own candidate; equal scores go to the smaller vec_id; a query with
    fewer candidates gets all. Vectors shorter than others are taken as padded with zeros. Rows are dealt by a hash of
    their id into blocks of about ``BLOCK_ROWS``, queries into blocks of about ``BLOCK_QUERIES``, and each query block
    goes to each index block as one row: all rows are searched, in blocks, and a task holds one block and at most
    ``TASK_GROUPS`` query blocks. Each meeting gives ``k`` rows a query, of which the best ``k`` over all blocks are kept. Repeated ids are
    separate candidates. Scores must fit in 64 bits. Returns (query_id, rank, vec_id, score).
    """
    spark = vectors.sparkSession
    ship(spark)
    vectors, queries = write_shared(vectors, "vectors"), write_shared(queries, "queries")
    n_blocks, n_groups = max(1, math.ceil(vectors.count() / BLOCK_ROWS)), max(1, math.ceil(queries.count() / BLOCK_QUERIES))
    batches = F.explode(F.sequence(F.lit(0), F.lit((n_groups - 1) // TASK_GROUPS)))
    rows = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block"), batches.alias("batch"), F.lit(-1).alias("group"), F.array(F.struct("vec_id", "v")).alias("members"))
    grouped = queries.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n_groups)).cast("int").alias("group")).agg(F.collect_list(F.struct("vec_id", "v")).alias("members"))
    sent = grouped.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.floor(F.col("group") / TASK_GROUPS).cast("int").alias("batch"), "group", "members")

    def search(table: pa.Table) -> pa.Table:
        index = pa.compute.less(table.column("group"), 0)
        out, ids, values, block, width = [[], [], []], [], [], None, 0
        for batch in [*table.filter(index).to_batches(), *table.filter(pa.compute.invert(index)).to_batches()]:
            for group, members in zip(batch.column("group").to_pylist(), batch.column("members").to_pylist(), strict=True):
                if group < 0:
                    ids += [m["vec_id"] for m in members]
                    values += [m["v"] for m in members]
                    continue
                if block is None:
                    order = sorted(range(len(ids)), key=ids.__getitem__)
                    ids = [ids[i] for i in order]
                    width = max(map(len, values), default=0)
                    block = BitSlicedBlock(_matrix([values[i] for i in order], width))
                    place = dict(zip(ids, range(len(ids)), strict=True))
                for m in members:
                    query = np.asarray(m["v"][:width], np.int64)
                    for r, score in block.top(query, k, place.get(m["vec_id"])) if block.rows else []:
                        for column, v in zip(out, (m["vec_id"], ids[r], score), strict=True):
                            column.append(v)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=FOUND.names)

    both = rows.unionByName(sent)
    found = both.groupBy("block", "batch").applyInArrow(search, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest scores of each vector whose id is divisible by 50, against all other rows of ``embeddings``."""
    vectors = quantise(read_table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


#: The same rows by brute force.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

"""Embedding near-duplicates over an inverted multi-index: codebooks on vector halves, cells visited in distance order."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..deploy import ship
from .common import connected_components, local_components, map_rows, read_table, write_shared

__all__ = ["MultiIndex", "fit_index", "link_vectors", "multi_sequence", "op2_embedding_links"]

THRESHOLD = 0.95
#: Vectors the codebooks and the visiting bound are fitted on at most: those first in hash order of their ids.
FIT_ROWS = 4_096
#: Share of neighbours at exactly the threshold (all real ones are nearer) whose cell the traversal must reach.
TARGET_RECALL = 0.995
#: Indexed vectors and probes that one task compares at most.
CHUNK_ROWS, CHUNK_PROBES = 4_096, 16_384


def multi_sequence(first: np.ndarray, second: np.ndarray, bound: float) -> list[tuple[int, int]]:
    """Pairs (i, j) in ascending order of ``first[i] + second[j]`` up to ``bound``, from the two sorted lists by a heap.

    A pair enters the heap once its left and its lower neighbour are out, so only visited cells and their border are
    ever looked at.
    """
    import heapq

    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a], second[b]
    heap, out, done = [(x[0] + y[0], 0, 0)], [], set()
    while heap:
        cost, i, j = heapq.heappop(heap)
        if cost > bound:
            break
        out.append((int(a[i]), int(b[j])))
        done.add((i, j))
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(x) and q < len(y) and (p == 0 or (p - 1, q) in done) and (q == 0 or (p, q - 1) in done):
                heapq.heappush(heap, (x[p] + y[q], p, q))
    return out


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def _codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's iterations from distinct rows."""
    rng = np.random.default_rng(seed)
    rows = np.unique(x, axis=0)
    centres = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(12):
        near = _squares(x, centres).argmin(1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = x[near == c].mean(0)
    return centres


class MultiIndex:
    """Two codebooks and the excess over a vector's own nearest pair of centres up to which cells are visited."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], excess: float):
        self.books, self.excess, self.half = books, excess, books[0].shape[1]

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _squares(unit[:, : self.half], self.books[0]), _squares(unit[:, self.half :], self.books[1])

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.distances(unit)
        return a.argmin(1) * len(self.books[1]) + b.argmin(1)

    def visits(self, unit: np.ndarray) -> list[list[int]]:
        """Cells of each vector, nearest first."""
        return [[i * len(self.books[1]) + j for i, j in multi_sequence(x, y, x.min() + y.min() + self.excess)] for x, y in zip(*self.distances(unit), strict=True)]

    def reaches(self, unit: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Does vector r visit ``cells[r]``? The same sums as the traversal compares."""
        a, b = self.distances(unit)
        at = np.arange(len(unit))
        return a[at, cells // len(self.books[1])] + b[at, cells % len(self.books[1])] <= a.min(1) + b.min(1) + self.excess


def fit_index(sample: np.ndarray, rows: int, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> MultiIndex:
    """Codebooks of about the fourth root of ``rows`` over 64 cells each side, fitted on unit vectors of ``sample``.

    The excess is calibrated on made neighbours: each sampled vector is turned by exactly the threshold's angle in a
    random direction, and the excess at which ``recall`` of them are reached is taken.
    """
    width = sample.shape[1]
    half = width // 2
    k = 1 << max(2, min(10, round(math.log2(max(rows, 1) / 48) / 2)))
    books = (_codebook(sample[:, :half], k, 1), _codebook(sample[:, half:], k, 2))
    rng = np.random.default_rng(3)
    turn = rng.standard_normal(sample.shape)
    turn -= (turn * sample).sum(1)[:, None] * sample
    norm = np.linalg.norm(turn, axis=1)
    fine = norm > 1e-9
    if not fine.any():
        return MultiIndex(books, 0.0)
    near = threshold * sample[fine] + math.sqrt(1 - threshold**2) * turn[fine] / norm[fine, None]
    index = MultiIndex(books, 0.0)
    (a, b), cells = index.distances(sample[fine]), index.cells(near)
    at = np.arange(len(a))
    over = a[at, cells // len(books[1])] + b[at, cells % len(books[1])] - a.min(1) - b.min(1)
    return MultiIndex(books, float(np.quantile(over, recall)))


PROBES = T.StructType([T.StructField("rep", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("v", T.BinaryType()), T.StructField("cell", T.IntegerType()), T.StructField("visits", T.ArrayType(T.IntegerType()))])
FOUND = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("n", T.LongType())])


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) for all rows of ``vectors``.

    Equal vectors are one indexed vector with a count. Every indexed vector visits cells of the product grid in order of
    distance; a visited cell's vectors are verified by their cosine in double precision, so no pair below ``threshold``
    is ever linked. Cells are split by counts into chunks of indexed vectors and of probes, and each pair of chunks is a
    task's work, so a hot cell costs more tasks, not a larger one. A link is counted once, where the smaller id finds the
    larger or else the reverse, for both ends; from each task come sums and a spanning forest, never all pairs.

    Null vectors, zero vectors and those with null or non-finite components link with nothing; shorter vectors are
    padded with zeros. Rows with a null id are left out of linking and kept. Repeated ids are copies. An empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    x = F.col("v")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    usable = rows.filter(fine)
    reps = write_shared(usable.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "reps")
    size = reps.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    alone = rows.filter(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not size["n"]:
        return alone
    width = size["width"] + size["width"] % 2
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(FIT_ROWS).select("v").collect()
    index = spark.sparkContext.broadcast(fit_index(_units([r["v"] for r in sample], width), size["n"], threshold, recall))

    def place():
        def work(ids, copies, values):
            unit = _units(values, width)
            raw = [np.asarray(v, float).tobytes() for v in values]
            return [ids, copies, raw, index.value.cells(unit).tolist(), index.value.visits(unit)]

        return work

    placed = write_shared(map_rows(reps, ["rep", "copies", "v"], PROBES, place), "placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks"))
    asked = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / CHUNK_PROBES).cast("int").alias("groups"))
    # At most the square of a codebook's 1024 centres, one row a cell.
    plan = write_shared(sizes.join(asked, "cell"), "cells")
    salt = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = placed.select("cell", "rep", "copies", "v").join(plan, "cell").select("cell", salt("chunks", 1).alias("chunk"), every("groups").alias("group"), F.lit(False).alias("probe"), "rep", "copies", "v", F.col("cell").alias("own"))
    asks = placed.select(F.explode("visits").alias("cell"), "rep", "copies", "v", F.col("cell").alias("own")).join(plan, "cell").select("cell", every("chunks").alias("chunk"), salt("groups", 2).alias("group"), F.lit(True).alias("probe"), "rep", "copies", "v", "own")

    def compare(table: pa.Table) -> pa.Table:
        probe = np.asarray(table.column("probe"))
        ids, copies, own = (np.asarray(table.column(c)) for c in ("rep", "copies", "own"))
        values = [np.frombuffer(v, float) for v in table.column("v").to_pylist()]
        raw = np.zeros((len(values), width))
        for i, v in enumerate(values):
            raw[i, : len(v)] = v
        norm = np.linalg.norm(raw, axis=1)
        held, asks = np.flatnonzero(~probe), np.flatnonzero(probe)
        left, right = [], []
        for at in range(0, len(asks), 1024):
            part = asks[at : at + 1024]
            i, j = np.nonzero(raw[part] @ raw[held].T >= threshold * (1 - 1e-12) * np.outer(norm[part], norm[held]))
            a, b = part[i], held[j]
            real = (ids[a] != ids[b]) & ((raw[a] * raw[b]).sum(1) / (norm[a] * norm[b]) >= threshold)
            a, b = a[real], b[real]
            back = np.zeros(len(a), bool)
            late = np.flatnonzero(ids[a] > ids[b])
            if len(late):  # the smaller id counts the link if it reaches the larger one's cell
                back[late] = index.value.reaches(raw[b[late]] / norm[b[late], None], own[a[late]])
            left.append(a[~back])
            right.append(b[~back])
        a, b = np.concatenate([*left, np.zeros(0, int)]).astype(int), np.concatenate([*right, np.zeros(0, int)]).astype(int)
        links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        some = np.flatnonzero(links)
        root = local_components(len(ids), a, b)
        edge = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table([pa.array(np.concatenate([ids[some], ids[edge]])), pa.array(np.concatenate([np.zeros(len(some), int), ids[root[edge]]]), mask=np.concatenate([np.ones(len(some), bool), np.zeros(len(edge), bool)])), pa.array(np.concatenate([links[some].astype(int), np.zeros(len(edge), int)]))], names=FOUND.names)

    found = write_shared(held.unionByName(asks).groupBy("cell", "chunk", "group").applyInArrow(compare, FOUND), "links")
    parts = connected_components(found.filter("b is not null").select("a", "b"), "vectors")
    links = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    facts = reps.join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    facts = facts.select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = usable.join(facts, "v").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(alone)


def _units(values: list, width: int) -> np.ndarray:
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    scale = np.abs(out).max(1, keepdims=True)
    out /= np.where(scale > 0, scale, 1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def op2_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all rows of ``embeddings``, whatever their labels."""
    return link_vectors(read_table(spark, sf_dir, "embeddings"))


#: The same rows by brute force.
ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, e.vec_id = c AS kept FROM embeddings e
    JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON e.vec_id = r.a LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON e.vec_id = l.a
"""

"""Helpers shared by the training-data operators: table access, Arrow row maps, shared-folder tables, linking.

Everything here is distributed: no helper collects rows of a table to the driver.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..deploy import ship
from ..shared import drop_folder, drop_shared, shared_dir, write_shared

__all__ = ["Memo", "add_columns", "connected_components", "drop_folder", "drop_shared", "give_back", "local_components", "map_rows", "read_table", "shared_dir", "small_batches", "write_shared"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, through Spark's reader only."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Free memory of this process goes back to the system: Python workers serve one operator after another."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def small_batches(batches: Iterator[pa.RecordBatch], size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes, so that what Python makes of one stays small; a row is never cut."""
    for batch in batches:
        rows = max(1, size * batch.num_rows // max(batch.get_total_buffer_size(), 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, columns: list, schema: T.StructType, factory: Callable[[], Callable[..., list]]) -> DataFrame:
    """``mapInArrow`` over ``columns``: ``factory()`` runs once per task and returns a function from column lists to column lists."""
    ship(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = factory()
        for batch in small_batches(batches):
            out = work(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, arrow, strict=True)], schema=arrow)
        give_back()

    return df.select(*columns).mapInArrow(run, schema)


def add_columns(df: DataFrame, column: str, added: T.StructType, factory: Callable[[], Callable[[list], list]]) -> DataFrame:
    """``df`` with the columns ``added``, made by ``factory()`` from lists of ``column``; the others pass untouched.

    Columns of ``df`` with the added names are replaced.
    """
    ship(df.sparkSession)
    df = df.drop(*added.names)
    schema = T.StructType([*df.schema.fields, *added.fields])
    arrow, place = to_arrow_schema(schema), df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = factory()
        for batch in small_batches(batches):
            out = work(batch.column(place).to_pylist())
            new = [pa.array(v, f.type) for v, f in zip(out, list(arrow)[batch.num_columns :], strict=True)]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)), *new], schema=arrow)
        give_back()

    return df.mapInArrow(run, schema)


class Memo(dict):
    """What ``learn`` gives for keys, remembered in two generations of half of ``limit`` entries each.

    ``learn`` puts into the memo what is worth it. What is still in use moves from the old generation to the new one.
    """

    def __init__(self, learn: Callable, limit: int):
        self.learn, self.limit, self.old = learn, limit, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            return self.learn(key)
        self[key] = found
        return found

    def age(self) -> None:
        """To be called between texts."""
        if len(self) > self.limit // 2:
            self.old = dict(self)
            self.clear()


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of 0..n-1 reaches over the links (a[k], b[k]): labels spread and jump until none changes."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(before, root):
            break
    return root


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Components of an undirected graph given as ``edges(a, b)`` long pairs: rows ``(node, component)``.

    ``component`` is the smallest node that can be reached. Every round maps each node to the neighbour (or itself) that
    comes first in that round's hash order and contracts the graph, so the rounds are logarithmic in the size of a
    component whatever its shape. Rounds end when no edge between different nodes is left; each round's tables are
    written to the shared folder. Nodes of self loops are kept. Nulls must have been dropped.
    """
    edges = write_shared(edges.select(F.col("a").cast("long"), F.col("b").cast("long")), f"{name}-edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    left = edges.filter("a <> b")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        order = lambda c: F.xxhash64(F.col(c), F.lit(len(maps)))
        best = both.groupBy("a").agg(F.min(F.struct(order("b").alias("h"), F.col("b").alias("n"))).alias("m"))
        step = write_shared(best.select(F.col("a").alias("node"), F.least(F.col("m"), F.struct(order("a").alias("h"), F.col("a").alias("n")))["n"].alias("rep")), f"{name}-map{len(maps)}")
        maps.append(step)
        left = left.join(step.withColumnRenamed("node", "a"), "a").select(F.col("rep").alias("a"), "b")
        left = left.join(step.withColumnRenamed("node", "b"), "b").select("a", F.col("rep").alias("b"))
        left = left.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        left = write_shared(left, f"{name}-left{len(maps)}")
    found = nodes.withColumn("rep", F.col("node"))
    for step in maps:
        found = found.join(step.select(F.col("node").alias("rep"), F.col("rep").alias("up")), "rep", "left").select("node", F.coalesce("up", "rep").alias("rep"))
    smallest = found.groupBy("rep").agg(F.min("node").alias("component"))
    return found.join(smallest, "rep").select("node", "component")

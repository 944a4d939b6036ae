"""Cells packed by groups of loci: a matrix of bytes for each group, with samples in a fixed order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from ..shared import write_shared

__all__ = ["PACKED", "packed", "unpacked"]

PACKED = "part int, loci binary, data binary"
#: Loci that are packed together at most, and cells: many samples make parts of fewer loci.
PACKED_LOCI, PACKED_CELLS = 512, 1 << 22


def packed(cells: DataFrame, samples: list[int], n_loci: int, name: str) -> DataFrame:
    """A table of ``PACKED`` rows from ``cells(locus_idx, sample_idx, value)`` with small whole values; -1 where there is no cell."""
    known = np.array(samples, np.int64)
    together = max(1, min(PACKED_LOCI, PACKED_CELLS // max(1, len(known))))
    part = F.pmod(F.xxhash64("locus_idx"), F.lit(max(1, -(-n_loci // together)))).cast("int")

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        loci, own = np.unique(np.asarray(rows.column("locus_idx")), return_inverse=True)
        matrix = np.full((len(loci), len(known)), -1, np.int8)
        matrix[own, np.searchsorted(known, np.asarray(rows.column("sample_idx")))] = np.asarray(rows.column("value"))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([loci.astype("<i8").tobytes()]), pa.array([matrix.tobytes()])], names=["part", "loci", "data"])

    ship(cells.sparkSession)
    rows = cells.select(part.alias("part"), F.col("locus_idx").cast("long").alias("locus_idx"), "sample_idx", F.col("value").cast("tinyint").alias("value"))
    return write_shared(rows.groupBy("part").applyInArrow(pack, PACKED), name)


def unpacked(batch: pa.RecordBatch, n_samples: int):
    """(loci, matrix) of each row of a batch."""
    for loci, data in zip(batch.column("loci"), batch.column("data"), strict=True):
        yield np.frombuffer(loci.as_py(), "<i8"), np.frombuffer(data.as_py(), np.int8).reshape(-1, n_samples)

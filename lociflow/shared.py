"""Tables in the folder that all executors share: they cut lineage, are the same for all readers, and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .deploy import ship

__all__ = ["drop_folder", "drop_shared", "shared_dir", "write_shared"]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one is set only where a local session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lociflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The table goes when the driver's file system is closed, or with ``drop_shared``.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/lociflow-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    target, files = _path(spark, path)
    files.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_shared(df: DataFrame) -> None:
    """Delete a table of ``write_shared`` that nothing reads any more."""
    drop_folder(df.sparkSession, df._shared_path)


def drop_folder(spark: SparkSession, path: str) -> None:
    target, files = _path(spark, path)
    files.delete(target, True)

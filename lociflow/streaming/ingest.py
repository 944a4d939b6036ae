"""Incremental ingestion: new VCF shards of a folder into a table of calls, exactly once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import _rest, _vcf_call

__all__ = ["ingest_vcf_shards"]


def ingest_vcf_shards(spark: SparkSession, folder: str, target: str, checkpoint: str) -> None:
    """Append (batch, chrom, pos, sample_id, gt) of all records in files that came since the last call, then stop.

    The file source's log in ``checkpoint`` remembers what was read. A file is whole in one batch, so its own header names
    its columns. A batch writes its own folder and writes it anew if it is repeated, so each record is there once.
    """
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", 100).load(folder).select("value", F.col("_metadata.file_path").alias("file"))

    def add(batch: DataFrame, number: int) -> None:
        fields = F.split("value", "\t")
        names = batch.filter(F.col("value").startswith("#CHROM")).select("file", _rest(fields, 10).alias("names"))  # a row a file
        records = batch.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select("file", fields.alias("f")).join(F.broadcast(names), "file")
        f = lambda k: F.get("f", k)
        cell = F.explode(F.arrays_zip("names", _rest(F.col("f"), 10).alias("fields"))).alias("c")
        cells = records.select(f(0).alias("chrom"), f(1).cast("long").alias("pos"), F.upper(f(3)).alias("ref"), F.split(F.upper(f(4)), ",").alias("alt"), f(8).alias("format"), cell)
        token = F.get(F.split("c.fields", ":"), F.array_position(F.split("format", ":"), F.lit("GT")).cast("int") - 1)
        cells.select("chrom", "pos", F.col("c.names").alias("sample_id"), _vcf_call(token).alias("gt")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

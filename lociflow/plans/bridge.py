"""Genotypes made from the test tables: suppliers as samples, regions as populations, parts as loci.

The text runs unchanged in Spark and DuckDB; both sides of a comparison start from it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..genotypes import GenotypeFrame
from ..shared import write_shared

__all__ = ["BRIDGE", "bridge"]

_MASK = "CASE {0} WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 WHEN 'T' THEN 8 END"

#: Common table expressions ``smp``, ``loc`` and ``calls``.
BRIDGE = f"""
WITH smp AS (SELECT s_suppkey AS sample_id, r_name AS population, r_regionkey AS rk
             FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
loc AS (SELECT p_partkey AS locus_id, p_partkey % 10 AS chrom, (p_partkey * 7919) % 5000 + 1 AS pos,
        substr('ACGT', CAST(p_partkey % 4 AS INT) + 1, 1) AS ref,
        substr('ACGT', CAST((p_partkey % 4 + 1 + p_partkey % 3) % 4 AS INT) + 1, 1) AS alt,
        substr('ACGT', CAST((p_partkey % 4 + 1 + (p_partkey + 1) % 3) % 4 AS INT) + 1, 1) AS alt2
        FROM part WHERE p_partkey < 200),
cell AS (SELECT l_suppkey AS sample_id, l_partkey % 200 AS locus_id, CAST(SUM(l_quantity) AS BIGINT) AS q
         FROM lineitem GROUP BY l_suppkey, l_partkey % 200),
lv AS (SELECT c.sample_id, c.locus_id, s.population, c.q, (c.locus_id + s.rk * (c.locus_id % 3)) % 10 AS k,
              (c.q * 37 + c.locus_id * 11 + c.sample_id * 5) % 81 AS t
       FROM cell c JOIN smp s ON c.sample_id = s.sample_id
       WHERE (c.q + c.sample_id) % 20 >= c.locus_id % 7),
dos AS (SELECT sample_id, locus_id, q,
               CASE WHEN t < k * k THEN 2 WHEN t < k * k + 2 * k * (9 - k) THEN 1 ELSE 0 END AS dosage FROM lv),
grid AS (SELECT s.sample_id, s.population, l.locus_id, l.chrom, l.pos, l.ref, d.dosage, d.q,
                CASE WHEN l.locus_id % 17 = 0 AND s.sample_id % 5 = 0 THEN l.alt2 ELSE l.alt END AS own
         FROM smp s CROSS JOIN loc l LEFT JOIN dos d ON d.sample_id = s.sample_id AND d.locus_id = l.locus_id),
pairs AS (SELECT sample_id, population, locus_id, chrom, pos, q,
                 CASE WHEN dosage IS NULL THEN NULL WHEN dosage = 2 THEN own ELSE ref END AS a1,
                 CASE WHEN dosage IS NULL THEN NULL WHEN dosage = 0 THEN ref ELSE own END AS a2 FROM grid),
calls AS (SELECT *, substr('ACMGRSVTWYHKDBN', CAST({_MASK.format("a1")} AS INT) | CAST({_MASK.format("a2")} AS INT), 1) AS gt FROM pairs)
"""

_TABLES = ("supplier", "nation", "region", "part", "lineitem")


def bridge(spark: SparkSession, sf_dir: str) -> GenotypeFrame:
    """The bundle: ``calls`` holds every cell, with total allele depth where there is a call; they are made once, in a table."""
    text = BRIDGE
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES}
    for t in _TABLES:
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ").replace(f"FROM {t}\n", f"FROM {{{t}}}\n")
    read = lambda select: spark.sql(text + select, **{t: tables[t] for t in _TABLES if f"{{{t}}}" in text})
    calls = read("SELECT locus_id AS locus_idx, sample_id AS sample_idx, gt, CASE WHEN gt IS NOT NULL THEN q END AS depth FROM calls")
    loci = read("SELECT locus_id AS locus_idx, CAST(chrom AS STRING) AS chrom, pos, ref, alt, alt2 FROM loc")
    loci = loci.select("locus_idx", "chrom", "pos", "ref", F.when(F.col("locus_idx") % 17 == 0, F.array("alt", "alt2")).otherwise(F.array("alt")).alias("alt"), F.concat_ws(":", "chrom", "pos").alias("marker_name"))
    samples = read("SELECT sample_id AS sample_idx, CAST(sample_id AS STRING) AS sample_id, population FROM smp")
    return GenotypeFrame(write_shared(calls, "bridge"), loci, samples)

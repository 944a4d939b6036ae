"""Registered queries over the genotype bridge of the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import iupac, sequences
from ..operators import encodings, statistics
from .bridge import BRIDGE, bridge

__all__ = ["oracle_sql", "queries"]

_Q: dict = {}
_O: dict = {}

#: Per-locus metrics in SQL.
METRICS = (
    BRIDGE
    + """,
pm AS (SELECT locus_id, population, count(*) AS n, count(gt) AS c, sum(CASE WHEN a1 <> a2 THEN 1 ELSE 0 END) AS h FROM calls GROUP BY 1, 2),
m AS (SELECT locus_id, any_value(chrom) AS chrom, any_value(pos) AS pos, count(*) AS n, count(gt) AS c, sum(CASE WHEN a1 <> a2 THEN 1 ELSE 0 END) AS h, sum(CASE WHEN gt IS NOT NULL THEN q END) AS depth,
"""
    + ",\n".join(f"sum(CASE WHEN a1 = '{b}' THEN 1 ELSE 0 END) + sum(CASE WHEN a2 = '{b}' THEN 1 ELSE 0 END) AS n{b}, sum(CASE WHEN gt = '{b}' THEN 2 ELSE 0 END) AS h{b}" for b in "ACGT")
    + """ FROM calls GROUP BY locus_id),
x AS (SELECT m.*, list_sort([nA, nC, nG, nT])[3] AS second, nA + nC + nG + nT AS total, len(list_filter([nA, nC, nG, nT], lambda v: v > 0)) AS k,
    list_sort([hA, hC, hG, hT])[3] AS hsecond, hA + hC + hG + hT AS htotal, len(list_filter([hA, hC, hG, hT], lambda v: v > 0)) AS hk, pmiss, phet
    FROM m JOIN (SELECT locus_id, max((n - c) / n::DOUBLE) AS pmiss, max(h / n::DOUBLE) AS phet FROM pm GROUP BY 1) USING (locus_id))
"""
)
#: The portable pseudo-random order in SQL.
HASH = "(((({k} * 7919 + {s} * 104729 + 12345) % 2147483647) * (({k} * 7919 + {s} * 104729 + 12345) % 2147483647) + (({k} * 7919 + {s} * 104729 + 12345) % 2147483647)) % 2147483647)"


def _add(name: str, query, sql: str | None = None, base: str = BRIDGE) -> None:
    _Q[name] = query
    if sql is not None:
        _O[name] = base + sql


def _filter(name: str, sql_keep: str, *args, method: str | None = None, **kwargs) -> None:
    """Loci that a filter keeps."""
    _add(
        name,
        lambda s, d: getattr(bridge(s, d), method or name)(*args, **kwargs).loci.select("locus_idx", "chrom", "pos"),
        f"SELECT locus_id AS locus_idx, CAST(chrom AS VARCHAR) AS chrom, pos FROM x WHERE {sql_keep} OR NOT EXISTS (SELECT 1 FROM x WHERE {sql_keep})",
        METRICS,
    )


_filter("filter_missing", "(n - c) / n::DOUBLE <= 0.2", 0.2)
_filter("filter_missing_pop", "pmiss <= 0.3", 0.3)
_filter("filter_het", "h / n::DOUBLE <= 0.3", 0.3)
_filter("filter_het_pop", "phet <= 0.4", 0.4)
_filter("filter_mac", "CASE WHEN k < 2 THEN 0 ELSE second END >= 5", 5)
_filter("filter_mac_homozygous", "CASE WHEN hk < 2 THEN 0 ELSE hsecond END >= 5", 5, True, method="filter_mac")
_filter("filter_maf", "CASE WHEN k < 2 OR total = 0 THEN 0.0 ELSE second / total::DOUBLE END >= 0.05", 0.05)
_filter("filter_monomorphic", "k > 1")
_filter("filter_biallelic", "k = 2")
_filter("filter_biallelic_homozygous", "hk = 2", True, method="filter_biallelic")
_filter("filter_singletons", "NOT (k = 2 AND second = 1)")
_filter("filter_allele_depth", "coalesce(depth, 0) >= 1500", 1500)
_filter("filter_keeps_none", "coalesce(depth, 0) >= 1000000000", 1000000000, method="filter_allele_depth")
_add(
    "filter_missing_sample",
    lambda s, d: bridge(s, d).filter_missing_sample(0.2).samples.select("sample_idx", "population"),
    """, r AS (SELECT sample_id, any_value(population) AS population, (count(*) - count(gt)) / count(*)::DOUBLE AS m FROM calls GROUP BY 1)
    SELECT sample_id AS sample_idx, population FROM r WHERE m <= 0.2 OR NOT EXISTS (SELECT 1 FROM r WHERE m <= 0.2)""",
)


def _chain(s, d):
    return bridge(s, d).filter_missing(0.3).filter_maf(0.05).filter_biallelic().filter_singletons()


_CHAIN = """, s1 AS (SELECT * FROM x WHERE (n - c) / n::DOUBLE <= 0.3), s2 AS (SELECT * FROM s1 WHERE CASE WHEN k < 2 OR total = 0 THEN 0.0 ELSE second / total::DOUBLE END >= 0.05),
s3 AS (SELECT * FROM s2 WHERE k = 2), s4 AS (SELECT * FROM s3 WHERE NOT (k = 2 AND second = 1)),
audit AS (SELECT step, method, threshold, a, b FROM (VALUES (1, 'filter_missing', 0.3, (SELECT count(*) FROM x), (SELECT count(*) FROM s1)), (2, 'filter_maf', 0.05, (SELECT count(*) FROM s1), (SELECT count(*) FROM s2)),
    (3, 'filter_biallelic', NULL, (SELECT count(*) FROM s2), (SELECT count(*) FROM s3)), (4, 'filter_singletons', NULL, (SELECT count(*) FROM s3), (SELECT count(*) FROM s4))) t(step, method, threshold, a, b))
"""
_add(
    "filter_chain_audit",
    lambda s, d: _chain(s, d).audit(),
    _CHAIN + "SELECT step, method AS filter_method, threshold::DOUBLE AS threshold, a - b AS removed_count, round((a - b) / a::DOUBLE, 2) AS removed_prop, b AS kept_count, round(b / a::DOUBLE, 2) AS kept_prop, a AS total_loci FROM audit",
    METRICS,
)
_add(
    "sankey_flows",
    lambda s, d: _chain(s, d).flows(),
    _CHAIN + """SELECT step, source, target, n_loci FROM (SELECT step, coalesce(lag(method) OVER (ORDER BY step), 'Unfiltered') AS source, method, a, b FROM audit)
    CROSS JOIN LATERAL (VALUES (method, b), ('Removed', a - b)) v(target, n_loci)""",
    METRICS,
)
_add("filter_resolve", lambda s, d: _chain(s, d).resolve().calls.groupBy("locus_idx").agg(F.count("gt").alias("n_called")), _CHAIN + "SELECT locus_id AS locus_idx, c AS n_called FROM s4", METRICS)
_add(
    "threshold_search",
    lambda s, d: bridge(s, d).search_thresholds((0.1, 0.2, 0.4), (0.0, 0.05), (2,), ("filter_missing", "filter_maf", "filter_monomorphic")),
    """, g AS (SELECT miss, maf, ex FROM (VALUES (0.1), (0.2), (0.4)) a(miss), (VALUES (0.0), (0.05)) b(maf), (VALUES (true), (false)) c(ex)),
    y AS (SELECT miss, maf, ex, locus_id, (n - c) / n::DOUBLE <= miss AS k1, CASE WHEN ex THEN CASE WHEN hk < 2 OR htotal = 0 THEN 0.0 ELSE hsecond / htotal::DOUBLE END ELSE CASE WHEN k < 2 OR total = 0 THEN 0.0 ELSE second / total::DOUBLE END END >= maf AS k2,
        CASE WHEN ex THEN hk ELSE k END > 1 AS k3 FROM g CROSS JOIN x),
    z AS (SELECT miss, maf, ex, count(*) AS t0, count(*) FILTER (k1) AS t1, count(*) FILTER (k1 AND k2) AS t2, count(*) FILTER (k1 AND k2 AND k3) AS t3 FROM y GROUP BY ALL)
    SELECT miss::DOUBLE AS missing, maf::DOUBLE AS maf, ex AS exclude_het, 2 AS mac, step, method AS filter_method, a - b AS removed_count, b AS kept_count
    FROM z CROSS JOIN LATERAL (VALUES (1, 'filter_missing', t0, t1), (2, 'filter_maf', t1, t2), (3, 'filter_monomorphic', t2, t3)) v(step, method, a, b)""",
    METRICS,
)
_H = HASH.format(k="locus_id", s=7)
_add("filter_linked", lambda s, d: bridge(s, d).filter_linked(7).loci.select("locus_idx", "chrom", "pos"), f"SELECT locus_id AS locus_idx, CAST(chrom AS VARCHAR) AS chrom, pos FROM loc QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY {_H}, locus_id) = 1")
_add("random_subset_loci", lambda s, d: bridge(s, d).random_subset_loci(25, 7).loci.select("locus_idx"), f"SELECT locus_id AS locus_idx FROM loc QUALIFY row_number() OVER (ORDER BY {_H}, locus_id) <= 25")
_GAPS = ", g AS (SELECT *, coalesce(pos - lag(pos) OVER w, 1000000) AS gap, coalesce(lead(pos) OVER w - pos, 1000000) AS after FROM loc WINDOW w AS (PARTITION BY chrom ORDER BY pos, locus_id))"
_add("thin_loci_remove_all", lambda s, d: bridge(s, d).thin_loci(100, remove_all=True).loci.select("locus_idx"), _GAPS + " SELECT locus_id AS locus_idx FROM g WHERE gap > 100 AND after > 100")
_add(
    "thin_loci_clustered",
    lambda s, d: bridge(s, d).thin_loci(100, seed=7).loci.select("locus_idx"),
    _GAPS + f", i AS (SELECT *, sum(CASE WHEN gap > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY pos, locus_id) AS island FROM g) SELECT locus_id AS locus_idx FROM i QUALIFY row_number() OVER (PARTITION BY chrom, island ORDER BY {_H}, locus_id) = 1",
)

# -- summaries ---------------------------------------------------------------------------------------------------------
_RATE = "round((count(*) - count(gt)) / count(*)::DOUBLE, 4) AS missing FROM calls GROUP BY ALL"
_add("missing_per_locus", lambda s, d: statistics.missing_per_locus(bridge(s, d)), f"SELECT locus_id AS locus_idx, {_RATE}")
_add("missing_per_sample", lambda s, d: statistics.missing_per_sample(bridge(s, d)), f"SELECT sample_id AS sample_idx, {_RATE}")
_add("missing_per_pop", lambda s, d: statistics.missing_per_population(bridge(s, d)), f"SELECT population, {_RATE}")
_add("missing_per_pop_locus", lambda s, d: statistics.missing_per_population_locus(bridge(s, d)), f"SELECT population, locus_id AS locus_idx, {_RATE}")
_add(
    "missing_summary",
    lambda s, d: statistics.missing_summary(bridge(s, d), 3),
    """, r AS (SELECT 'locus' AS level, avg((gt IS NULL)::INT) AS m FROM calls GROUP BY locus_id UNION ALL SELECT 'sample', avg((gt IS NULL)::INT) FROM calls GROUP BY sample_id
    UNION ALL SELECT 'population', avg((gt IS NULL)::INT) FROM calls GROUP BY population UNION ALL SELECT 'population_locus', avg((gt IS NULL)::INT) FROM calls GROUP BY population, locus_id)
    SELECT level, round(avg(m), 3) AS mean, round(quantile_cont(m, 0.5), 3) AS median, round(max(m), 3) AS max FROM r GROUP BY level""",
)
_HET = "round(sum(CASE WHEN a1 <> a2 THEN 1 ELSE 0 END) / greatest(count(gt), 1)::DOUBLE, 4) AS het_rate FROM calls GROUP BY ALL"
_add("het_rate_locus", lambda s, d: statistics.het_rate_locus(bridge(s, d)), f"SELECT locus_id AS locus_idx, {_HET}")
_add("het_rate_sample", lambda s, d: statistics.het_rate_sample(bridge(s, d)), f"SELECT sample_id AS sample_idx, {_HET}")
_add("pop_sizes", lambda s, d: statistics.population_sizes(bridge(s, d)), "SELECT population, count(*) AS n_samples FROM smp GROUP BY 1")
_DIV = """, dz AS (SELECT *, CASE WHEN gt IS NULL THEN NULL ELSE (a1 <> ref)::INT + (a2 <> ref)::INT END AS z FROM calls JOIN (SELECT locus_id, ref FROM loc) USING (locus_id)),
dn AS (SELECT {keys}, count(z) AS n, coalesce(sum((z = 1)::INT), 0) AS h, sum(z) AS c FROM dz GROUP BY ALL),
dp AS (SELECT *, c / (2.0 * n)::DOUBLE AS p FROM dn)
SELECT {out}, round(CASE WHEN n > 0 THEN h / n::DOUBLE END, 6) AS ho, round(CASE WHEN n > 0 THEN 2 * p * (1 - p) {zero} END, 6) AS he, round(CASE WHEN n > 1 THEN 2 * p * (1 - p) * n / (n - 1) {zero} END, 6) AS pi FROM dp"""
_rounded = lambda df, *cols: df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])
_add("heterozygosity_overall", lambda s, d: _rounded(statistics.heterozygosity(bridge(s, d)), "ho", "he", "pi"), _DIV.format(keys="locus_id", out="locus_id AS locus_idx", zero=""))
_add("heterozygosity_per_pop", lambda s, d: _rounded(statistics.heterozygosity_per_population(bridge(s, d).filter_maf(0.05)), "ho", "he", "pi"), ", keep AS (SELECT locus_id FROM x WHERE CASE WHEN k < 2 OR total = 0 THEN 0.0 ELSE second / total::DOUBLE END >= 0.05)" + _DIV.format(keys="population, locus_id", out="population, locus_id AS locus_idx", zero="ELSE 0") + " WHERE locus_id IN (SELECT locus_id FROM keep)", METRICS)
_add("genotype_distribution", lambda s, d: statistics.genotype_distribution(bridge(s, d)), "SELECT coalesce(gt, 'N') AS gt, count(*) AS n FROM calls GROUP BY 1")
_PAIRS = ", ".join(f"round({f}, 6) AS {c}_{n}" for c in ("missing", "ho", "he", "effective", "fis", "maf") for n, f in (("mean", f"avg({c})"), ("median", f"quantile_cont({c}, 0.5)")))
_add(
    "allele_summary",
    lambda s, d: statistics.allele_summary(bridge(s, d)),
    f""", y AS (SELECT *, (n - c) / n::DOUBLE AS missing, CASE WHEN c > 0 THEN h / c::DOUBLE END AS ho, greatest(nA, nC, nG, nT) AS most,
        CASE WHEN total > 0 THEN (nA * nA + nC * nC + nG * nG + nT * nT) / (total * total)::DOUBLE END AS squares FROM x),
    z AS (SELECT *, 1 - squares AS he, 1 / squares AS effective, CASE WHEN total > 0 THEN (total - most) / total::DOUBLE END AS maf FROM y),
    w AS (SELECT *, CASE WHEN he > 0 THEN 1 - ho / he WHEN he = 0 THEN 0 END AS fis FROM z),
    sm AS (SELECT sample_id, (count(*) - count(gt)) / count(*)::DOUBLE AS m, sum(CASE WHEN a1 <> a2 THEN 1 ELSE 0 END) / greatest(count(gt), 1)::DOUBLE AS h FROM calls GROUP BY 1)
    SELECT * FROM (SELECT count(*) AS n_loci, {_PAIRS}, round(quantile_cont(missing, 0.25), 6) AS missing_q1, round(quantile_cont(missing, 0.75), 6) AS missing_q3,
        count(*) FILTER (k = 1) AS monomorphic, count(*) FILTER (k = 2) AS biallelic, count(*) FILTER (k = 3) AS triallelic, count(*) FILTER (k = 4) AS quadriallelic, round(avg(k), 6) AS richness_mean,
        round(avg((k = 2 AND second = 1)::INT), 6) AS singleton_share, round(avg((maf < 0.01)::INT), 6) AS maf_below_1, round(avg((maf < 0.05)::INT), 6) AS maf_below_5, round(avg((maf < 0.1)::INT), 6) AS maf_below_10 FROM w),
    (SELECT count(*) AS n_samples, round(avg(m), 6) AS sample_missing_mean, round(quantile_cont(m, 0.5), 6) AS sample_missing_median, round(avg(h), 6) AS sample_het_mean, round(quantile_cont(h, 0.5), 6) AS sample_het_median FROM sm)""",
    METRICS,
)

# -- encodings ---------------------------------------------------------------------------------------------------------
_CELL = "SELECT locus_id AS locus_idx, sample_id AS sample_idx"
_add("encode_012", lambda s, d: encodings.encode_012(bridge(s, d)), f"{_CELL}, CASE WHEN gt IS NULL THEN NULL ELSE (a1 <> ref)::INT + (a2 <> ref)::INT END AS dosage FROM calls JOIN (SELECT locus_id, ref FROM loc) USING (locus_id)")
_add(
    "decode_012",
    lambda s, d: encodings.decode_012(encodings.encode_012(bridge(s, d)), bridge(s, d).loci),
    f""", t AS (SELECT c.*, l.ref, l.alt, CASE WHEN gt IS NULL THEN NULL ELSE (a1 <> ref)::INT + (a2 <> ref)::INT END AS z FROM calls c JOIN loc l USING (locus_id)),
    mk AS (SELECT *, (CASE ref WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 ELSE 8 END) | (CASE alt WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 ELSE 8 END) AS b FROM t)
    {_CELL}, CASE z WHEN 0 THEN ref WHEN 1 THEN substr('ACMGRSVTWYHKDBN', b, 1) WHEN 2 THEN alt ELSE 'N' END AS gt FROM mk""",
)
_add(
    "encode_onehot",
    lambda s, d: encodings.encode_onehot(bridge(s, d), 0.5).select("locus_idx", "sample_idx", *[F.element_at("onehot", k).alias(f"w{b}") for k, b in enumerate("ACGT", 1)]),
    f"{_CELL}, " + ", ".join(f"CASE WHEN gt = '{b}' THEN 1.0 WHEN a1 = '{b}' OR a2 = '{b}' THEN 0.5 ELSE 0.0 END::DOUBLE AS w{b}" for b in "ACGT") + " FROM calls",
)
_add("encode_int", lambda s, d: encodings.encode_int(bridge(s, d)), f"{_CELL}, CASE coalesce(gt, 'N') " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in iupac.INT_CODES.items()) + " ELSE -9 END AS code FROM calls")
_CH = "CASE {0} WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE -1 END"
_add("two_channel", lambda s, d: encodings.two_channel(bridge(s, d)), f"{_CELL}, least({_CH.format('a1')}, {_CH.format('a2')}) AS a1, greatest({_CH.format('a1')}, {_CH.format('a2')}) AS a2 FROM calls")
_COPIES = """, b AS (SELECT locus_id, unnest(list_distinct([a1, a2])) AS base, a1 = a2 AS hom FROM calls WHERE gt IS NOT NULL),
g AS (SELECT locus_id, base, sum(CASE WHEN hom THEN 2 ELSE 1 END) AS copies, sum((NOT hom)::INT) AS het, count(*) FILTER (hom) AS homs FROM b GROUP BY 1, 2)"""
_add(
    "ref_alt_inference",
    lambda s, d: encodings.reference_alleles(bridge(s, d)).select("locus_idx", "ref", F.array_join("alt", ",").alias("alt")),
    _COPIES + ", r AS (SELECT *, row_number() OVER (PARTITION BY locus_id ORDER BY copies DESC, het, base) AS r FROM g) SELECT locus_id AS locus_idx, max(base) FILTER (r = 1) AS ref, coalesce(string_agg(base, ',' ORDER BY r) FILTER (r > 1), '') AS alt FROM r GROUP BY 1",
)
_add(
    "ref_alt_homozygous",
    lambda s, d: encodings.reference_alleles_by_homozygotes(bridge(s, d)).select("locus_idx", "ref", F.array_join("alt", ",").alias("alt")),
    _COPIES + ", r AS (SELECT *, row_number() OVER (PARTITION BY locus_id ORDER BY homs DESC, base) AS r FROM g WHERE homs > 0) SELECT loc.locus_id AS locus_idx, coalesce(max(base) FILTER (r = 1), 'N') AS ref, coalesce(string_agg(base, ',' ORDER BY r) FILTER (r > 1), '.') AS alt FROM loc LEFT JOIN r USING (locus_id) GROUP BY 1",
)
_add(
    "observed_bases",
    lambda s, d: encodings.observed_bases(bridge(s, d)),
    _COPIES + " SELECT locus_id AS locus_idx, string_agg(base, '' ORDER BY base) AS bases, count(*) = 2 AS biallelic, count(*) FILTER (homs > 0) = 2 AS biallelic_by_homozygotes, count(*) > 2 AS multiallelic FROM g GROUP BY 1",
)

# -- text --------------------------------------------------------------------------------------------------------------
_docs = lambda s, d: s.read.parquet(f"{d}/documents.parquet")
_add("seq_counter", lambda s, d: _docs(s, d).select("doc_id", *[c.cast("int").alias("gap" if k == "-" else f"n_{k}") for k, c in sequences.sequence_counts(F.col("text")).items()]), "SELECT doc_id, " + ", ".join(f"(length(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) - length(replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '{k}', '')))::INT AS {'gap' if k == '-' else 'n_' + k}" for k in "ACGTN-RYSWKMBDHV") + ", (length(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) - length(translate(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 'RYSWKMBDHV', '')))::INT AS n_VAR FROM documents", "")
_add("simplify_seq", lambda s, d: _docs(s, d).select("doc_id", F.md5(sequences.simplify(F.col("text"))).alias("digest")), "SELECT doc_id, md5(translate(regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[ACGT]', '', 'g'), 'RYSWKMBDHV', '**********')) AS digest FROM documents", "")
_add("rev_comp", lambda s, d: _docs(s, d).select("doc_id", F.md5(iupac.complement(F.col("text"))).alias("digest")), "SELECT doc_id, md5(translate(text, 'ACGTRYKMBVDHacgtrykmbvdh', 'TGCAYRMKVBHDtgcayrmkvbhd')) AS digest FROM documents", "")


def queries() -> dict:
    from . import files, genomics_more  # noqa: F401

    return dict(_Q)


def oracle_sql() -> dict:
    from . import files, genomics_more  # noqa: F401

    return dict(_O)

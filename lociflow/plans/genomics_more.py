"""Queries of distances, introgression, linkage, outliers and ordination."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..genotypes import portable_hash
from ..functions.two_locus import sql_terms as two_locus_sql
from ..operators import distances, encodings, introgression, linkage, outliers, resampling, statistics
from .bridge import bridge
from .genomics import HASH, _add, _rounded

_STEP = 1_000_003


def _hash(key: str, seed: int) -> str:
    return HASH.format(k=f"({key})", s=seed)


# -- Fst and Nei -------------------------------------------------------------------------------------------------------
#: Side-by-side counts ``pp(keys.., pop1, pop2, locus_id, n1, n2, cA1, .., hT2)`` from ``cells(keys.., side pair..)``.
_COUNTS = ", ".join(f"sum((a1 = '{b}')::INT + (a2 = '{b}')::INT) AS c{b}, sum((a1 <> a2 AND (a1 = '{b}' OR a2 = '{b}'))::INT) AS h{b}" for b in "ACGT")
_SIDES = ", ".join(f"coalesce(x1.{v}, 0)::DOUBLE AS {v}1, coalesce(x2.{v}, 0)::DOUBLE AS {v}2" for v in ["n", *(f"{x}{b}" for b in "ACGT" for x in "ch")])
_PP = f""", pa AS (SELECT population, locus_id, count(*) AS n, {_COUNTS} FROM calls WHERE gt IS NOT NULL GROUP BY 1, 2),
pops AS (SELECT a.population AS pop1, b.population AS pop2 FROM (SELECT DISTINCT population FROM smp) a JOIN (SELECT DISTINCT population FROM smp) b ON a.population < b.population),
pp AS (SELECT pop1, pop2, l.locus_id, {_SIDES} FROM (SELECT DISTINCT locus_id FROM pa) l CROSS JOIN pops LEFT JOIN pa x1 ON x1.population = pop1 AND x1.locus_id = l.locus_id LEFT JOIN pa x2 ON x2.population = pop2 AND x2.locus_id = l.locus_id)"""


def _wc(table: str, keys: str) -> str:
    """Components ``wc(keys.., a, b, c)`` of rows of ``table``."""
    alleles = " UNION ALL ".join(f"SELECT {keys}, n1, n2, c{b}1 AS c1, c{b}2 AS c2, h{b}1 AS h1, h{b}2 AS h2 FROM {table}" for b in "ACGT")
    return f""", al AS ({alleles}),
    al2 AS (SELECT *, n1 + n2 AS nt, n1 + n2 - (n1 * n1 + n2 * n2) / (n1 + n2) AS nc, c1 / (2 * n1) AS p1, c2 / (2 * n2) AS p2, (c1 - h1) / 2 AS m1, (c2 - h2) / 2 AS m2 FROM al),
    al3 AS (SELECT *, (n1 * p1 + n2 * p2) / nt AS pbar, (n1 * p1 - m1 + n2 * p2 - m2) / nt AS msg, (n1 * (p1 - 2 * p1 * p1) + m1 + n2 * (p2 - 2 * p2 * p2) + m2) / (nt - 2) AS msi FROM al2 WHERE n1 > 0 AND n2 > 0 AND nt > 2 AND nc > 0),
    al4 AS (SELECT *, 2 * (n1 * (p1 - pbar) * (p1 - pbar) + n2 * (p2 - pbar) * (p2 - pbar)) AS msp, c1 + c2 > 0 AS seen FROM al3),
    wc AS (SELECT {keys}, CASE WHEN count(*) FILTER (seen) < 2 THEN 0.0 ELSE sum((msp - msi) / (2 * nc)) FILTER (seen) END AS a, CASE WHEN count(*) FILTER (seen) < 2 THEN 0.0 ELSE sum((msi - msg) / 2) FILTER (seen) END AS b,
        CASE WHEN count(*) FILTER (seen) < 2 THEN 0.0 ELSE sum(msg) FILTER (seen) END AS c FROM al4 GROUP BY ALL)"""


_WC = _PP + _wc("pp", "pop1, pop2, locus_id")
_FST = "CASE WHEN sum(a + b + c) = 0 THEN 0.0 ELSE sum(a) / sum(a + b + c) END"
_add("fst_components_per_locus", lambda s, d: _rounded(distances.fst_components(bridge(s, d)), "a", "b", "c"), _WC + " SELECT pop1, pop2, pp.locus_id AS locus_idx, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(c, 6) + 0.0 AS c FROM pp LEFT JOIN wc USING (pop1, pop2, locus_id)")
_add("fst_observed", lambda s, d: _rounded(distances.fst_observed(bridge(s, d)), "fst"), _WC + f" SELECT pop1, pop2, round({_FST}, 6) AS fst FROM wc GROUP BY 1, 2")
_add(
    "fst_symmetric_table",
    lambda s, d: _rounded(distances.symmetric_table(distances.fst_observed(bridge(s, d)), "fst"), "fst"),
    _WC + f", f AS (SELECT pop1, pop2, {_FST} AS fst FROM wc GROUP BY 1, 2) SELECT pop1, pop2, round(fst, 6) AS fst FROM f UNION ALL SELECT pop2, pop1, round(fst, 6) FROM f UNION ALL SELECT DISTINCT population, population, 0.0 FROM smp",
)
_add("fst_per_locus", lambda s, d: _rounded(distances.per_locus_fst(bridge(s, d)), "fst"), _WC + " SELECT pop1, pop2, pp.locus_id AS locus_idx, round(CASE WHEN a + b + c <> 0 THEN a / (a + b + c) END, 6) + 0.0 AS fst FROM pp LEFT JOIN wc USING (pop1, pop2, locus_id)")
_REPS = 20
_DRAWS = f", w AS (SELECT r AS rep, {_hash(f'r * {_STEP} + j', 5)} % 200 AS slot, count(*) AS w FROM range({_REPS}) x(r), range(200) y(j) GROUP BY 1, 2)"
_add(
    "fst_bootstrap_ci",
    lambda s, d: _rounded(distances.fst_bootstrap(bridge(s, d), _REPS, 5), "lower", "upper"),
    _WC + _DRAWS + ", b AS (SELECT pop1, pop2, rep, CASE WHEN sum(w * (a + b + c)) = 0 THEN 0.0 ELSE sum(w * a) / sum(w * (a + b + c)) END AS fst FROM wc JOIN w ON slot = locus_id GROUP BY 1, 2, 3) SELECT pop1, pop2, round(quantile_cont(fst, 0.025), 6) AS lower, round(quantile_cont(fst, 0.975), 6) AS upper FROM b GROUP BY 1, 2",
)
_PREPS = 9


def _labels(reps: int, seed: int) -> str:
    return f""", ps AS (SELECT pop1, pop2, sample_id, population FROM pops JOIN smp ON population IN (pop1, pop2)),
ranked AS (SELECT pop1, pop2, r AS rep, sample_id, population, row_number() OVER (PARTITION BY pop1, pop2, r ORDER BY population, sample_id) AS own, row_number() OVER (PARTITION BY pop1, pop2, r ORDER BY {_hash(f'r * {_STEP} + sample_id', seed)}, sample_id) AS nw FROM ps CROSS JOIN range({reps}) x(r)),
lab AS (SELECT a.pop1, a.pop2, a.rep, a.sample_id, CASE WHEN b.population = a.pop1 THEN 1 ELSE 2 END AS side FROM ranked a JOIN ranked b ON a.pop1 = b.pop1 AND a.pop2 = b.pop2 AND a.rep = b.rep AND a.nw = b.own),
sd AS (SELECT pop1, pop2, rep, locus_id, side, count(*) AS n, {_COUNTS} FROM calls JOIN lab USING (sample_id) WHERE gt IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
pq AS (SELECT pop1, pop2, rep, locus_id, {", ".join(f"coalesce(sum({v}) FILTER (side = {k}), 0)::DOUBLE AS {v}{k}" for v in ["n", *(f"{x}{b}" for b in "ACGT" for x in "ch")] for k in (1, 2))} FROM sd GROUP BY 1, 2, 3, 4)"""


_LABELS = _labels(_PREPS, 3)
_WCP = _wc("pq", "pop1, pop2, rep, locus_id").replace("al AS", "bl AS").replace("FROM al)", "FROM bl)").replace("al2", "bl2").replace("al3", "bl3").replace("al4", "bl4").replace("wc AS", "wcp AS")
_add(
    "fst_permutation_p",
    lambda s, d: _rounded(distances.fst_permutation(bridge(s, d), _PREPS, 3), "fst", "p"),
    _WC + _LABELS + _WCP + f", o AS (SELECT pop1, pop2, {_FST} AS fst FROM wc GROUP BY 1, 2), q AS (SELECT pop1, pop2, rep, {_FST} AS f FROM wcp GROUP BY 1, 2, 3) SELECT pop1, pop2, round(fst, 6) AS fst, round((count(*) FILTER (f >= fst - 1e-12) + 1) / (count(f) + 1)::DOUBLE, 6) AS p FROM o JOIN q USING (pop1, pop2) GROUP BY pop1, pop2, fst",
)
_J = lambda i, j: " + ".join(f"c{b}{i} / (2 * n{i}) * c{b}{j} / (2 * n{j})" for b in "ACGT")
_NEI = _PP + f", nj AS (SELECT pop1, pop2, locus_id, {_J(1, 2)} AS jxy, {_J(1, 1)} AS jx, {_J(2, 2)} AS jy FROM pp WHERE n1 > 0 AND n2 > 0)"
_ID = "-ln(least(sum({w} * jxy) / sqrt(sum({w} * jx) * sum({w} * jy)), 1.0))"
_add("nei_observed", lambda s, d: _rounded(distances.nei_observed(bridge(s, d)), "nei"), _NEI + f" SELECT pop1, pop2, round({_ID.format(w=1)}, 6) + 0.0 AS nei FROM nj GROUP BY 1, 2")
_add(
    "nei_bootstrap_ci",
    lambda s, d: _rounded(distances.nei_bootstrap(bridge(s, d), _REPS, 5), "lower", "upper"),
    _NEI + _DRAWS + f", b AS (SELECT pop1, pop2, rep, {_ID.format(w='w')} AS nei FROM nj JOIN w ON slot = locus_id GROUP BY 1, 2, 3) SELECT pop1, pop2, round(quantile_cont(nei, 0.025), 6) AS lower, round(quantile_cont(nei, 0.975), 6) AS upper FROM b GROUP BY 1, 2",
)
_add(
    "nei_permutation_p",
    lambda s, d: _rounded(distances.nei_permutation(bridge(s, d), _PREPS, 3), "nei", "p"),
    _NEI + _LABELS + f""", nq AS (SELECT pop1, pop2, rep, {_J(1, 2)} AS jxy, {_J(1, 1)} AS jx, {_J(2, 2)} AS jy FROM pq WHERE n1 > 0 AND n2 > 0),
    o AS (SELECT pop1, pop2, {_ID.format(w=1)} AS nei FROM nj GROUP BY 1, 2), q AS (SELECT pop1, pop2, rep, {_ID.format(w=1)} AS f FROM nq GROUP BY 1, 2, 3)
    SELECT pop1, pop2, round(nei, 6) + 0.0 AS nei, round((count(*) FILTER (f >= nei - 1e-12) + 1) / (count(f) + 1)::DOUBLE, 6) AS p FROM o JOIN q USING (pop1, pop2) GROUP BY pop1, pop2, nei""",
)

# -- AMOVA -------------------------------------------------------------------------------------------------------------
_REGIONS = {"AFRICA": "south", "AMERICA": "west", "ASIA": "east", "EUROPE": "west", "MIDDLE EAST": "south"}


def _regions(s):
    return s.createDataFrame(list(_REGIONS.items()), "population string, region string")


_M = "(CASE {0} WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 WHEN 'T' THEN 8 END)"
_AMOVA = f""", rg(population, region) AS (VALUES {", ".join(map(str, _REGIONS.items()))}),
cc AS (SELECT locus_id, region, population, {_M.format("a1")} | {_M.format("a2")} AS m FROM calls JOIN rg USING (population) WHERE gt IS NOT NULL),
""" + ", ".join(
    f"""{n}c AS (SELECT locus_id, {k} m, count(*) AS n FROM cc GROUP BY ALL), {n}p AS (SELECT x.locus_id, {", ".join(f"x.{v}" for v in k.replace(" ", "").split(",") if v)}{"," if k else ""} sum(x.n * y.n) AS s FROM {n}c x JOIN {n}c y USING (locus_id{"".join(f", {v}" for v in k.replace(" ", "").split(",") if v)}) WHERE x.m < y.m AND (x.m & y.m) = 0 GROUP BY ALL),
{n} AS (SELECT g.*, coalesce(2.0 * s, 0)::DOUBLE AS s2, CASE WHEN size > 1 THEN coalesce(2.0 * s, 0)::DOUBLE / (size * (size - 1)) ELSE 0 END AS mean FROM (SELECT locus_id, {k} sum(n)::DOUBLE AS size FROM {n}c GROUP BY ALL) g LEFT JOIN {n}p USING (locus_id{"".join(f", {v}" for v in k.replace(" ", "").split(",") if v)}))"""
    for n, k in (("t", ""), ("r", "region,"), ("p", "region, population,"))
) + """, br AS (SELECT locus_id, count(*) AS nr, sum(r.size * (r.mean - t.mean) ** 2) AS ssr FROM r JOIN t USING (locus_id) GROUP BY 1),
bp AS (SELECT locus_id, count(*) AS np, sum(p.size * (p.mean - r.mean) ** 2) AS ssp, sum(p.s2 - p.s2 * p.s2 / (p.size * p.size)) AS ssw FROM p JOIN r USING (locus_id, region) GROUP BY 1),
ss AS (SELECT sum(ssr) AS ssr, sum(ssp) AS ssp, sum(ssw) AS ssw, sum(nr - 1) AS dfr, sum(np - nr) AS dfp, sum(t.size - np) AS dfw FROM t JOIN br USING (locus_id) JOIN bp USING (locus_id)),
sz AS (SELECT region, population, count(*)::DOUBLE AS n FROM smp JOIN rg USING (population) GROUP BY 1, 2),
nc AS (SELECT (sum(n) - (SELECT sum(v * v) FROM (SELECT sum(n) AS v FROM sz GROUP BY region)) / sum(n)) / (count(DISTINCT region) - 1) AS ncr, (sum(n) - sum(n * n) / sum(n)) / (count(*) - count(DISTINCT region)) AS ncp FROM sz),
sg AS (SELECT *, greatest((ssr / dfr - ssp / dfp) / ncr, 0) AS vr, greatest((ssp / dfp - ssw / dfw) / ncp, 0) AS vp, greatest(ssw / dfw, 0) AS vw FROM ss, nc)
"""
_add(
    "amova_components",
    lambda s, d: _rounded(distances.amova(bridge(s, d), _regions(s)), "ssr", "ssp", "ssw", "sigma_r", "sigma_p", "sigma_w", "phi_rt", "phi_pr", "phi_pt").select("*", *[]),
    _AMOVA + "SELECT round(ssr, 6) AS ssr, round(ssp, 6) AS ssp, round(ssw, 6) AS ssw, dfr::BIGINT AS dfr, dfp::BIGINT AS dfp, dfw::BIGINT AS dfw, round(vr, 6) AS sigma_r, round(vp, 6) AS sigma_p, round(vw, 6) AS sigma_w, round(vr / (vr + vp + vw), 6) AS phi_rt, round(vp / (vp + vw), 6) AS phi_pr, round((vr + vp) / (vr + vp + vw), 6) AS phi_pt FROM sg",
)
_PHI = "{vr} / ({vr} + {vp} + {vw}) AS {x}phi_rt, {vp} / ({vp} + {vw}) AS {x}phi_pr, ({vr} + {vp}) / ({vr} + {vp} + {vw}) AS {x}phi_pt"
_add(
    "amova_bootstrap",
    lambda s, d: _rounded(distances.amova_bootstrap(bridge(s, d), _regions(s), _REPS, 5), *(f"{x}phi_{y}" for x in ("", "p_") for y in ("rt", "pr", "pt"))),
    _AMOVA + _DRAWS + f""", rw AS (SELECT rep, {", ".join(f"sum(w * {x}) AS {y}" for x, y in (("ssr", "ssr"), ("ssp", "ssp"), ("ssw", "ssw"), ("(nr - 1)", "dfr"), ("(np - nr)", "dfp"), ("(t.size - np)", "dfw")))}
    FROM t JOIN br USING (locus_id) JOIN bp USING (locus_id) JOIN w ON slot = locus_id GROUP BY 1),
    rs AS (SELECT greatest((ssr / dfr - ssp / dfp) / ncr, 0) AS vr, greatest((ssp / dfp - ssw / dfw) / ncp, 0) AS vp, greatest(ssw / dfw, 0) AS vw FROM rw, nc),
    rq AS (SELECT {_PHI.format(vr="vr", vp="vp", vw="vw", x="b_")} FROM rs), ob AS (SELECT {_PHI.format(vr="vr", vp="vp", vw="vw", x="")} FROM sg)
    SELECT {", ".join(f"round(phi_{y}, 6) AS phi_{y}, round(greatest(0.0001, least(0.9999, (count(*) FILTER (b_phi_{y} >= phi_{y}) + 1) / (count(b_phi_{y}) + 1)::DOUBLE)), 6) AS p_phi_{y}" for y in ("rt", "pr", "pt"))}
    FROM rq, ob GROUP BY phi_rt, phi_pr, phi_pt""",
)

# -- D statistics ------------------------------------------------------------------------------------------------------
_FOUR = ["AFRICA", "AMERICA", "ASIA", "MIDDLE EAST"]
_FIVE = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def _freq(roles: list[str]) -> str:
    n = len(roles)
    return f""", dz AS (SELECT population, locus_id, CASE WHEN gt IS NULL THEN NULL ELSE (a1 <> ref)::INT + (a2 <> ref)::INT END AS z FROM calls JOIN (SELECT locus_id, ref FROM loc) USING (locus_id)),
    rm AS (SELECT locus_id, {", ".join(f"avg(z) FILTER (population = '{r}') / 2 AS m{k}" for k, r in enumerate(roles))} FROM dz GROUP BY 1),
    rf AS (SELECT locus_id, {", ".join(f"CASE WHEN m{n - 1} > 0.5 THEN 1 - m{k} ELSE m{k} END AS p{k}" for k in range(n))} FROM rm WHERE {" AND ".join(f"m{k} IS NOT NULL" for k in range(n))} AND abs(m{n - 1} - 0.5) > 1e-12)"""


def _pattern(text: str) -> str:
    return " * ".join(f"p{k}" if c == "B" else f"(1 - p{k})" for k, c in enumerate(text))


def _sides(method: str) -> str:
    return ", ".join(f"{' + '.join(map(_pattern, patterns))} AS {side}_{name}" for name, both in introgression.METHODS[method].items() for side, patterns in zip("lr", both, strict=True))


def _values(method: str) -> str:
    return ", ".join(f"round((sum(l_{n}) - sum(r_{n})) / nullif(sum(l_{n}) + sum(r_{n}), 0), 6) AS {n}" for n in introgression.METHODS[method])


for _name, _method, _roles in (("patterson_d", "patterson", _FOUR), ("partitioned_d", "partitioned", _FIVE), ("dfoil", "dfoil", _FIVE)):
    _add(_name, lambda s, d, m=_method, r=_roles: _rounded(introgression.d_statistics(bridge(s, d), r, m), *introgression.METHODS[m]), _freq(_roles) + f", sp AS (SELECT {_sides(_method)} FROM rf) SELECT count(*) AS n_sites, {_values(_method)} FROM sp")
_add(
    "dstat_per_combination",
    lambda s, d: _rounded(introgression.d_per_combination(bridge(s, d), _FOUR, "patterson", 2), "D"),
    f""", ms AS (SELECT population, sample_id, count(*) - count(gt) AS n_missing FROM calls GROUP BY 1, 2), ch AS (SELECT * FROM ms QUALIFY row_number() OVER (PARTITION BY population ORDER BY n_missing, sample_id) <= 2),
    dz AS (SELECT c.population, c.sample_id, c.locus_id, ((a1 <> ref)::INT + (a2 <> ref)::INT) / 2.0::DOUBLE AS z FROM calls c JOIN (SELECT locus_id, ref FROM loc) USING (locus_id) JOIN ch ON ch.sample_id = c.sample_id WHERE gt IS NOT NULL),
    q AS (SELECT a.locus_id, a.sample_id AS s0, b.sample_id AS s1, c.sample_id AS s2, o.sample_id AS s3, a.z AS m0, b.z AS m1, c.z AS m2, o.z AS m3 FROM dz a JOIN dz b USING (locus_id) JOIN dz c USING (locus_id) JOIN dz o USING (locus_id)
        WHERE a.population = '{_FOUR[0]}' AND b.population = '{_FOUR[1]}' AND c.population = '{_FOUR[2]}' AND o.population = '{_FOUR[3]}' AND o.z <> 0.5),
    rf AS (SELECT s0, s1, s2, s3, {", ".join(f"CASE WHEN m3 > 0.5 THEN 1 - m{k} ELSE m{k} END AS p{k}" for k in range(4))} FROM q), sp AS (SELECT s0, s1, s2, s3, {_sides("patterson")} FROM rf)
    SELECT concat_ws('-', s0, s1, s2, s3) AS combination, count(*) AS n_sites, {_values("patterson")} FROM sp GROUP BY s0, s1, s2, s3""",
)
_add(
    "dstat_jackknife",
    lambda s, d: _rounded(introgression.d_jackknife(bridge(s, d), _FOUR, "patterson", 20), "value", "se", "z"),
    _freq(_FOUR) + f""", sp AS (SELECT (row_number() OVER (ORDER BY locus_id) - 1) // 20 AS blk, count(*) OVER () AS n, {_sides("patterson")} FROM rf), b AS (SELECT blk, sum(l_D) AS l, sum(r_D) AS r FROM sp WHERE blk < n // 20 GROUP BY 1),
    t AS (SELECT sum(l) AS tl, sum(r) AS tr FROM b), j AS (SELECT ((tl - l) - (tr - r)) / ((tl - l) + (tr - r)) AS v FROM b, t), e AS (SELECT sqrt((count(*) - 1) * (count(*) - 1) / count(*)::DOUBLE) * stddev_samp(v) AS se FROM j)
    SELECT 'D' AS statistic, round((tl - tr) / (tl + tr), 6) AS value, round(se, 6) AS se, round((tl - tr) / (tl + tr) / se, 6) AS z FROM t, e""",
)
_DFOIL = list(introgression.METHODS["dfoil"])
_SIGNIFICANT = lambda s, d: introgression.d_significance(bridge(s, d), _FIVE, "dfoil", _REPS, 5)
_add(
    "dstat_bootstrap",
    lambda s, d: _rounded(_SIGNIFICANT(s, d).select("statistic", "value", "std", "z", "chi2"), "value", "std", "z", "chi2"),
    _freq(_FIVE) + f""", sp AS (SELECT row_number() OVER (ORDER BY locus_id) - 1 AS slot, count(*) OVER () AS n, {_sides("dfoil")} FROM rf),
    dr AS (SELECT r AS rep, {_hash(f'r * {_STEP} + j', 5)} % n AS slot, count(*) AS w FROM range({_REPS}) x(r), (SELECT DISTINCT n FROM sp), LATERAL (SELECT unnest(range(n)) AS j) GROUP BY 1, 2),
    rv AS (SELECT {", ".join(f"(sum(w * l_{n}) - sum(w * r_{n})) / nullif(sum(w * l_{n}) + sum(w * r_{n}), 0) AS {n}" for n in _DFOIL)} FROM sp JOIN dr USING (slot) GROUP BY rep),
    ob AS (SELECT {", ".join(f"(sum(l_{n}) - sum(r_{n})) / nullif(sum(l_{n}) + sum(r_{n}), 0) AS {n}" for n in _DFOIL)} FROM sp),
    lg AS ({" UNION ALL ".join(f"SELECT '{n}' AS statistic, (SELECT {n} FROM ob) AS value, (SELECT stddev_samp({n}) FROM rv) AS std" for n in _DFOIL)})
    SELECT statistic, round(value, 6) AS value, round(std, 6) AS std, round(CASE WHEN std > 1e-12 THEN value / std END, 6) AS z, round(CASE WHEN std > 1e-12 THEN (value / std) * (value / std) END, 6) AS chi2 FROM lg""",
)
# DuckDB has no error function; tests hold the p-values against Python's.
_add("dstat_significance", _SIGNIFICANT)
_add(
    "least_missing_samples",
    lambda s, d: introgression.least_missing_samples(bridge(s, d), 3),
    "SELECT population, sample_id AS sample_idx, n_missing, rank FROM (SELECT *, (row_number() OVER (PARTITION BY population ORDER BY n_missing, sample_id))::INT AS rank FROM (SELECT population, sample_id, count(*) - count(gt) AS n_missing FROM calls GROUP BY 1, 2)) WHERE rank <= 3",
)


def _pvalues(s, d):
    return bridge(s, d).loci.select("locus_idx", (F.pow(portable_hash(F.col("locus_idx"), 11) / 2147483647.0, 3.0)).alias("p"))


_P = f", pv AS (SELECT locus_id AS locus_idx, ({_hash('locus_id', 11)} / 2147483647.0::DOUBLE) ** 3 AS p FROM loc)"
_BH = _P + ", bh AS (SELECT *, least(1.0, min(p * n / r) OVER (ORDER BY p DESC)) AS q FROM (SELECT *, count(*) OVER () AS n, count(*) OVER () - rank() OVER (ORDER BY p DESC) + 1 AS r FROM pv))"
_add("bh_correction", lambda s, d: _rounded(resampling.adjust_pvalues(_pvalues(s, d), "p", "fdr_bh"), "p", "p_adj"), _BH + " SELECT locus_idx, round(p, 6) AS p, round(q, 6) AS p_adj FROM bh")
_add("holm_correction", lambda s, d: _rounded(resampling.adjust_pvalues(_pvalues(s, d), "p", "holm"), "p", "p_adj"), _P + " SELECT locus_idx, round(p, 6) AS p, round(least(1.0, max(x) OVER (ORDER BY p)), 6) AS p_adj FROM (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p) + 1) AS x FROM pv)")
_add("bonferroni_correction", lambda s, d: _rounded(resampling.adjust_pvalues(_pvalues(s, d), "p", "bonferroni"), "p", "p_adj"), _P + " SELECT locus_idx, round(p, 6) AS p, round(least(1.0, p * count(*) OVER ()), 6) AS p_adj FROM pv")
_add(
    "significance_counts",
    lambda s, d: introgression.significance_counts(resampling.adjust_pvalues(resampling.adjust_pvalues(_pvalues(s, d), "p", "bonferroni").withColumnRenamed("p_adj", "p_bonferroni"), "p", "fdr_bh").withColumnRenamed("p_adj", "p_fdr")),
    _BH + " SELECT CASE WHEN p * n < 0.05 THEN 'Bonferroni' WHEN q < 0.05 THEN 'FDR' WHEN p < 0.05 THEN 'Raw' ELSE 'NS' END AS category, count(*) AS n FROM bh GROUP BY 1",
)

# -- linkage -----------------------------------------------------------------------------------------------------------
_LD = f""", zz AS (SELECT c.sample_id, c.locus_id, l.chrom AS grp, (a1 <> l.ref)::INT + (a2 <> l.ref)::INT AS z FROM calls c JOIN loc l USING (locus_id) WHERE population = 'AMERICA' AND gt IS NOT NULL AND c.locus_id % 17 <> 0),
ok AS (SELECT locus_id FROM zz GROUP BY 1 HAVING max((z = 1)::INT) = 1 OR (min(z) = 0 AND max(z) = 2)), bl AS (SELECT locus_id, (row_number() OVER (ORDER BY {_hash('locus_id', 2)}, locus_id) - 1) % 10 AS blk FROM ok),
ce AS (SELECT * FROM zz JOIN bl USING (locus_id)),
tl AS (SELECT a.locus_id AS locus_a, b.locus_id AS locus_b, a.blk AS block_a, b.blk AS block_b, {", ".join(f"count(*) FILTER (3 * a.z + b.z = {k}) AS n{k}" for k in range(9))}, count(*) AS n
    FROM ce a JOIN ce b ON a.sample_id = b.sample_id AND a.locus_id < b.locus_id AND a.blk <> b.blk AND a.grp <> b.grp GROUP BY 1, 2, 3, 4),
hp AS (SELECT *, n0 + (n1 + n3) / 2.0::DOUBLE + n4 / 4.0::DOUBLE AS x1, n2 + (n1 + n5) / 2.0::DOUBLE + n4 / 4.0::DOUBLE AS x2, n6 + (n3 + n7) / 2.0::DOUBLE + n4 / 4.0::DOUBLE AS x3, n8 + (n5 + n7) / 2.0::DOUBLE + n4 / 4.0::DOUBLE AS x4 FROM tl),
ud AS (SELECT *, CASE WHEN n > 1 THEN 2 * (x1 * x4 - x2 * x3) / (n * (n - 1)) END AS d FROM hp)"""


def _counts(s, d):
    return linkage.two_locus_counts(bridge(s, d), ["AMERICA"], n_blocks=10, seed=2)


_NS = ", ".join(f"n{k}" for k in range(9))
_add("ld_two_locus_counts", lambda s, d: _counts(s, d).select("locus_a", "locus_b", *linkage.STATES), _LD + f" SELECT locus_a, locus_b, {_NS} FROM tl")
_add("ld_unbiased_d", lambda s, d: _rounded(linkage.unbiased_d(_counts(s, d)).select("locus_a", "locus_b", "n", "d"), "d"), _LD + " SELECT locus_a, locus_b, n, round(d, 6) + 0.0 AS d FROM ud")
_add(
    "ld_block_sums",
    lambda s, d: _rounded(linkage.block_sums(linkage.unbiased_d(_counts(s, d)), ("d",)).select("block_a", "block_b", "n_pairs", "min_n", "sum_n", "sum_d"), "sum_d"),
    _LD + " SELECT least(block_a, block_b)::INT AS block_a, greatest(block_a, block_b)::INT AS block_b, count(*) AS n_pairs, min(n) AS min_n, sum(n)::BIGINT AS sum_n, round(sum(d), 6) + 0.0 AS sum_d FROM ud WHERE n >= 4 GROUP BY 1, 2",
)
_add(
    "ld_budget_allocation",
    lambda s, d: linkage.budget_allocation(_counts(s, d), 5000),
    _LD + """, bs AS (SELECT least(block_a, block_b) * 1000 + greatest(block_a, block_b) AS pair, count(*) AS n FROM tl GROUP BY 1), e AS (SELECT *, n * 5000 / (SELECT sum(n) FROM bs)::DOUBLE AS x FROM bs)
    SELECT pair, n, (floor(x) + CASE WHEN row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, pair) <= 5000 - (SELECT sum(floor(x)) FROM e) THEN 1 ELSE 0 END)::BIGINT AS share FROM e""",
)


def _all_counts(s, d):
    return linkage.two_locus_counts(bridge(s, d), n_blocks=10, seed=2)


# The SQL of the four queries above is of one population. These are the same over all populations with enough samples.
_LDA = (
    _LD.replace("population = 'AMERICA' AND ", "population IN (SELECT population FROM smp GROUP BY 1 HAVING count(*) >= 4) AND ")
    .replace("zz AS (SELECT c.sample_id,", "zz AS (SELECT c.population, c.sample_id,")
    .replace("tl AS (SELECT a.locus_id", "tl AS (SELECT a.population, a.locus_id")
    .replace("a.grp <> b.grp GROUP BY 1, 2, 3, 4)", "a.grp <> b.grp GROUP BY 1, 2, 3, 4, 5)")
)
_BLOCKS = "least(block_a, block_b)::INT AS block_a, greatest(block_a, block_b)::INT AS block_b"
_add("ld_two_locus_counts_all", lambda s, d: _all_counts(s, d).select("population", "locus_a", "locus_b", *linkage.STATES), _LDA + f" SELECT population, locus_a, locus_b, {_NS} FROM tl")
_add("ld_unbiased_d_all", lambda s, d: _rounded(linkage.unbiased_d(_all_counts(s, d)).select("population", "locus_a", "locus_b", "n", "d"), "d"), _LDA + " SELECT population, locus_a, locus_b, n, round(d, 6) + 0.0 AS d FROM ud")
_add(
    "ld_block_sums_all",
    lambda s, d: _rounded(linkage.block_sums(linkage.unbiased_d(_all_counts(s, d)), ("d",)), "sum_d"),
    _LDA + f" SELECT population, {_BLOCKS}, count(*) AS n_pairs, min(n) AS min_n, sum(n)::BIGINT AS sum_n, round(sum(d), 6) + 0.0 AS sum_d FROM ud WHERE n >= 4 GROUP BY 1, 2, 3",
)
_add(
    "ld_budget_allocation_all",
    lambda s, d: linkage.budget_allocation(_all_counts(s, d), 5000, "population"),
    _LDA + """, bs AS (SELECT population, least(block_a, block_b) * 1000 + greatest(block_a, block_b) AS pair, count(*) AS n FROM tl GROUP BY 1, 2), e AS (SELECT *, n * 5000 / (sum(n) OVER (PARTITION BY population))::DOUBLE AS x FROM bs)
    SELECT population, pair, n, (floor(x) + CASE WHEN row_number() OVER (PARTITION BY population ORDER BY round(x - floor(x), 9) DESC, pair) <= 5000 - sum(floor(x)) OVER (PARTITION BY population) THEN 1 ELSE 0 END)::BIGINT AS share FROM e""",
)
# The statistics as frequencies' products, their biased draws taken off: written out for the nine counts.
_FULL = _LDA + f", sv AS (SELECT *, {', '.join(f'{e} AS v{k}' for k, e in enumerate(two_locus_sql()[0]))} FROM tl), us AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in two_locus_sql()[1].items())} FROM sv)"
_STATISTICS = ["d", "d2", "dz", "pi2"]
_add(
    "ld_unbiased_full",
    lambda s, d: linkage.with_statistics(_all_counts(s, d)).select("population", "locus_a", "locus_b", "n", *[F.when(~F.isnan(c), F.round(c, 6) + 0.0).alias(c) for c in _STATISTICS]),
    _FULL + f" SELECT population, locus_a, locus_b, n, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _STATISTICS)} FROM us",
)
_NE = ["mean_n", "mean_d", "r2d", "rdz", "ne", "r2d_lower", "r2d_upper", "ne_lower", "ne_upper"]
_NE_OF = "CASE WHEN {0} > 0 THEN 1 / (3 * {0}) END"
_add(
    "ld_ne_bootstrap",
    lambda s, d: _rounded(linkage.ld_summary(linkage.two_locus_sums(bridge(s, d), n_blocks=10, seed=2, max_pairs=None), _REPS, 5), *_NE),
    _FULL + f""", bk AS (SELECT population, {_BLOCKS}, count(*) AS n_pairs, sum(n) AS sum_n, {', '.join(f'sum({c}) AS s_{c}' for c in _STATISTICS)} FROM us WHERE n >= 4 GROUP BY 1, 2, 3),
    sl AS (SELECT *, row_number() OVER (ORDER BY block_a, block_b) - 1 AS slot, count(*) OVER () AS m FROM (SELECT DISTINCT block_a, block_b FROM bk)),
    dr AS (SELECT r AS rep, {_hash(f'r * {_STEP} + j', 5)} % m AS slot, count(*) AS w FROM range({_REPS}) x(r), (SELECT DISTINCT m FROM sl), LATERAL (SELECT unnest(range(m)) AS j) GROUP BY 1, 2),
    rr AS (SELECT population, rep, sum(w * s_d2) / sum(w * s_pi2) AS r2d FROM bk JOIN sl USING (block_a, block_b) JOIN dr USING (slot) GROUP BY 1, 2),
    ci AS (SELECT population, quantile_cont(r2d, 0.025) AS lo, quantile_cont(r2d, 0.975) AS hi FROM rr GROUP BY 1),
    es AS (SELECT population, sum(n_pairs)::BIGINT AS n_pairs, sum(sum_n) / sum(n_pairs)::DOUBLE AS mean_n, sum(s_d) / sum(n_pairs) AS mean_d, sum(s_d2) / sum(s_pi2) AS r2d, sum(s_dz) / sum(s_pi2) AS rdz FROM bk GROUP BY 1)
    SELECT population, n_pairs, round(mean_n, 6) AS mean_n, round(mean_d, 6) + 0.0 AS mean_d, round(r2d, 6) + 0.0 AS r2d, round(rdz, 6) + 0.0 AS rdz, round({_NE_OF.format("r2d")}, 6) AS ne, round(lo, 6) + 0.0 AS r2d_lower, round(hi, 6) + 0.0 AS r2d_upper,
        round({_NE_OF.format("hi")}, 6) AS ne_lower, round(CASE WHEN lo > 0 THEN 1 / (3 * lo) ELSE 'inf'::DOUBLE END, 6) AS ne_upper, CASE WHEN NOT r2d > 0 THEN 'not estimable' WHEN lo <= 0 THEN 'unbounded' ELSE 'estimated' END AS ne_status
    FROM es JOIN ci USING (population)""",
)


def _sampled(s, d):
    return linkage.two_locus_counts(bridge(s, d), n_blocks=10, seed=2, max_pairs=2000)


_add(
    "ld_sampled_pairs",
    lambda s, d: _sampled(s, d).select("population", "locus_a", "locus_b", *linkage.STATES),
    _LDA + f""", bs AS (SELECT population, least(a.blk, b.blk) AS x, greatest(a.blk, b.blk) AS y, a.locus_id AS la, b.locus_id AS lb, {_hash(f'(a.locus_id * {_STEP} + b.locus_id)', 2)} AS h
    FROM (SELECT DISTINCT population, locus_id, blk, grp FROM ce) a JOIN (SELECT DISTINCT population, locus_id, blk, grp FROM ce) b USING (population) WHERE a.locus_id < b.locus_id AND a.blk <> b.blk AND a.grp <> b.grp),
    e AS (SELECT *, n * 2000 / (sum(n) OVER (PARTITION BY population))::DOUBLE AS q FROM (SELECT population, x, y, count(*) AS n FROM bs GROUP BY 1, 2, 3)),
    sh AS (SELECT population, x, y, floor(q) + CASE WHEN row_number() OVER (PARTITION BY population ORDER BY round(q - floor(q), 9) DESC, x, y) <= 2000 - sum(floor(q)) OVER (PARTITION BY population) THEN 1 ELSE 0 END AS share FROM e),
    pk AS (SELECT population, la, lb FROM bs JOIN sh USING (population, x, y) QUALIFY rank() OVER (PARTITION BY population, x, y ORDER BY h) <= share)
    SELECT population, locus_a, locus_b, {_NS} FROM tl JOIN pk USING (population) WHERE la = locus_a AND lb = locus_b""",
)

# -- outliers, ordination ----------------------------------------------------------------------------------------------
_add("fst_outliers_knn", lambda s, d: outliers.fst_outliers_knn(bridge(s, d), alpha=0.5, correction=None, min_z=1.0, seed=1))
_ORP = 19
_OUT = _WC + _labels(_ORP, 1) + _WCP + f""", ob AS (SELECT pop1, pop2, locus_id, a / (a + b + c) AS fst FROM wc WHERE a + b + c <> 0), rr AS (SELECT pop1, pop2, locus_id, a / (a + b + c) AS r FROM wcp WHERE a + b + c <> 0),
    ct AS (SELECT pop1, pop2, locus_id, fst, count(r) AS n, count(*) FILTER (r >= fst - 1e-12) AS up, stddev_pop(r) AS sd FROM ob LEFT JOIN rr USING (pop1, pop2, locus_id) GROUP BY 1, 2, 3, 4),
    pv AS (SELECT *, CASE WHEN n < {_ORP} / 2.0 OR sd = 0 THEN 1.0 ELSE (up + 1) / (n + 1)::DOUBLE END AS p FROM ct),
    qv AS (SELECT *, least(1.0, min(p * m / k) OVER (PARTITION BY pop1, pop2 ORDER BY p DESC)) AS q FROM (SELECT *, count(*) OVER (PARTITION BY pop1, pop2) AS m, count(*) OVER (PARTITION BY pop1, pop2) - rank() OVER (PARTITION BY pop1, pop2 ORDER BY p DESC) + 1 AS k FROM pv))"""
for _name, _kind, _column, _alpha in (("fst_outliers_permutation", None, "p", 0.1), ("fst_outliers_permutation_fdr", "fdr_bh", "q", 0.5)):
    _add(
        _name,
        lambda s, d, k=_kind, a=_alpha: _rounded(outliers.fst_outliers_permutation(bridge(s, d), _ORP, alpha=a, correction=k, seed=1), "fst", "q_value"),
        _OUT + f" SELECT locus_id AS locus_idx, pop1 || '_' || pop2 AS population_pair, round(fst, 6) AS fst, round({_column}, 6) AS q_value FROM qv WHERE {_column} <= {_alpha}",
    )
_add("pca_scores", lambda s, d: outliers.pca(bridge(s, d), 2))

# -- plot data and round trips of encodings --------------------------------------------------------------------------------
_add("missing_cells", lambda s, d: statistics.missing_per_population_sample(bridge(s, d)), "SELECT population, sample_id AS sample_idx, locus_id AS locus_idx, true AS missing FROM calls WHERE gt IS NULL")
_add(
    "rolling_missing",
    lambda s, d: _rounded(statistics.rolling_mean(bridge(s, d).calls.groupBy("locus_idx").agg(F.avg(F.col("gt").isNull().cast("double")).alias("m")), "m", "locus_idx", interpolate=True, every=50), "m", "rolling"),
    """, m AS (SELECT locus_id, avg((gt IS NULL)::INT) AS m FROM calls GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY locus_id) - 1 AS i, CASE WHEN count(*) OVER w = 5 THEN avg(m) OVER w END AS v FROM m WINDOW w AS (ORDER BY locus_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
    e AS (SELECT min_by(v, i) AS lo, max_by(v, i) AS hi FROM r WHERE v IS NOT NULL) SELECT locus_id AS locus_idx, round(m, 6) AS m, round(coalesce(v, CASE WHEN i < 2 THEN lo ELSE hi END), 6) AS rolling FROM r, e WHERE i % 50 = 0""",
)
for _kind, _encode, _value in (("012", encodings.encode_012, "dosage"), ("onehot", encodings.encode_onehot, "onehot"), ("int", encodings.encode_int, "code")):
    # Dosages know one alternative: two different ones decode as the first.
    _gt = "gt" if _kind != "012" else "CASE WHEN gt IS NULL THEN NULL WHEN a1 = ref AND a2 = ref THEN ref WHEN a1 = ref OR a2 = ref THEN substr('ACMGRSVTWYHKDBN', {0} | {1}, 1) ELSE alt END AS gt".format(*(_M.format(x) for x in ("ref", "alt")))
    _add(
        f"calls_from_{_kind}",
        lambda s, d, k=_kind, e=_encode, v=_value: encodings.with_calls(bridge(s, d), e(bridge(s, d)), v, k).calls.select("locus_idx", "sample_idx", "gt"),
        f" SELECT locus_id AS locus_idx, sample_id AS sample_idx, {_gt} FROM (SELECT c.locus_id, c.sample_id, c.a1, c.a2, c.gt, l.ref, l.alt FROM calls c JOIN loc l USING (locus_id))",
    )
_add(
    "ld_informative_share",
    lambda s, d: _rounded(linkage.informative_share(linkage.with_statistics(_all_counts(s, d))), "informative"),
    _FULL + " SELECT population, count(*) AS n_pairs, round(avg((pi2 <> 0)::INT), 6) AS informative FROM us WHERE n >= 4 GROUP BY 1",
)

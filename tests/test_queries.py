from __future__ import annotations

from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__ as entry_module
from lociflow.operators.encodings import encode_012
from lociflow.plans import genomics
from lociflow.plans.bridge import bridge

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows_of(rows, columns) -> list[tuple]:
    out = []
    for r in rows:
        out.append(tuple("null" if r[c] is None else repr(round(float(r[c]), 5) + 0.0) if isinstance(r[c], (int, float)) else str(r[c]) for c in columns))
    return sorted(out)


@pytest.mark.parametrize("name", ["filter_missing", "filter_chain_audit", "thin_loci_clustered", "allele_summary", "heterozygosity_per_pop", "encode_012", "ref_alt_inference", "bh_correction"])
def test_against_sql(spark, duck, name):
    got = genomics.queries()[name](spark, DATA)
    want = duck.sql(genomics.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of([r.asDict() for r in got.collect()], columns) == rows_of([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], columns)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_linkage_of_all_populations(spark, duck):
    data = "/root/testdata/sf0.01"
    queries = genomics.queries()
    enough = {r["population"] for r in bridge(spark, data).samples.groupBy("population").count().filter("count >= 4").collect()}
    assert len(enough) == 5
    ne = queries["ld_ne_bootstrap"](spark, data).collect()
    assert {r["population"] for r in ne} == enough
    got = queries["ld_two_locus_counts_all"](spark, data).collect()
    assert {r["population"] for r in got} == enough
    # By brute force over the calls, for every 40th pair of loci.
    dosage = defaultdict(dict)
    for r in encode_012(bridge(spark, data)).join(bridge(spark, data).samples, "sample_idx").filter("dosage is not null").collect():
        dosage[r["population"], r["locus_idx"]][r["sample_idx"]] = r["dosage"]
    for r in got[::40]:
        a, b = dosage[r["population"], r["locus_a"]], dosage[r["population"], r["locus_b"]]
        want = Counter(3 * a[i] + b[i] for i in a.keys() & b.keys())
        assert [r[f"n{k}"] for k in range(9)] == [want[k] for k in range(9)]
    shares = defaultdict(int)
    for r in queries["ld_budget_allocation_all"](spark, data).collect():
        shares[r["population"]] += r["share"]
    assert shares == dict.fromkeys(enough, 5000)

"""The training-data operators on small tables: null, empty, repeated and clashing cases, and brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lociflow.llm import op1_jaccard, op2_multi_index, op3_suffix_dedup, op4_bitsliced, op9_licenses
from lociflow.llm.common import connected_components
from lociflow.llm.op1_jaccard import jaccard_links, shingle_sets
from lociflow.llm.op5_byte_bpe import decode_ids, encode_documents
from lociflow.llm.op6_packing import pack_pieces, plan_bins, token_pieces
from lociflow.llm.op7_toxicity import fit_toxicity, held_out, score_toxicity
from lociflow.llm.op8_token_files import read_token_files, tokenize, write_token_files
from lociflow.llm.op10_secrets import scan_secrets

public_tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
#: Null, empty and long texts, repeated rows, a null id, and columns named as the operators' own.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away into the dark wood", "x"),
    (2, "the quick brown fox jumps over the lazy dog and runs far away into the dark wood", "y"),
    (2, "the quick brown fox jumps over the lazy dog and runs far away into the dark wood", "y"),
    (3, None, None),
    (4, "", "z"),
    (None, "no id here, but words enough to make some shingles of five", "n"),
    (5, "wörter " * 4000, "l"),
    (6, "tiny", "t"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, rank string").withColumn("unit", F.lit(1)).withColumn("score", F.lit("s")).withColumn("rep", F.lit(0))


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_components(spark):
    edges = [(k, k + 1) for k in range(10, 60)] + [(3, 90), (90, 2), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 10 for k in range(10, 61))
    assert (got[3], got[90], got[2], got[7]) == (2, 2, 2, 7)


def _jaccard(rows):
    sets = {d: set(shingle_sets([t])[0].tolist()) for d, t in rows}
    links = defaultdict(set)
    for a in sets:
        for b in sets:
            if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a].add(b)
    return links


def test_jaccard(spark, small, docs):
    got = {r["doc_id"]: r for r in jaccard_links(small).collect()}
    links = _jaccard([(r["doc_id"], r["text"]) for r in small.collect()])
    assert {d: r["n_links"] for d, r in got.items()} == {d: len(links[d]) for d in got}
    rows = jaccard_links(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert (by[1]["n_links"], by[2]["component_id"], by[2]["kept"]) == (2, 1, False)
    assert (by[3]["n_links"], by[3]["kept"], by[None]["component_id"]) == (0, True, None)
    assert jaccard_links(docs.limit(0)).count() == 0


def test_jaccard_hot_buckets(spark, monkeypatch):
    """Tiny limits: buckets are split by Spark, compared in pairs of parts, and clusters are verified in chunks."""
    monkeypatch.setattr(op1_jaccard, "TASK_BUCKET", 4)
    monkeypatch.setattr(op1_jaccard, "CHUNK_SETS", 3)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(words[:i] + [f"x{i}"] + words[i + 1 :])) for i in range(1, 30)] + [(100, " ".join(words)), (101, " ".join(words))]
    got = {r["doc_id"]: r for r in jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    links = _jaccard(rows)
    assert {d: r["n_links"] for d, r in got.items()} == {d: len(links[d]) for d in got}
    assert {r["component_id"] for r in got.values()} == {1}


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.1, 0.0]), (3, [1.0, 0.1, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 0.0]), (7, [0.0, 1.0, None]), (None, [1.0, 0.0, 0.0]), (8, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit(1))
    got = op2_multi_index.link_vectors(df).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert by == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 4: (0, 4, True), 5: (0, 5, True), 6: (0, 6, True), 7: (0, 7, True), None: (0, None, True), 8: (0, 8, True)}
    assert op2_multi_index.link_vectors(df.limit(0)).count() == 0


def test_embedding_recall(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((150, 32))
    x = np.concatenate([base, base + 0.28 * rng.standard_normal(base.shape)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = np.array([r["n_links"] for r in op2_multi_index.link_vectors(df).orderBy("vec_id").collect()])
    assert (got <= want).all()
    assert got.sum() >= 0.9 * want.sum()


def _cut(rows):
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], (d is None, d or 0))
    out = defaultdict(list)
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < (d is None, d or 0):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out[d].append((len(b), sum(gone), sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return {d: sorted(v) for d, v in out.items()}


def _cut_of(df, unit, hot):
    got = defaultdict(list)
    for r in op3_suffix_dedup.remove_repeats(df, unit_bytes=unit, hot_windows=hot).collect():
        got[r["rest"]["doc_id"]].append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    return {d: sorted(v) for d, v in got.items()}


@pytest.mark.parametrize(("unit", "hot"), [(30_000, 1024), (2_000, 2)])
def test_suffix_dedup(spark, small, docs, unit, hot):
    for df in (small.filter("doc_id < 60"), docs):
        assert _cut_of(df, unit, hot) == _cut([(r["doc_id"], r["text"]) for r in df.collect()])
    assert op3_suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("ids", ["null", "one", "clustered", "some"])
def test_suffix_dedup_ids(spark, ids):
    """Ids that no range can tell apart, or that are close together, with passages that many rows share."""
    rng = random.Random(ids)
    passage = ["".join(rng.choices("abcd ", k=n)) for n in (60, 90, 200, 49, 50)]
    name = {"null": lambda k: None, "one": lambda k: 7, "clustered": lambda k: (10**15 if k % 9 == 0 else 0) + k // 3, "some": lambda k: None if k % 3 == 0 else k // 2}[ids]
    rows = [(name(k), "".join(rng.choice([*passage, "".join(rng.choices("abcd ", k=30))]) for _ in range(rng.randint(0, 8)))) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert _cut_of(df, 1_500, 4) == _cut(rows)


def test_suffix_dedup_long_text(spark):
    rng = np.random.default_rng(3)
    words = np.array(["".join(w) for w in rng.choice(list("abcdefghij"), (4_000, 7))])
    long = " ".join(rng.choice(words, 640_000))
    assert len(long) > 5_000_000
    rows = [(1, long), (2, long[1_000_000:1_000_400] + " tail"), (3, long), (0, "x" + long[77_777:77_900])]
    got = {r["rest"]["doc_id"]: r for r in op3_suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), unit_bytes=1_000_000).collect()}
    assert (got[0]["n_removed"], got[3]["n_removed"], got[3]["kept"]) == (0, len(long), b"")
    assert (got[1]["n_removed"], got[1]["n_spans"], bytes(got[1]["kept"])) == (123, 1, (long[:77_777] + long[77_900:]).encode())
    assert (got[2]["n_removed"], bytes(got[2]["kept"])) == (400, b" tail")


@pytest.mark.parametrize(("name", "query", "sql"), [("top_k", op4_bitsliced.op4_bitsliced_topk, op4_bitsliced.ORACLE), ("links", op2_multi_index.op2_embedding_links, op2_multi_index.ORACLE), ("licenses", op9_licenses.op9_license_scan, op9_licenses.ORACLE)])
def test_against_sql(spark, name, query, sql):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = query(spark, DATA), c.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_top_k_edges(spark):
    rows = [(50, [0.5, 0.5]), (50, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [float("inf"), 0.0]), (100, [-1.0, 0.25]), (4, [0.5])]
    v = op4_bitsliced.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = op4_bitsliced.top_k(v, v.filter("vec_id = 100"), 2).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, -24576), (50, -24576)]
    assert op4_bitsliced.top_k(v.limit(0), v.limit(0)).count() == 0


def test_bpe_documents(spark, docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = encode_documents(docs, path, public_tokenizers.PATTERN)
    got = sorted((str(r["doc_id"]), bytes(r["data"])) for r in decode_ids(encoded, path, public_tokenizers.PATTERN).collect())
    assert got == sorted((str(d), (t or "").encode()) for d, t, _ in ROWS)


@pytest.mark.parametrize("limits", [{}, {"broadcast_steps": 0, "ranks": 3}])
def test_packing(spark, docs, small, limits):
    for df in (docs, small, docs.limit(0)):
        pieces = token_pieces(df, WORDS, capacity=256)
        packed = pack_pieces(pieces, 256, **limits)
        assert packed.columns == [*pieces.columns, "sequence_id", "offset"]
        rows = packed.collect()
        assert len(rows) == pieces.count()
        bins = defaultdict(list)
        for r in rows:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 256
        want = plan_bins(Counter(r["length"] for r in rows), 256)
        assert len(bins) == max((first + n for _, _, n, first, _ in want), default=0)


def test_token_files(spark, docs, tmp_path):
    tokens = tokenize(docs, WORDS)
    write_token_files(tokens, f"file://{tmp_path}/files", partitions=3)
    got = read_token_files(spark, f"file://{tmp_path}/files").collect()
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes()) for r in tokens.collect())
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["ids"])) for r in got) == want
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        assert r["ids_crc32"] == zlib.crc32(r["ids"])
        start += r["n_tokens"]
    write_token_files(tokenize(docs.limit(0), WORDS), f"file://{tmp_path}/none")
    assert read_token_files(spark, f"file://{tmp_path}/none").count() == 0


def test_licenses_and_secrets_edges(spark, docs):
    assert op9_licenses.scan_licenses(docs).count() == scan_secrets(docs).count() == len(ROWS)
    assert op9_licenses.scan_licenses(docs.limit(0)).count() == scan_secrets(docs.limit(0)).count() == 0
    text = "Released under the MIT License.\nplain\nThis work is licensed under the GNU General Public License, version 3."
    row = op9_licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_base"], row["first_word"], row["last_word"], row["base_labels"], row["labels"]) == (2, 3, 12, "gpl,mit", "gpl,mit")


def test_wrapped_notices(spark):
    texts = {
        "bsd": "x\n# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:\n",
        "mit": "plain\n" * 50 + "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and\nassociated documentation files",
        "apache-2.0": "you may not use this file except\nin compliance with the License.\n * You may obtain a copy\n * of the License at",
        "mpl-2.0": "This Source Code Form is subject to\nthe terms of the Mozilla Public\n// License, v. 2.0.",
    }
    far = texts["bsd"].replace("modification", "y " * 40 + "modification")  # too far apart for one run
    rows = op9_licenses.scan_licenses(spark.createDataFrame([*texts.items(), ("", far), ("", "redistribution and\nuse")], "doc_id string, text string")).collect()
    assert sorted((r["labels"], r["score"]) for r in rows) == sorted([(k, 1.0) for k in texts] + [("", 0.0)] * 2)


def test_toxicity(spark, docs):
    d = "/root/testdata/sf0.1"
    all_docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = fit_toxicity(all_docs, labels, fit_rows=2000)
    held = all_docs.join(labels, "doc_id").filter(held_out())
    rows = score_toxicity(held, model).join(labels, "doc_id").collect()
    hit = [r["toxic"] == 1 for r in rows if r["score"] >= 0.7]
    assert sum(hit) >= 0.95 * len(hit)
    assert sum(hit) >= 0.8 * sum(r["toxic"] for r in rows)
    scores = [r["score"] for r in score_toxicity(docs, model).collect()]
    assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
    none = fit_toxicity(docs, labels.limit(0))
    assert all(r["score"] < 0.7 for r in score_toxicity(docs, none).collect())


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / stage.__name__))
        docs = spark.read.parquet(str(tmp_path / stage.__name__))
    links = _jaccard([(r["doc_id"], r["text"]) for r in spark.read.parquet(str(tmp_path / "near_duplicates")).collect()])
    assert not any(links.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == docs.count()

"""License scans in DataFrame functions only: exact phrases, and an exact set-similarity join of lines and word windows with notices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

__all__ = ["ORACLE", "op9_license_scan", "scan_licenses"]

# Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Words of public license notices, by label.
NOTICES = (
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under the creative commons attribution sharealike 4 0 international license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
#: Share of a notice's distinct words that a block must hold.
CONTAINMENT = 0.85

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _normal(c: Column) -> Column:
    """Words with one space between them, before the first and after the last; one space where there is no word."""
    return F.regexp_replace(F.concat(F.lit(" "), c, F.lit(" ")), _MARKS, " ")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES, containment: float = CONTAINMENT) -> DataFrame:
    """Phrases and notices in every whole text.

    The words of all notices are counted over all documents and ordered from rare to frequent. A block can
    only reach the threshold for a notice if it holds one of the notice's first words in that order (prefix filter), has
    enough words (length filter) and enough are left on both sides after the first common one (positional filter); what
    passes is verified by intersection. So a frequent word never makes a candidate. The driver gets one count for each
    word of the notices. One narrow scan besides that count, and one shuffle of a short row for each document.

    Blocks are the lines and, since notices are often wrapped, all runs of ``ceil(words of the notice / containment)``
    words, whatever line ends are in them. Every such run lies in one of the tiles of twice the longest run that start
    at its multiples; tiles with a first word of some notice go through the filters as lines do, and those that pass are
    verified run by run.

    A null text is empty. Repeated rows give a row each, null ids stay null, an empty table gives no rows. Other columns
    are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("doc_id"), F.translate(F.coalesce(docs[text_col], F.lit("")), _UPPER, _LOWER).alias("lower"))
    rows = rows.select("doc_id", "lower", _normal(F.col("lower")).alias("flat"))

    vocabulary = sorted({w for _, text in notices for w in text.split()})
    words = F.array_distinct(F.split("flat", " "))
    seen = rows.select(F.explode(F.array_intersect(words, F.array(*map(F.lit, vocabulary)))).alias("w")).groupBy("w").count()
    counts = {r["w"]: r["count"] for r in seen.collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    sets = [(label, [w for w in order if w in set(text.split())], math.ceil(len(text.split()) / containment - 1e-9)) for label, text in notices]
    longest = max((span for *_, span in sets), default=1)
    prefixes = []
    for k, (label, own, span) in enumerate(sets):
        need = math.ceil(containment * len(own) - 1e-9)
        prefixes += [(w, label, k, i, own, own[:i], need, span) for i, w in enumerate(own[: len(own) - need + 1])]
    table = spark.createDataFrame(prefixes, "w string, label string, notice int, i int, own array<string>, earlier array<string>, need int, span int")
    firsts = [w for w in order if any(w == p[0] for p in prefixes)]
    alive = [w for w in firsts if counts.get(w, 0)]

    cut = " (?=(?:" + "|".join(p for p, _ in PHRASES) + ") )"
    parts = F.split("flat", cut)
    scanned = rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        (F.greatest(_spaces(F.col("flat")) - 1, F.lit(0))).cast("long").alias("n_words"),
        parts.alias("parts"),
        F.array_join(F.array_compact(F.array(*(F.when(F.contains("flat", F.lit(f" {p} ")), F.lit(label)) for p, label in sorted(PHRASES, key=lambda x: x[1])))), ",").alias("base_labels"),
        (F.when(F.col("flat").rlike(" (?:" + "|".join(alive) + ") "), F.split("lower", "\n")) if alive else F.lit(None).cast("array<string>")).alias("lines"),
        # A text of one line is its own block, which holds what its runs hold.
        (F.when(F.contains("lower", F.lit("\n")) & F.col("flat").rlike(" (?:" + "|".join(alive) + ") "), F.split(F.trim("flat"), " ")) if alive else F.lit(None).cast("array<string>")).alias("all"),
    )
    facts = scanned.select(
        "row",
        "doc_id",
        "n_words",
        (F.size("parts") - 1).cast("long").alias("n_base"),
        F.when(F.size("parts") > 1, _spaces(F.col("parts")[0])).cast("long").alias("first_word"),
        F.when(F.size("parts") > 1, F.col("n_words") - _spaces(F.element_at("parts", -1))).cast("long").alias("last_word"),
        "base_labels",
        "lines",
        "all",
        F.array_compact(F.transform("all", lambda w, i: F.when(w.isin(alive), F.floor(i / longest).cast("int")))).alias("tiles"),
    )
    tiles = F.filter(F.array_distinct(F.concat("tiles", F.transform("tiles", lambda t: t - 1))), lambda t: t >= 0)
    texts = F.transform("lines", lambda x: F.struct(F.split(_normal(x), " ").alias("words"), F.lit(False).alias("tile")))
    runs = F.coalesce(F.transform(tiles, lambda t: F.struct(F.slice("all", t * longest + 1, F.lit(2 * longest)).alias("words"), F.lit(True).alias("tile"))), F.array().cast("array<struct<words:array<string>,tile:boolean>>"))
    facts = facts.select("row", F.struct("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").alias("facts"), F.explode_outer(F.concat(texts, runs)).alias("block"))
    blocks = facts.withColumn("words", F.array_remove(F.array_distinct("block.words"), "")).withColumn("tile", F.when(F.col("block.tile"), F.col("block.words")))
    # The block's notice words in the common order; nothing else counts for containment.
    blocks = blocks.withColumn("known", F.array_intersect(F.array(*map(F.lit, order)), "words"))
    starts = F.array_intersect("known", F.array(*map(F.lit, firsts)))
    probes = blocks.select("row", "facts", "known", "tile", F.size("words").alias("size"), F.explode_outer(starts).alias("w"))
    rest = F.least(F.size("own") - F.col("i") - 1, F.size("known") - F.array_position("known", F.col("w")))
    passes = (F.col("size") >= F.col("need")) & (1 + rest >= F.col("need")) & ~F.arrays_overlap("earlier", "known")
    # The notices' prefixes are some dozens of rows.
    joined = probes.join(F.broadcast(table), "w", "left").withColumn("common", F.when(passes, F.size(F.array_intersect("own", "known"))))
    places = F.sequence(F.lit(1), F.greatest(F.size("tile") - F.col("span") + 1, F.lit(1)))
    held = F.array_max(F.transform(places, lambda i: F.size(F.array_intersect("own", F.slice("tile", i, F.col("span"))))))
    joined = joined.withColumn("common", F.when((F.col("common") >= F.col("need")) & F.col("tile").isNotNull(), held).otherwise(F.col("common")))
    hit = F.col("common") >= F.col("need")
    found = joined.groupBy("row").agg(F.first("facts").alias("facts"), F.collect_set(F.when(hit, F.col("label"))).alias("more"), F.max(F.when(hit, F.col("common") / F.size("own"))).alias("best"))
    base = F.filter(F.split("facts.base_labels", ","), lambda x: x != "")
    labels = F.array_join(F.array_sort(F.array_union(base, F.col("more"))), ",")
    score = F.when(F.col("facts.n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return found.select("facts.*", labels.alias("labels"), score.alias("score"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in every whole text of ``documents``."""
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def _place(phrase: str) -> str:
    return " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split(), 1))


_NOTICE_ROWS = ", ".join(f"('{label}', list_distinct(string_split('{text}', ' ')))" for label, text in NOTICES)
#: The same rows by brute force: every line against every notice.
ORACLE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
words AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
places AS (SELECT *, list_filter(range(len(w)), lambda i: {" OR ".join(f"({_place(p)})" for p, _ in PHRASES)}) AS pos,
    array_to_string(list_filter([{", ".join(f"CASE WHEN len(list_filter(range(len(w)), lambda i: {_place(p)})) > 0 THEN '{label}' END" for p, label in sorted(PHRASES, key=lambda x: x[1]))}], lambda x: x IS NOT NULL), ',') AS base_labels FROM words),
notices(label, own) AS (VALUES {_NOTICE_ROWS}),
lines AS (SELECT r, regexp_extract_all(unnest(string_split(t, chr(10))), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
hits AS (SELECT r, label, len(list_intersect(own, list_distinct(w)))::DOUBLE / len(own) AS c FROM lines, notices),
found AS (SELECT r, list(DISTINCT label) AS more, max(c) AS best FROM hits WHERE c >= {CONTAINMENT} - 1e-9 GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, len(pos)::BIGINT AS n_base, CASE WHEN len(pos) > 0 THEN pos[1] END::BIGINT AS first_word,
    CASE WHEN len(pos) > 0 THEN pos[len(pos)] END::BIGINT AS last_word, base_labels,
    array_to_string(list_sort(list_distinct(list_concat(list_filter(string_split(base_labels, ','), lambda x: x <> ''), coalesce(more, [])))), ',') AS labels,
    CASE WHEN len(pos) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM places LEFT JOIN found USING (r)
"""

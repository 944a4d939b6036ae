"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, scored by what stands around each hit."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, map_rows, read_table, small_batches, write_shared

__all__ = ["LevenshteinTrie", "Lexicon", "ToxicityModel", "fit_toxicity", "held_out", "op7_toxicity", "score_toxicity", "with_toxicity"]

#: Labelled rows that the lexicon and the weights are fitted on at most: those first in hash order of their ids.
FIT_ROWS = 8_000
#: Times that a term counts in one text at most, so that no single text makes a term.
TEXT_COUNTS = 3
STEMS = range(3, 9)
WINDOW = 8
THRESHOLD = 0.7
#: What the logarithm of the odds and the likelihood ratio of a lexicon entry must reach.
MIN_ODDS, MIN_RATIO = 1.5, 25
#: What a hit counts inside quotation marks or next to a word that reports speech.
QUOTED = 0.25
# Words that report what somebody said.
REPORTING = frozenset("said says wrote called quote quoted quoting word term insult insulted".split())

#: Entries with fewer letters are only met as they are: an edit of them is a part of too many words.
MIN_FUZZY = 4
_WORD = re.compile(r"[^\W\d_]+")
#: Words, and what one or two digits or marks join to one token.
_TOKEN = re.compile(r"[^\W\d_]++(?:[\d_*@$!|#+.'’~^%&-]{1,2}+[^\W\d_]++)*+")
_JOINTS = re.compile(r"[\W\d_]+")
_QUOTES = re.compile(r"[\"“”„«»]")


class LevenshteinTrie:
    """The Levenshtein automata of all entries of a trie at once, made deterministic as words walk it.

    A state is the set of (trie node, edits so far) that some spelling of an entry may be in. Each state and letter is
    worked out once and then remembered, so a word costs a look-up a letter, and most words die after a few. An entry
    allows one edit, two from 8 letters on. ``stems`` are entries that one letter more at least must follow. What is
    remembered is forgotten at ``limit`` steps or ``limit_bytes`` of states; a state is packed, as there are many.
    """

    def __init__(self, weights: dict[str, float], limit: int = 200_000, stems: dict[str, float] | None = None, limit_bytes: int = 32_000_000):
        self.children: list[dict[str, int]] = [{}]
        self.weight: list[float | None] = [None]
        #: What follows a stem: a node that any letter leads to, and stays in.
        self.tail: list[int] = [0]
        self.own, self.reach, self.limit, self.limit_bytes = [0], [0], limit, limit_bytes
        for word, weight in weights.items():
            at, allowed = self._insert(word)
            self.weight[at], self.own[at] = weight, allowed
        for stem, weight in (stems or {}).items():
            at, allowed = self._insert(stem)
            self.tail[at] = tail = self._node()
            self.tail[tail] = tail
            self.weight[tail], self.own[tail], self.reach[tail] = weight, allowed, allowed
        self._forget()

    def _node(self) -> int:
        self.children.append({})
        self.weight.append(None)
        self.tail.append(0)
        self.own.append(0)
        self.reach.append(0)
        return len(self.children) - 1

    def _insert(self, entry: str) -> tuple[int, int]:
        """The entry's last node and the edits it allows."""
        allowed, at = 1 + (len(entry) >= 8), 0
        self.reach[0] = max(self.reach[0], allowed)
        for c in entry:
            if c not in self.children[at]:
                self.children[at][c] = self._node()
            at = self.children[at][c]
            self.reach[at] = max(self.reach[at], allowed)
        return at, allowed

    def _forget(self) -> None:
        self.ids: dict[bytes, int] = {b"": 0}
        self.states: list[bytes] = [b""]
        self.size = 0
        self.steps: dict[tuple[int, str], int] = {}
        self.best: list[float | None] = [None]
        self.start = self._state({0: 0} if self.reach[0] else {})

    def _state(self, edits: dict[int, int]) -> int:
        """The number of a state, after letters of entries that a word may lack."""
        todo = list(edits.items())
        while todo:
            node, e = todo.pop()
            if edits[node] < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.reach[child] and e + 1 < edits.get(child, 99):
                    edits[child] = e + 1
                    todo.append((child, e + 1))
        key = array("Q", sorted(node << 2 | e for node, e in edits.items())).tobytes()
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.size += len(key)
            self.best.append(max((self.weight[n] for n, e in edits.items() if self.weight[n] is not None and e <= self.own[n]), default=None))
        return self.ids[key]

    def _step(self, state: int, char: str) -> int:
        edits: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.reach[node] and e < edits.get(node, 99):
                edits[node] = e

        for code in array("Q", self.states[state]):
            node, e = code >> 2, code & 3
            put(node, e + 1)
            if self.tail[node]:
                put(self.tail[node], e)
            for c, child in self.children[node].items():
                put(child, e + (c != char))
        return self._state(edits)

    def find(self, word: str) -> float | None:
        """The heaviest entry that the word may be a spelling of."""
        if len(self.steps) > self.limit or self.size > self.limit_bytes:
            self._forget()
        state, steps = self.start, self.steps
        for c in word:
            after = steps.get((state, c))
            if after is None:
                after = steps[state, c] = self._step(state, c)
            if not after:
                return None
            state = after
        return self.best[state]


#: The last trie of this process, by its entries: copies of a lexicon and its variants have one.
_TRIE: dict[tuple, LevenshteinTrie] = {}


def _trie(words: dict[str, float], stems: dict[str, float]) -> LevenshteinTrie:
    key = (frozenset(words.items()), frozenset(stems.items()))
    if key not in _TRIE:
        _TRIE.clear()
        _TRIE[key] = LevenshteinTrie(words, stems=stems)
    return _TRIE[key]


@dataclass
class Lexicon:
    """Whole words and stems with weights. ``find`` gives a word's (weight, kind), kinds: 0 word, 1 stem, 2 misspelling of either.

    ``covered`` are words and ``covered_stems`` stems that begin with a stem: met as they are they are that stem's, only
    their misspellings are their own. ``known`` are words of clean texts, and in how many: they are no misspellings.
    """

    words: dict[str, float]
    stems: dict[str, float]
    covered: dict[str, float] = field(default_factory=dict)
    covered_stems: dict[str, float] = field(default_factory=dict)
    known: dict[str, int] = field(default_factory=dict)
    memo: dict[str | tuple[str], tuple[float, int] | None] = field(default_factory=dict, init=False, repr=False)
    trie: LevenshteinTrie | None = field(default=None, init=False, repr=False)

    def __post_init__(self) -> None:
        long = lambda entries: {t: v for t, v in entries.items() if len(t) >= MIN_FUZZY}
        self.trie = _trie(long(self.covered | self.words), long(self.covered_stems | self.stems))

    def __getstate__(self) -> dict:
        return {"words": self.words, "stems": self.stems, "covered": self.covered, "covered_stems": self.covered_stems, "known": self.known}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def find(self, word: str) -> tuple[float, int] | None:
        if word in self.memo:
            return self.memo[word]
        if len(self.memo) > 200_000:
            self.memo.clear()
        out = None
        if word in self.words:
            out = (self.words[word], 0)
        else:
            stems = [self.stems[word[:k]] for k in STEMS if k < len(word) and word[:k] in self.stems]
            if stems:
                out = (max(stems), 1)
            elif MIN_FUZZY <= len(word) and word not in self.known and (weight := self.trie.find(word)) is not None:
                out = (weight, 2)
        self.memo[word] = out
        return out

    def find_token(self, token: str) -> tuple[float, int] | None:
        """A token that digits or marks are in: as a misspelling with them as letters, or without them."""
        key = (token,)
        if key not in self.memo:
            weights = [self.trie.find(token)] if MIN_FUZZY <= len(token) else []
            if len(bare := _JOINTS.sub("", token)) >= MIN_FUZZY and (found := self.find(bare)):
                weights.append(found[0])
            weight = max((w for w in weights if w is not None), default=None)
            self.memo[key] = None if weight is None else (weight, 2)
        return self.memo[key]

    def hits(self, lower: str) -> tuple[list[str], list[tuple[int, float, int]]]:
        """All words, and (place, weight, kind) of the hits. A joined token is looked at where none of its words is a hit."""
        words: list[str] = []
        hits = []
        find = self.find
        for token in _TOKEN.findall(lower):
            if token.isalpha():
                if found := find(token):
                    hits.append((len(words), *found))
                words.append(token)
                continue
            parts = _WORD.findall(token)
            own = [(k, *found) for k, w in enumerate(parts, len(words)) if (found := find(w))]
            if not own and len(parts) > 1 and (found := self.find_token(token)):
                own = [(len(words), *found)]
            hits += own
            words += parts
        return words, hits

    def features(self, text: str | None) -> list[float]:
        """Sums of hits by kind, their density, the densest window and its share; a null text is empty."""
        lower = (text or "").lower()
        words, hits = self.hits(lower)
        sums = [0.0, 0.0, 0.0]
        best = 0.0
        if hits:
            quoted = self._quoted(lower, words, [h[0] for h in hits])
            left = 0
            for at, (k, weight, kind) in enumerate(hits):
                while hits[left][0] < k - WINDOW:
                    left += 1
                value = weight * (QUOTED if quoted[at] else 1.0)
                # Company within the window makes abuse likelier than a lone word.
                sums[kind] += value * (1 + 0.5 * (at - left))
                best = max(best, sum(h[1] for h in hits[left : at + 1]) * (QUOTED if quoted[at] else 1.0))
        n = max(len(words), 1)
        return [math.log1p(sums[0]), math.log1p(sums[1]), math.log1p(sums[2]), math.log1p(100 * sums[0] / n), math.log1p(100 * sums[1] / n), math.log1p(100 * sums[2] / n), math.log1p(best), math.log1p(len(words))]

    def misspelt(self, text: str | None) -> str:
        """The text with another second letter in each word that is a hit as it is."""

        def other(m: re.Match) -> str:
            w = m[0]
            return w[0] + ("x" if w[1] != "x" else "z") + w[2:] if len(w) >= MIN_FUZZY and (found := self.find(w)) and found[1] < 2 else w

        return _WORD.sub(other, (text or "").lower())

    @staticmethod
    def _quoted(lower: str, words: list[str], places: list[int]) -> list[bool]:
        """Is each hit between two quotation marks, or after a reporting word within the window?"""
        out = [any(w in REPORTING for w in words[max(0, k - WINDOW) : k]) for k in places]
        if _QUOTES.search(lower):
            spans = [m.span() for m in re.finditer(r"[\"“„«][^\"“”„«»]++[\"”“»]", lower)]
            if spans:
                starts = [m.start() for m in _WORD.finditer(lower)]
                j = 0
                for i, k in enumerate(places):
                    while j < len(spans) and spans[j][1] <= starts[k]:
                        j += 1
                    out[i] = out[i] or (j < len(spans) and spans[j][0] <= starts[k])
        return out


N_FEATURES = 8


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def held_out(id_col: str = "doc_id"):
    """Rows that labels are not learned from: crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


TERMS = T.StructType([T.StructField("term", T.StringType()), T.StructField("stem", T.BooleanType()), T.StructField("pos", T.LongType()), T.StructField("neg", T.LongType()), T.StructField("docs", T.LongType()), T.StructField("clean", T.LongType())])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and stems by label, at most ``TEXT_COUNTS`` for each document, summed over parts of the task."""
    counts: tuple[Counter, Counter, Counter, Counter] = Counter(), Counter(), Counter(), Counter()

    def flush() -> pa.RecordBatch:
        keys = list(set(counts[0]) | set(counts[1]))
        out = pa.RecordBatch.from_arrays([pa.array([t for t, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.bool_()), *(pa.array([c[t] for t in keys], pa.int64()) for c in counts)], names=TERMS.names)
        for c in counts:
            c.clear()
        return out

    for b in small_batches(batches, 500_000):
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = Counter(_WORD.findall((text or "").lower()))
            own: Counter = Counter()
            for w, n in words.items():
                own[w, False] += n
                for k in STEMS:
                    if len(w) > k:
                        own[w[:k], True] += n
            for t, n in own.items():
                counts[0 if toxic else 1][t] += min(n, TEXT_COUNTS)
            if toxic:
                counts[2].update(own.keys())
            else:
                counts[3].update(t for t in own if not t[1])
        if len(counts[0]) + len(counts[1]) > 100_000:
            yield flush()
    yield flush()


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """All words and stems that toxic texts of ``sample(text, toxic)`` hold far more often; the sample bounds their number."""
    counts = sample.select("text", "toxic").mapInArrow(_terms, TERMS).groupBy("term", "stem").agg(*(F.sum(c).alias(c) for c in ("pos", "neg", "docs", "clean")))
    counts = write_shared(counts, "terms")
    totals = counts.filter("not stem").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    p, n = max(totals["p"] or 0, 1), max(totals["n"] or 0, 1)
    total, share = F.col("pos") + F.col("neg"), p / (p + n)
    odds = F.log((F.col("pos") + 0.5) / p) - F.log((F.col("neg") + 0.5) / n)
    part = lambda seen, of: F.when(seen > 0, seen * F.log(seen / (total * of))).otherwise(0.0)
    # The likelihood ratio of the term's counts against the classes' shares: what chance hardly gives.
    counts = counts.withColumn("odds", odds).withColumn("g", 2 * (part(F.col("pos"), share) + part(F.col("neg"), 1 - share)))
    rows = counts.filter(f"docs >= 4 and odds >= {MIN_ODDS} and g >= {MIN_RATIO}").orderBy(F.desc("g"), "term", "stem").collect()
    words = {r["term"]: r for r in rows if not r["stem"]}
    stems = {r["term"]: r for r in rows if r["stem"]}
    # A stem that is mostly one word, or mostly one longer stem, says no more than that does; nor does a word under a kept stem.
    longest: dict[str, int] = {}
    for term, r in [*words.items(), *stems.items()]:
        for k in STEMS:
            if k < len(term):
                longest[term[:k]] = max(longest.get(term[:k], 0), r["pos"])
    kept = {t: float(r["odds"]) for t, r in stems.items() if longest.get(t, 0) < 0.8 * r["pos"]}
    covered = lambda w: any(w[:k] in kept for k in STEMS if k < len(w))
    plain, under, stems, longer = {}, {}, {}, {}
    for t, r in words.items():
        (under if covered(t) else plain)[t] = float(r["odds"])
    for t, w in kept.items():
        (longer if covered(t) else stems)[t] = w
    lexicon = Lexicon(plain, stems, under, longer)
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def factory():
        find = shared.value.find
        return lambda terms, clean: [terms, [c if (found := find(t)) and found[1] == 2 else None for t, c in zip(terms, clean, strict=True)]]

    # Of the sample's words, only what the automaton takes for misspellings.
    known = map_rows(counts.filter("not stem and clean > 0"), ["term", "clean"], KNOWN, factory).filter("clean is not null").collect()
    return replace(lexicon, known={r["term"]: r["clean"] for r in known})


KNOWN = T.StructType([T.StructField("term", T.StringType()), T.StructField("clean", T.LongType())])


FEATURES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, ridge: float = 1.0) -> ToxicityModel:
    """Fit lexicon and weights on at most ``fit_rows`` labelled rows that are not held out.

    The rows come first in hash order of their ids, so the choice does not depend on the layout. As hardly any of them
    has misspellings to learn from, the weights are fitted on each row as it is and with its hits misspelt. With no labelled row of
    one of the classes the score is that share everywhere.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).filter("label_id is not null and toxic is not null")
    known = known.filter(~held_out("label_id")).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    known = write_shared(known.orderBy(F.xxhash64("label_id"), "label_id").limit(fit_rows), "known")
    # At most fit_rows rows of two numbers.
    sample = docs.select(docs[id_col].cast("long").alias("label_id"), docs[text_col].alias("text")).join(F.broadcast(known), "label_id")
    sample = write_shared(sample, "sample")
    lexicon = learn_lexicon(sample)
    shared = spark.sparkContext.broadcast(lexicon)

    def factory():
        # A clean text's own words are known for what other clean texts hold.
        lexicon = shared.value
        others = replace(lexicon, known={w: n for w, n in lexicon.known.items() if n > 1})
        both = lambda x, t: x.features(t) + x.features(x.misspelt(t))
        return lambda ids, toxic, texts: [ids, toxic, [both(lexicon if y else others, t) for y, t in zip(toxic, texts, strict=True)]]

    rows = map_rows(sample, ["label_id", "toxic", "text"], FEATURES, factory).orderBy("doc_id").collect()
    x = np.array([r["x"] for r in rows], float).reshape(-1, N_FEATURES)
    y = np.repeat(np.array([r["label"] for r in rows], float), 2)
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    scale[scale < 1e-9] = 1.0
    a = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w = np.zeros(N_FEATURES + 1)
    penalty = np.diag([1e-6] + [ridge] * N_FEATURES)
    for _ in range(50 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(len(w)), a.T @ (p - y) + penalty @ w)
        w -= np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    if not len(x):
        w[0] = -30
    return ToxicityModel(lexicon, mean, scale, w)


SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score) with a score of 0 to 1 for each document; only the text is looked at.

    Null texts are empty, and empty ones have a score too; repeated rows, null ids and texts of any length are rows like
    others; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def factory():
        model = shared.value

        def work(ids, texts):
            x = np.array([model.lexicon.features(t) for t in texts], float).reshape(-1, N_FEATURES)
            return [ids, model.score(x).tolist()]

        return work

    return map_rows(docs, [docs[id_col].cast("long"), docs[text_col]], SCORES, factory)


def with_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with a score column, in one narrow pass; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def factory():
        model = shared.value
        return lambda texts: [model.score(np.array([model.lexicon.features(t) for t in texts], float).reshape(-1, N_FEATURES)).tolist()]

    return add_columns(docs, text_col, T.StructType([T.StructField(name, T.DoubleType())]), factory)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of ``documents``, learned from the labels that are not held out.

    Null and empty texts, null ids (never held out, never labelled), repeated rows (each a row; one label an id) and texts
    of any length are scored; an empty table gives no rows; other columns are not read.
    """
    docs = read_table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

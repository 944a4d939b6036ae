"""Secret scans: fixed credential patterns plus sliding-window Shannon entropy over candidate strings."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import add_columns, map_rows, read_table

__all__ = ["entropy_windows", "find_secrets", "op10_secret_scan", "redact", "scan_secrets", "with_redacted"]

# The kinds of credential and the shapes they have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")
MIN_ASSIGN, MIN_ACCESS = 8, 16

#: Strings that entropy looks at. Other marks end a candidate.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits a character that a window must reach, by the classes its candidate has.
LEVELS = {"hex": 3.0, "alnum": 3.6, "base64": 3.7}
#: Never a secret as a whole candidate: words and phrases, UUIDs, numbers, dates and times.
ALLOWED = (
    re.compile(r"[A-Za-z]+(?:[-_/=+]+[A-Za-z]+)*[-_/=+]*"),
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"[-0-9_/=+]+"),
)
#: Never a secret: what lies between two marks of PARTS, or a run's ends, with a placeholder in it. The run's other parts may be.
PARTS = re.compile(r"[^/=]+")
PLACEHOLDER = re.compile(r"(?i)example|placeholder|changeme|your[-_]?key|xxxx")
#: Entropy of a window from its counts: n log2 n for each count, looked up.
_NLOGN = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def _level(text: str) -> float | None:
    """The threshold of a candidate's character class; None where letters and digits don't mix."""
    if not (re.search("[0-9]", text) and re.search("[A-Za-z]", text)):
        return None
    if re.fullmatch("[0-9a-f_=-]+|[0-9A-F_=-]+", text):
        return LEVELS["hex"]
    return LEVELS["base64" if re.search("[+/]", text) else "alnum"]


def entropy_windows(text: str, level: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal runs of consecutive windows whose Shannon entropy is at least ``level`` bits a character; runs may overlap.

    One pass: the sum of ``n log2 n`` over the counts changes by two terms for each step, so a window costs constant time.
    """
    counts: dict[str, int] = {}
    total, found = 0.0, []
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        total += _NLOGN[n + 1] - _NLOGN[n]
        counts[c] = n + 1
        if i >= window:
            old = text[i - window]
            n = counts[old]
            total += _NLOGN[n - 1] - _NLOGN[n]
            counts[old] = n - 1
        if i >= window - 1 and math.log2(window) - total / window >= level - 1e-9:
            if found and found[-1][1] == i:  # the window before is of the run
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((i - window + 1, i + 1))
    return found


def find_secrets(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """``(base, added)`` spans as (start, end, kind) in code points; ends are exclusive. A null or empty text has none."""
    if not text:
        return [], []
    base = []
    if "=" in text or ":" in text:
        base += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    added = []
    for m in CANDIDATE.finditer(text):  # a run of 32 hex digits is always inside one
        s = m[0]
        base += [(m.start() + h.start(), m.start() + h.end(), "hex") for h in HEX.finditer(s)]
        if (level := _level(s)) is not None and not any(p.fullmatch(s) for p in ALLOWED):
            # What is left between parts with placeholders is measured by itself.
            held = [p.span() for p in PARTS.finditer(s) if PLACEHOLDER.search(p[0])] if PLACEHOLDER.search(s) else []
            for left, right in zip([0, *(b for _, b in held)], [*(a for a, _ in held), len(s)], strict=True):
                part = s[left:right]
                if right - left >= WINDOW and (level := _level(part)) is not None and not any(p.fullmatch(part.strip("-_/=+")) for p in ALLOWED):
                    added += [(m.start() + left + a, m.start() + left + b, "entropy") for a, b in entropy_windows(part, level)]
    rank = KINDS.index
    base.sort(key=lambda x: (x[0], rank(x[2])))
    # An added span inside a base span says nothing new: of those that start before it, the furthest end tells.
    starts, ends = [a for a, _, _ in base], list(itertools.accumulate((b for _, b, _ in base), max))
    return base, [x for x in added if not (k := bisect.bisect_right(starts, x[0])) or ends[k - 1] < x[1]]


def redact(text: str | None, mark: str = "<secret>") -> str | None:
    """The text with each maximal run of secret characters replaced by ``mark``; null stays null."""
    base, added = find_secrets(text)
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b, _ in sorted(base + added):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    if not merged:
        return text
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("base", T.ArrayType(SPAN)), T.StructField("added", T.ArrayType(SPAN)), T.StructField("redacted", T.StringType())])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: base spans, added entropy spans and, if asked for, the redacted text.

    One narrow pass, no shuffle. Null and empty texts have no spans; a null id stays null; repeated rows each give a row;
    an empty table gives an empty one. Only the two named columns are read, so others may have any name.
    """

    def factory():
        def work(ids, texts):
            found = [find_secrets(t) for t in texts]
            tell = lambda spans: [{"kind": k, "start": a, "end": b} for a, b, k in spans]
            return [ids, [tell(b) for b, _ in found], [tell(a) for _, a in found], [redact(t) if with_text else None for t in texts]]

        return work

    return map_rows(docs, [docs[id_col].cast("long"), docs[text_col]], SCHEMA, factory)


def with_redacted(docs: DataFrame, text_col: str = "text", name: str = "redacted") -> DataFrame:
    """``docs`` with a column of texts in which each secret is a mark, in one narrow pass.

    Null texts stay null; texts without a secret stay as they are, however long; a column of that name is replaced.
    """
    return add_columns(docs, text_col, T.StructType([T.StructField(name, T.StringType())]), lambda: lambda texts: [[redact(t) for t in texts]])


DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of ``documents``: counts and digest of the base spans, and all spans.

    Null and empty texts have none: zeros, the digest of nothing, an empty string. Null and repeated ids are rows like
    others; texts of any length are scanned whole in linear time; an empty table gives no rows; other columns are not read.
    """

    def factory():
        tell = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)

        def work(ids, bases, addeds):
            rows = [[tuple(s[k] for k in ("start", "end", "kind")) for s in b] for b in bases]
            more = [sorted(r + [tuple(s[k] for k in ("start", "end", "kind")) for s in a], key=lambda x: (x[0], KINDS.index(x[2]))) for r, a in zip(rows, addeds, strict=True)]
            counts = [[sum(k == kind for *_, k in r) for r in rows] for kind in KINDS[:3]]
            return [ids, *counts, [hashlib.sha256(tell(r).encode()).hexdigest() for r in rows], [tell(m) for m in more]]

        return work

    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    return map_rows(found, ["doc_id", "base", "added"], DIGEST, factory)

"""Removal of repeated passages: 50-byte strings that also start in an earlier document, found by suffix sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..deploy import ship
from .common import give_back, read_table
from .suffix_groups import suffix_array, suffix_arrays

__all__ = ["Units", "Windows", "first_orders", "op3_suffix_dedup", "remove_repeats"]

#: Bytes of a string that must not repeat, and of the grams that are sampled from it.
STRING, GRAM = 50, 28
#: Bytes of text in a unit of documents, which is what one task holds, and ranges of ids that units are made of.
UNIT_BYTES, RANGES = 5_000_000, 256
#: Strings that a window holds at most, and different windows that one sampled gram may have before they are dealt out singly.
PIECE, HOT_WINDOWS = STRING - GRAM + 1, 1_024
#: Places that are hashed at once, so that the arrays stay in the processor's cache.
BLOCK = 1 << 16
#: Bytes of a group beyond which it is sorted on its own, and of groups that are sorted together.
LARGE_GROUP, BATCH_BYTES = 8_192, 4_000_000

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; a view."""
    return np.ndarray(max(len(data) - 7, 0), "<u8", data, strides=(1,))


def _fold(words: np.ndarray, starts: np.ndarray, offsets: list, seed: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words at some offsets from each start."""
    x = seed
    for at in offsets:
        x = (x ^ words[starts + at]) * _ODD[0]
        x ^= x >> np.uint64(32)
    x *= _ODD[1]
    return x ^ (x >> np.uint64(29))


def _string_hashes(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return _fold(words, starts, [*range(0, STRING - 8, 8), STRING - 8], np.zeros(len(starts), np.uint64))


class Windows:
    """The strings of some texts, dealt to windows by the least gram hash each string holds.

    Equal strings have equal least grams wherever they stand, so they are in windows of one ``key``; each string is in
    one window. ``start`` is a window's first string in ``data``, ``n`` its number of strings (``PIECE`` at most, so at
    most 72 bytes), ``doc`` its text, ``tag`` a 63-bit hash of its bytes. A key is a bucket and 32 bits of the gram.
    """

    def __init__(self, texts: list[bytes], buckets: int):
        self.data, self.buckets = np.frombuffer(b"".join(texts), np.uint8), np.uint64(buckets)
        self.offsets = np.cumsum([0, *map(len, texts)])
        ends = self.offsets[1:] - STRING + 1
        count = len(self.data) - STRING + 1
        heads, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        borders = np.unique(np.concatenate([self.offsets[:-1], ends]))
        before = np.uint64(0)
        for low in range(0, count, BLOCK):
            high = min(low + BLOCK, count)
            least = self._least(low, high)
            edge = np.empty(high - low, bool)
            edge[0] = low == 0 or least[0] != before
            np.not_equal(least[1:], least[:-1], out=edge[1:])
            a, b = np.searchsorted(borders, [low, high])
            edge[borders[a:b] - low] = True
            at = np.flatnonzero(edge)
            heads.append(at + low)
            values.append(least[at])
            before = least[-1]
        head, value = np.concatenate(heads), np.concatenate(values)
        size = np.diff(np.append(head, max(count, 0)))
        doc = np.searchsorted(self.offsets, head, "right") - 1
        keep = head < ends[doc] if len(head) else np.zeros(0, bool)
        head, size, value, doc = head[keep], size[keep], value[keep], doc[keep]
        pieces = -(-size // PIECE)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.start = np.repeat(head, pieces) + nth * PIECE
        self.n = np.minimum(np.repeat(size, pieces) - nth * PIECE, PIECE)
        self.doc = np.repeat(doc, pieces)
        self.key = np.repeat(self._key(value), pieces)
        length = self.n + STRING - 1
        words = _words(self.data)
        self.tag = _fold(words, self.start, [0, 8, 16, 24, 32, 40, length - 24, length - 16, length - 8], self.n.astype(np.uint64)) >> np.uint64(1)

    def _least(self, low: int, high: int) -> np.ndarray:
        """The least hash of the grams of each string that starts in a range."""
        w = _words(self.data[low : high + STRING - 1]).astype(np.uint64)
        m = high - low + PIECE - 1
        x = w[:m] * _ODD[0]
        for at, odd in zip((8, 16, GRAM - 8), _ODD[1:], strict=True):
            x += w[at : at + m] * odd
        x ^= x >> np.uint64(32)
        x *= _ODD[0]
        x ^= x >> np.uint64(29)
        span = 1
        while 2 * span <= PIECE:
            x = np.minimum(x[:-span], x[span:])
            span *= 2
        return np.minimum(x[: high - low], x[PIECE - span : PIECE - span + high - low])

    def _key(self, value: np.ndarray) -> np.ndarray:
        return (value % self.buckets << np.uint64(32)) | (value // self.buckets & np.uint64(0xFFFFFFFF))

    def single(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(window, start, key, tag) of each string of some windows, keyed by the string itself."""
        n = self.n[windows]
        own = np.repeat(windows, n)
        start = self.start[own] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        value = _string_hashes(_words(self.data), start)
        return own, start, self._key(value), (value * _ODD[2] ^ (value >> np.uint64(31))) >> np.uint64(1)


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of some ranges, one range after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def first_orders(data: np.ndarray, sizes: np.ndarray, orders: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """For each string of each window, the least order among all windows of its group that hold the string.

    ``data`` holds the windows one after another; ``groups`` ascend. Windows none of whose strings has the hash of one of
    another window of the group are left out, as they hold nothing that repeats. Those left of one group are one text;
    its suffix array brings equal strings together, and each run of strings that agree in all ``STRING`` bytes gets the
    least order of its windows.
    """
    at = np.cumsum(sizes) - sizes
    n = sizes - STRING + 1
    result, own = np.repeat(orders, n), np.repeat(np.arange(len(sizes)), n)
    value = _string_hashes(_words(data), _spans(at, n)) ^ (groups[own].astype(np.uint64) * _ODD[2])
    rank = np.argsort(value, kind="stable")
    same = np.flatnonzero(~_edges(value[rank])[1:])
    a, b = own[rank[same]], own[rank[same + 1]]
    some = np.unique(np.concatenate([a[a != b], b[a != b]]))
    if not len(some):
        return result
    starts = np.cumsum(n) - n
    data, sizes, orders, groups = data[_spans(at[some], sizes[some])], sizes[some], orders[some], groups[some]
    at = np.concatenate([[0], np.cumsum(sizes)])
    heads = np.flatnonzero(_edges(groups))
    totals = np.add.reduceat(sizes, heads)
    low = at[heads]
    order = np.empty(len(data), np.int64)
    by_size = np.argsort(totals, kind="stable")
    small = by_size[totals[by_size] <= LARGE_GROUP]
    for batch in np.split(small, np.searchsorted(np.cumsum(totals[small]), np.arange(BATCH_BYTES, totals[small].sum(), BATCH_BYTES))):
        if len(batch):
            spots = _spans(low[batch], totals[batch])
            order[spots] = spots[suffix_arrays(data[spots], totals[batch])]
    for g in by_size[len(small) :]:
        order[low[g] : low[g] + totals[g]] = low[g] + np.array(suffix_array(data[low[g] : low[g] + totals[g]].tobytes()), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    strings = order[order + STRING <= at[owner[order] + 1]]
    new = np.ones(len(strings), bool)
    for begin in range(1, len(strings), 200_000):
        s = np.arange(begin, min(begin + 200_000, len(strings)))
        a, b = strings[s], strings[s - 1]
        same = groups[owner[a]] == groups[owner[b]]
        index = np.flatnonzero(same)
        same[index] = (data[a[index, None] + np.arange(STRING)] == data[b[index, None] + np.arange(STRING)]).all(1)
        new[s] = ~same
    marks = np.flatnonzero(new)
    least = np.minimum.reduceat(orders[owner[strings]], marks)
    found = np.empty(len(data), np.int64)
    found[strings] = np.repeat(least, np.diff(np.append(marks, len(strings))))
    n = sizes - STRING + 1
    result[_spans(starts[some], n)] = found[_spans(at[:-1], n)]
    return result


#: Rows of steps: what a unit has of a bucket, or a bucket says to a unit. h has 4 bytes an entry, v and orders 8, sizes 1, mask 4.
KEYS = "bucket int, unit int, h binary, v binary"
SHARED = "unit int, bucket int, h binary, v binary, status binary, mask binary"
PIECES = "bucket int, unit int, h binary, v binary, orders binary, sizes binary, data binary"


def _table(rows: list[tuple], text: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in text.split(", "))])
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _parts(values: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(value, places) for each value."""
    if not len(values):
        return []
    order = np.argsort(values, kind="stable")
    return [(int(values[p[0]]), p) for p in np.split(order, np.flatnonzero(_edges(values[order]))[1:])]


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column if x.is_valid), kind)


def _counts(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)) // width


def _windows(docs: pa.Table, buckets: int) -> tuple[Windows, np.ndarray]:
    """The windows of a unit and the order of each."""
    w = Windows([b"" if not t.is_valid else t.as_buffer() for t in docs.column("text")], buckets)
    return w, np.asarray(docs.column("order"))[w.doc]


class Units:
    """The steps of ``remove_repeats`` over the units and buckets of a table.

    ``ranges`` tells the range of ids of each unit. Ids of a later range are greater; the units of one range share its
    ids in any way, but all of them have one id where ``alone`` says so of the range.
    """

    def __init__(self, buckets: int, ranges: np.ndarray, alone: np.ndarray, hot: int):
        self.buckets, self.ranges, self.alone, self.hot = buckets, ranges, alone, hot

    def tell(self, docs: pa.Table) -> pa.Table:
        """The windows of a unit by bucket: gram, tag, and whether several documents of the unit have windows of the gram."""
        w, own = _windows(docs, self.buckets)
        if not len(w.key):
            return _table([], KEYS)
        rank = np.argsort(w.key)
        key, tag, own = w.key[rank], w.tag[rank], own[rank]
        heads = np.flatnonzero(_edges(key))
        many = np.minimum.reduceat(own, heads) != np.maximum.reduceat(own, heads)
        many = np.repeat(many, np.diff(np.append(heads, len(key))))
        # Equal windows that follow each other are told once; a few may stand apart, which does no harm.
        once = _edges(key, tag)
        key, tag = key[once], tag[once] << np.uint64(1) | many[once]
        unit, bucket = docs.column("unit")[0].as_py(), key >> np.uint64(32)
        return _table([(b, unit, key[p].astype("<u4").tobytes(), tag[p].tobytes()) for b, p in _parts(bucket)], KEYS)

    def judge(self, rows: pa.Table) -> pa.Table:
        """What becomes of the grams that several documents have windows of.

        0: all windows are one string, and an earlier range has it: it goes. 1: so, but this is the first unit, whose
        first document keeps it. 2: windows differ, or units of one range have them: they are to be sorted. 3: so, and
        there are so many that each string is dealt out by itself.
        """
        bucket = rows.column("bucket")[0].as_py()
        h, v = _joined(rows.column("h"), "<u4"), _joined(rows.column("v"), "<u8")
        unit = np.repeat(np.asarray(rows.column("unit")), _counts(rows.column("h"), 4))
        many = (v & np.uint64(1)).astype(bool)
        # Most grams are in one window of one unit: they are left before the full sort.
        rank = np.argsort(h)
        edge = np.append(_edges(h[rank]), True)
        rank = rank[~(edge[1:] & edge[:-1]) | many[rank]]
        rank = rank[np.lexsort((unit[rank], v[rank] >> np.uint64(1), h[rank]))]
        h, v, unit, many = h[rank], v[rank] >> np.uint64(1), unit[rank], many[rank]
        if not len(h):
            return _table([], SHARED)
        heads = np.flatnonzero(_edges(h))
        sizes = np.diff(np.append(heads, len(h)))
        spread = lambda x: np.repeat(x, sizes)
        range_ = self.ranges[unit]
        first, last = np.minimum.reduceat(range_, heads), np.maximum.reduceat(range_, heads)
        low, high = np.minimum.reduceat(unit, heads), np.maximum.reduceat(unit, heads)
        shared = (first != last) | ((low != high) & ~self.alone[first]) | np.logical_or.reduceat(many, heads)
        kinds = np.add.reduceat(_edges(h, v).astype(np.int64), heads)
        # Units of the first range, and whether they are several.
        leading = range_ == spread(first)
        several = np.maximum.reduceat(np.where(leading, unit, -1), heads) != low
        alike = np.where(~leading, 0, np.where(spread(several & ~self.alone[first]), 2, 1))
        status = np.where(spread(kinds) > self.hot, 3, np.where(spread(kinds) > 1, 2, alike))
        use = spread(shared) & ((status != 1) | many)
        h, unit, status = h[use], unit[use], status[use].astype(np.uint8)
        rank = np.lexsort((h, unit))
        h, unit, status = h[rank], unit[rank], status[rank]
        once = _edges(h, unit)
        h, unit, status = h[once], unit[once], status[once]
        return _table([(u, bucket, h[p].tobytes(), None, status[p].tobytes(), None) for u, p in _parts(unit)], SHARED)

    def _say(self, w: Windows, shared: pa.Table) -> np.ndarray:
        """What is said of each window; 9 for nothing."""
        use = shared.filter(pa.compute.is_valid(shared.column("status")))
        status = _joined(use.column("status"), np.uint8)
        if not len(status):
            return np.full(len(w.key), 9, np.uint8)
        keys = np.repeat(np.asarray(use.column("bucket")).astype(np.uint64) << np.uint64(32), _counts(use.column("status"), 1)) | _joined(use.column("h"), "<u4")
        rank = np.argsort(keys)
        keys, status = keys[rank], status[rank]
        at = np.minimum(np.searchsorted(keys, w.key), len(keys) - 1)
        return np.where(keys[at] == w.key, status[at], np.uint8(9))

    def send(self, docs: pa.Table, shared: pa.Table) -> pa.Table:
        """The windows, or single strings, of a unit that are to be sorted: each once, with the unit's least order of it."""
        if not docs.num_rows or not shared.num_rows:
            return _table([], PIECES)
        w, orders = _windows(docs, self.buckets)
        say = self._say(w, shared)
        two = np.flatnonzero(say == 2)
        own, start, key, tag = w.single(np.flatnonzero(say == 3))
        orders = np.concatenate([orders[two], orders[own]])
        key, tag, start = np.concatenate([w.key[two], key]), np.concatenate([w.tag[two], tag]), np.concatenate([w.start[two], start])
        size = np.concatenate([w.n[two] + STRING - 1, np.full(len(own), STRING)])
        rank = np.lexsort((orders, tag, key))
        rank = rank[_edges(key[rank], tag[rank])]
        key, tag, start, size, orders = key[rank], tag[rank], start[rank], size[rank], orders[rank]
        unit, out = docs.column("unit")[0].as_py(), []
        for b, p in _parts(key >> np.uint64(32)):
            out.append((b, unit, key[p].astype("<u4").tobytes(), tag[p].tobytes(), orders[p].tobytes(), size[p].astype(np.uint8).tobytes(), w.data[_spans(start[p], size[p])].tobytes()))
        return _table(out, PIECES)

    def sort(self, rows: pa.Table) -> pa.Table:
        """For each unit, a bit for each string of its windows: whether an earlier document of another unit has it."""
        bucket = rows.column("bucket")[0].as_py()
        sizes = _joined(rows.column("sizes"), np.uint8).astype(np.int64)
        unit = np.repeat(np.asarray(rows.column("unit")), _counts(rows.column("sizes"), 1))
        h, v, orders = _joined(rows.column("h"), "<u4"), _joined(rows.column("v"), "<u8"), _joined(rows.column("orders"), "<i8")
        data, at = _joined(rows.column("data"), np.uint8), np.cumsum(sizes) - sizes
        rank = np.lexsort((orders, v, h))
        once = _edges(h[rank], v[rank])
        chosen = rank[once]  # of equal windows, the first document's
        flat = first_orders(data[_spans(at[chosen], sizes[chosen])], sizes[chosen], orders[chosen], h[chosen])
        which = np.empty(len(rank), np.int64)
        which[rank] = np.cumsum(once) - 1
        n = sizes[chosen] - STRING + 1
        base = np.cumsum(n) - n
        mask = np.zeros(len(rank), np.uint32)
        for bit in range(int(n.max(initial=0))):
            has = np.flatnonzero(n[which] > bit)
            mask[has] |= (flat[base[which[has]] + bit] < orders[has]).astype(np.uint32) << np.uint32(bit)
        some = np.flatnonzero(mask)
        return _table([(u, bucket, h[some[p]].tobytes(), v[some[p]].tobytes(), None, mask[some[p]].tobytes()) for u, p in _parts(unit[some])], SHARED)

    def _gone(self, docs: pa.Table, shared: pa.Table) -> tuple[Windows, np.ndarray]:
        """The windows of a unit, and which bytes of its texts go."""
        w, orders = _windows(docs, self.buckets)
        change = np.zeros(len(w.data) + 1, np.int32)

        def drop(start: np.ndarray, n: np.ndarray | int) -> None:
            np.add.at(change, start, 1)
            np.add.at(change, start + n + STRING - 1, -1)

        say = self._say(w, shared)
        drop(w.start[say == 0], w.n[say == 0])
        some = np.flatnonzero((say == 1) | (say == 2))
        own, start, key, tag = w.single(np.flatnonzero(say == 3))
        n = np.concatenate([w.n[some], np.ones(len(own), np.int64)])
        start, orders = np.concatenate([w.start[some], start]), np.concatenate([orders[some], orders[own]])
        sorted_ = shared.filter(pa.compute.is_valid(shared.column("mask")))
        mask = _joined(sorted_.column("mask"), "<u4")
        theirs = np.repeat(np.asarray(sorted_.column("bucket")).astype(np.uint64) << np.uint64(32), _counts(sorted_.column("mask"), 4)) | _joined(sorted_.column("h"), "<u4")
        key, tag = np.concatenate([w.key[some], key, theirs]), np.concatenate([w.tag[some], tag, _joined(sorted_.column("v"), "<u8")])
        if len(start):
            # Equal windows of the unit and what is said of them, side by side.
            rank = np.lexsort((tag, key))
            group = np.empty(len(rank), np.int64)
            group[rank] = np.cumsum(_edges(key[rank], tag[rank])) - 1
            mine, groups = group[: len(start)], int(group.max()) + 1
            least, bits = np.full(groups, np.iinfo(np.int64).max), np.zeros(groups, np.uint32)
            np.minimum.at(least, mine, orders)
            bits[group[len(start) :]] = mask
            later = orders > least[mine]
            drop(start[later], n[later])
            bits = np.where(later, np.uint32(0), bits[mine])
            for bit in range(PIECE):
                hit = np.flatnonzero(bits >> np.uint32(bit) & np.uint32(1))
                drop(start[hit] + bit, 1)
        return w, np.cumsum(change[:-1], dtype=np.int32) > 0

    def cut(self, docs: pa.Table, shared: pa.Table, as_text: bool = False) -> pa.Table:
        """The rows of a unit with their texts cut."""
        w, gone = self._gone(docs, shared)
        columns: list[list] = [[] for _ in range(5)]
        for there, a, b in zip(docs.column("text").is_valid().to_pylist(), w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True):
            g, data = gone[a:b], w.data[a:b]
            removed = int(np.count_nonzero(g))
            kept = data[~g].tobytes() if removed else data.tobytes()
            spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + g[0]) if removed else 0
            digest = hashlib.sha256(kept).hexdigest()
            rest = (kept.decode("utf-8", "ignore") if as_text else kept) if there else None
            for column, value in zip(columns, (b - a, removed, spans, digest, rest), strict=True):
                column.append(value)
        kinds = [pa.int64()] * 3 + [pa.string(), pa.string() if as_text else pa.binary()]
        return pa.table([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), docs.column("rest")], names=[*CUT, "rest"])


CUT = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
_LAST = (1 << 63) - 1


def _deal(docs: DataFrame, order, text_col: str, unit_bytes: int) -> tuple:
    """The unit of each row as a column, with the range of each unit, and whether a range has one id only.

    At most ``RANGES`` ranges of ids are told apart by cuts on the driver; neighbours whose bytes fit one unit are
    joined, and a range with more is dealt to several units by a hash of id and text.
    """
    size = F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long")
    cuts = sorted(set(docs.select(F.percentile_approx(order, [k / RANGES for k in range(1, RANGES)], 10_000).alias("c")).first()["c"] or []))
    nth = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < order)) if cuts else F.lit(0)
    facts = docs.select(nth.alias("r"), order.alias("o"), size.alias("b")).groupBy("r").agg(F.sum("b").alias("b"), F.min("o").alias("low"), F.max("o").alias("high"))
    found = {r["r"]: r for r in facts.collect()}  # a row a range
    number, ranges, alone, spread, held = np.zeros(len(cuts) + 1, np.int64), [], [], [], 0
    for k in range(len(cuts) + 1):
        if k not in found:
            number[k] = max(len(ranges) - 1, 0)
            continue
        here = found[k]["b"]
        if ranges and spread[-1] == 1 and held + here <= unit_bytes:
            held, alone[-1] = held + here, False
        else:
            ranges.append(k)
            spread.append(max(1, -(-here // unit_bytes)))
            alone.append(found[k]["low"] == found[k]["high"])
            held = here
        number[k] = len(ranges) - 1
    spread = np.array(spread or [1], np.int64)
    base = np.cumsum(spread) - spread
    first = F.element_at(F.array(*[F.lit(int(base[r])) for r in number]), nth + 1)
    several = F.element_at(F.array(*[F.lit(int(spread[r])) for r in number]), nth + 1)
    unit = F.when(several == 1, first).otherwise(first + F.pmod(F.xxhash64(order, docs[text_col]), several)).cast("int")
    total = sum(r["b"] for r in found.values())
    return unit, np.repeat(np.arange(len(spread)), spread), np.array(alone or [True]), total


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int = UNIT_BYTES, hot_windows: int = HOT_WINDOWS, as_text: bool = False) -> DataFrame:
    """Each row with n_bytes, n_removed, n_spans, kept_sha256 and kept (binary): its text without repeated strings.

    A byte goes if a ``STRING``-byte string over it also starts in a row with a smaller id; the input decides, not what
    is left. Rows are dealt to units of about ``unit_bytes`` of text, by ranges of ids and within a large range by hash:

    1. each unit tells, by sampled gram, which windows it has (twelve bytes for each different one);
    2. by gram, windows that all are one and the same string have no order to find: all but the first unit's go. Where
       they differ, the units are asked for them, or for their single strings if one gram has very many;
    3. by gram, the different windows that may share a string are suffix-sorted, equal strings are told by all their
       bytes, and every string finds its first document; each unit gets a bit for each string of each window;
    4. each unit cuts its texts.

    Texts are shuffled once (the three steps over units share that exchange). A hot passage costs one entry for each
    unit, whatever its number of documents. Whole windows are taken for equal if the bucket, 32 bits of their gram's hash
    and a further 63-bit hash of all their bytes are equal; different strings of different windows never are.

    With ``as_text``, ``kept`` is a string without the halves of characters that cuts may leave. Null texts are empty,
    have nothing to remove and stay null in ``kept``. A null id is after all others; equal ids never
    remove from each other, whatever their number. A very long text is in a unit of its own. All columns but the text are
    kept as they are, in ``rest``, so that their names cannot clash. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    rest = F.struct(*[docs[c] for c in docs.columns if c != text_col])
    order = F.coalesce(docs[id_col].cast("long"), F.lit(_LAST))
    unit, ranges, alone, total = _deal(docs, order, text_col, unit_bytes)
    units = docs.select(unit.alias("unit"), order.alias("order"), docs[text_col].cast("binary").alias("text"), rest.alias("rest"))
    steps = Units(max(1, -(-total // unit_bytes)), ranges, alone, hot_windows)
    kinds = [T.LongType()] * 3 + [T.StringType(), T.StringType() if as_text else T.BinaryType()]
    out = T.StructType([*(T.StructField(c, k) for c, k in zip(CUT, kinds, strict=True)), T.StructField("rest", units.schema["rest"].dataType)])

    def run(step, *tables, **options):
        made = step(*tables, **options)
        give_back()
        return made

    # Functions of the steps, as Spark tells the number of tables by the signature.
    told = units.groupBy("unit").applyInArrow(lambda docs: run(steps.tell, docs), KEYS)
    shared = told.groupBy("bucket").applyInArrow(lambda rows: run(steps.judge, rows), SHARED)
    sent = units.groupBy("unit").cogroup(shared.groupBy("unit")).applyInArrow(lambda docs, shared: run(steps.send, docs, shared), PIECES)
    sorted_ = sent.groupBy("bucket").applyInArrow(lambda rows: run(steps.sort, rows), SHARED)
    answers = shared.unionByName(sorted_)
    return units.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(lambda docs, shared: run(steps.cut, docs, shared, as_text=as_text), out)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without the 50-byte strings that start in an earlier document too, as digests.

    Null texts are empty; null ids are after all others; other columns are not read; see ``remove_repeats``.
    """
    found = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("rest.doc_id").cast("long").alias("doc_id"), *CUT[:4])

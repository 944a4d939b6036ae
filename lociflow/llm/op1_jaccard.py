"""N-gram Jaccard join by chosen paths: sets are split on sampled shared tokens until buckets are small, in repeated runs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..deploy import ship
from .common import connected_components, give_back, local_components, map_rows, read_table, small_batches, write_shared

__all__ = ["jaccard_links", "op1_jaccard_join", "runs_for", "shingle_sets"]

WORDS, THRESHOLD = 5, 0.8
#: Chance that a pair at the threshold meets in some bucket.
TARGET_RECALL = 0.99999
#: Minhashes of a set. They are the tokens that paths are chosen on; their low bytes are the sketch that buckets compare.
TOKENS = 128
#: Standard errors that a sketch may fall short of the threshold.
SLACK = 4.0
#: Splits below the first that a pair is allowed for when runs are counted.
DEPTH = 2
SMALL_BUCKET, TASK_BUCKET = 64, 16_384
#: Sets, and bytes of sets, in one side of a verification task, and rows of pairs that are judged at once.
CHUNK_SETS, CHUNK_BYTES, SLICE = 3_072, 8_000_000, 256
#: Cluster members up to which their ids are broadcast to the documents' scan.
BROADCAST_IDS = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_WORD = np.zeros(256, bool)
_IS_WORD[np.r_[ord("0") : ord("9") + 1, ord("a") : ord("z") + 1, 128:256]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        base = 0x5851F42D4C957F2D
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            factors = np.full(size, b, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.multiply.accumulate(factors)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles.

    Words are runs of letters a-z, digits and characters beyond ASCII of the lower-cased text. A text of fewer words has
    one shingle, of all of them; one without words has none, nor has a null text.
    """
    out = []
    for text in texts:
        data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
        inside = np.concatenate([[False], _IS_WORD[data], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            out.append(np.zeros(0, np.uint64))
            continue
        up, down = _powers(len(data) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
        hashed = _mixed((sums[ends] - sums[starts]) * down[starts] + _ODD * (ends - starts).astype(np.uint64))
        n = min(words, len(hashed))
        total = np.zeros(len(hashed) - n + 1, np.uint64)
        for k in range(n):
            total = total * np.uint64(0xD6E8FEB86659FD93) + hashed[k : len(hashed) - n + 1 + k]
        out.append(np.unique(_mixed(total)))
    return out


def _set_key(s: np.ndarray) -> bytes:
    """24 bytes that tell sets apart."""
    return np.array([_mixed(s ^ _ODD).sum(), _mixed(s + _ODD).sum(), len(s)], np.uint64).tobytes()


_FACTORS = _mixed(np.arange(1, TOKENS + 1, dtype=np.uint64) * _ODD) | np.uint64(1)


def _minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, TOKENS) of 32-bit minhashes; every set must hold something."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), TOKENS), np.uint32)
    for i, f in enumerate(_FACTORS):
        out[:, i] = np.minimum.reduceat(((flat ^ (f >> np.uint64(7))) * f >> np.uint64(32)).astype(np.uint32), starts)
    # What is left of a minimum is small: spread it, so that low bytes are as good as any.
    return (_mixed(out.astype(np.uint64) + (_FACTORS << np.uint64(32))) >> np.uint64(32)).astype(np.uint32)


def runs_for(threshold: float, recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``, if each run splits ``depth`` times more."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** (depth + 1)))


SKETCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("mins", T.BinaryType())])
PATHS = T.StructType([T.StructField("path", T.LongType()), T.StructField("rep", T.LongType())])
PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
SETS = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("set", T.BinaryType())])
FOUND = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("n", T.LongType())])


def _near(sketches: np.ndarray, rows: np.ndarray, need: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows[k], j) whose sketches agree in at least ``need`` places."""
    step = max(1, 4_000_000 // max(1, sketches.size))
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        i, j = np.nonzero((sketches[part][:, None, :] == sketches[None]).sum(2, dtype=np.int16) >= need)
        yield part[i], j


def bucket_forest(sketches: np.ndarray, need: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over pairs of a bucket that agree in ``need`` places.

    Some pivots are compared with all rows. If they gather most of the bucket it cannot be split, and what they left is
    compared with all; so is a small bucket. Else it is split on sampled tokens, 1 / threshold of them on average, and
    the parts go on alone.
    """
    links: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(np.arange(len(sketches)), 0)]
    while todo:
        rows, depth = todo.pop()
        own = sketches[rows]
        m = len(rows)
        if m < 2:
            continue
        if m <= SMALL_BUCKET:
            links += [(rows[i], rows[j]) for i, j in _near(own, np.arange(m), need)]
            continue
        root = np.arange(m)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(8):
            sizes = np.bincount(root, minlength=m)
            pivot = int(rng.choice(np.flatnonzero(sizes[root] == sizes[root].min())))
            near = np.flatnonzero((own == own[pivot]).sum(1, dtype=np.int16) >= need)
            found.append((np.full(len(near), pivot), near))
            root = local_components(m, *(np.concatenate([f[k] for f in found]) for k in (0, 1)))
        links += [(rows[i], rows[j]) for i, j in found]
        sizes = np.bincount(root, minlength=m)
        if sizes.max() > m // 2 or depth >= 12:
            links += [(rows[i], rows[j]) for i, j in _near(own, np.flatnonzero(root != sizes.argmax()), need)]
            continue
        tokens = rng.permutation(own.shape[1])[: 1 + (rng.random() < 1 / THRESHOLD - 1)]
        for token in tokens:
            order = np.argsort(own[:, token], kind="stable")
            cuts = np.flatnonzero(np.diff(own[order, token])) + 1
            todo += [(rows[part], depth + 1) for part in np.split(order, cuts)]
    if not links:
        return np.zeros(0, int), np.zeros(0, int)
    root = local_components(len(sketches), np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]))
    other = np.flatnonzero(root != np.arange(len(root)))
    return root[other], other


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: frequent tokens by matrix products, rare ones by the pairs that share them."""
    sizes = [len(s) for s in left + right]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(np.concatenate(left + right), kind="stable")
    tokens, owner = np.concatenate(left + right)[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    counts = np.diff(np.append(starts, len(tokens)))
    out = np.zeros((len(left), len(right)), np.float32)
    flat = out.reshape(-1)
    for d in np.unique(counts[(counts > 1) & (counts < 48)]):
        groups = starts[counts == d]
        step = max(1, 1_000_000 // (d * d))
        for at in range(0, len(groups), step):
            own = owner[groups[at : at + step, None] + np.arange(d)]
            pairs = (own[:, :, None] < len(left)) & (own[:, None, :] >= len(left))
            cells = (own[:, :, None] * len(right) + own[:, None, :] - len(left))[pairs]
            np.add.at(flat, cells, np.float32(1))
    often = np.flatnonzero(counts >= 48)
    for at in range(0, len(often), 512):
        part = often[at : at + 512]
        rows = np.concatenate([owner[starts[t] : starts[t] + counts[t]] for t in part])
        held = np.zeros((len(sizes), len(part)), np.float32)
        held[rows, np.repeat(np.arange(len(part)), counts[part])] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out


def _verified(ids: np.ndarray, copies: np.ndarray, left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> list[tuple]:
    """(a, null, sum of linked copies) rows and (a, b, 0) forest rows of one pair of chunks; ``right`` None: the chunk with itself."""
    both = left + (right or [])
    sizes = np.array([len(s) for s in both], float)
    common = _overlaps(left, right if right is not None else left)
    links, forest = np.zeros(len(ids)), (np.zeros(0, np.int64), np.zeros(0, np.int64))
    root = np.arange(len(ids))
    # A slice of rows at a time, of whose links a forest is kept: a cluster of copies links nearly all pairs.
    for at in range(0, len(left), SLICE):
        a, b = np.nonzero(common[at : at + SLICE])
        shared = common[at : at + SLICE][a, b]
        a, b = a + at, b + (len(left) if right is not None else 0)
        keep = (ids[a] != ids[b]) & (shared >= threshold * (sizes[a] + sizes[b] - shared) * (1 - 1e-12))
        a, b = a[keep], b[keep]
        links += np.bincount(a, copies[b], len(ids))
        if right is not None:
            links += np.bincount(b, copies[a], len(ids))
        root = local_components(len(ids), np.concatenate([forest[0], a]), np.concatenate([forest[1], b]))
        other = np.flatnonzero(root != np.arange(len(ids)))
        forest = root[other], other
    some, edge = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(ids)))
    return [(int(ids[i]), None, int(links[i])) for i in some] + [(int(ids[i]), int(ids[root[i]]), 0) for i in edge]


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS, recall: float = TARGET_RECALL) -> DataFrame:
    """Rows (doc_id, n_links, component_id, kept, text_hash) for all rows of ``docs``: links are pairs with Jaccard >= ``threshold``.

    1. Documents with equal shingle sets are one class with a number and a count, gathered by a partial aggregate.
    2. Runs of chosen paths over the classes' minhash tokens: a run puts a class into the bucket of one sampled token;
       buckets beyond ``TASK_BUCKET`` are split on further tokens where that helps, and else compared in pairs of parts;
       a task splits its bucket on until parts are small. Sketches that agree enough, with ``SLACK`` standard errors
       left, join a cluster; only forests leave the tasks.
    3. Within clusters all pairs of sets are verified exactly, in pairs of chunks bounded in rows and bytes. Each pair is
       compared once, since a class has one cluster. Sums of links and forests of true links leave the tasks.

    ``n_links`` counts all other documents linked directly, copies included; ``component_id`` is the smallest doc_id that
    links reach; ``kept`` marks it; ``text_hash`` (xxhash64 of the text) tells rows of one id apart, which may be in
    different classes. Documents without words, null ids and null texts link with nothing. Repeated rows are copies. Very
    long texts are one set like others. Other columns of ``docs`` are not read, whatever their names. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))

    def sketch():
        def work(ids, hashes, texts):
            sets = shingle_sets(texts, words)
            full = [i for i, s in enumerate(sets) if len(s) and ids[i] is not None]
            mins = _minhashes([sets[i] for i in full]) if full else []
            keys, blobs = [None] * len(ids), [None] * len(ids)
            for i, m in zip(full, mins, strict=True):
                keys[i], blobs[i] = _set_key(sets[i]), m.tobytes()
            return [ids, hashes, keys, [len(s) for s in sets], blobs]

        return work

    sketched = write_shared(map_rows(rows, ["doc_id", "text_hash", "text"], SKETCH, sketch), "sketches")
    # The smallest id of a class brings its tokens along. Classes have numbers, since two may have one smallest id.
    classes = sketched.filter("key is not null").groupBy("key").agg(F.min(F.struct("doc_id", "n", "mins")).alias("m"), F.count("*").alias("copies"))
    reps = write_shared(classes.select("key", F.monotonically_increasing_id().alias("rep"), F.col("m.doc_id").alias("first"), F.col("m.n").alias("n"), F.col("m.mins").alias("mins"), "copies"), "classes")

    runs = runs_for(threshold, recall)
    need = math.ceil(TOKENS * (threshold - SLACK * math.sqrt(threshold * (1 - threshold) / TOKENS)))

    def paths():
        def work(ids, mins):
            tokens = np.frombuffer(b"".join(mins), np.uint32).reshape(-1, TOKENS)[:, :runs].astype(np.uint64)
            keyed = _mixed(tokens + (np.arange(1, runs + 1, dtype=np.uint64) << np.uint64(32)))
            return [keyed.view(np.int64).reshape(-1), np.repeat(np.array(ids, np.int64), runs)]

        return work

    path = write_shared(map_rows(reps, ["rep", "mins"], PATHS, paths), "paths")
    sketches = reps.select("rep", F.col("mins").alias("mins"))
    live = path.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
    held = write_shared(path.join(live, "path").join(sketches, "rep").select("path", "size", "rep", "mins"), "buckets")
    edges = []
    depth = 0
    while True:
        small, hot = held.filter(F.col("size") <= TASK_BUCKET), held.filter(F.col("size") > TASK_BUCKET)
        edges.append(_bucket_edges(small.withColumn("i", F.lit(0)).withColumn("j", F.lit(0)).withColumn("side", F.lit(0)), need, f"edges{depth}"))
        if hot.isEmpty():
            break
        if depth >= DEPTH:
            # Not worth splitting any more: parts of the bucket are compared in pairs.
            parts = F.ceil(2 * F.col("size") / TASK_BUCKET).cast("int")
            part = F.pmod(F.xxhash64("rep", F.lit(depth)), parts).cast("int")
            spread = hot.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
            spread = spread.select("path", "size", "rep", "mins", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"))
            edges.append(_bucket_edges(spread, need, f"parts{depth}"))
            break
        # The next token of each path is sampled by the path itself; every fourth path takes two.
        token = lambda k: F.substring(F.col("mins"), F.pmod(F.xxhash64("path", F.lit(k)), F.lit(TOKENS)).cast("int") * 4 + 1, F.lit(4))
        onward = F.when(F.pmod(F.xxhash64("path", F.lit(7)), F.lit(4)) == 0, F.array(F.xxhash64("path", F.lit(1), token(1)), F.xxhash64("path", F.lit(2), token(2)))).otherwise(F.array(F.xxhash64("path", F.lit(1), token(1))))
        depth += 1
        split = write_shared(hot.select(F.explode(onward).alias("path"), "rep", "mins"), f"split{depth}")
        live = split.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
        held = write_shared(split.join(live, "path").select("path", "size", "rep", "mins"), f"buckets{depth}")
    candidates = edges[0]
    for more in edges[1:]:
        candidates = candidates.unionByName(more)

    clusters = write_shared(connected_components(candidates, "clusters").withColumnRenamed("node", "rep").withColumnRenamed("component", "cluster"), "members")
    found = write_shared(_verify(rows, reps, clusters, threshold, words), "verified")
    parts = connected_components(found.filter("b is not null").select("a", "b"), "classes")
    links = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    smallest = parts.join(reps.select(F.col("rep").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("component_id"))
    parts = parts.join(smallest, "component").select(F.col("node").alias("rep"), "component_id")
    facts = reps.select("key", "rep", "first", "copies").join(links, "rep", "left").join(parts, "rep", "left")
    facts = facts.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    out = sketched.select("doc_id", "text_hash", "key").join(facts, "key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "text_hash")


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal keys of sorted batches."""
    current, held = None, []
    for batch in small_batches(batches):
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != current:
                if held:
                    yield current, held
                current, held = key, []
            held.append(row)
    if held:
        yield current, held


def _bucket_edges(held: DataFrame, need: int, name: str) -> DataFrame:
    """Forest edges of all buckets, or of pairs of parts (i, j) of one, each wholly in one task."""

    def run(batches):
        for key, rows in _grouped(batches, ("path", "i", "j")):
            ids = np.array([r["rep"] for r in rows], np.int64)
            sketches = np.frombuffer(b"".join(r["mins"] for r in rows), np.uint32).reshape(-1, TOKENS).astype(np.uint8)
            a, b = bucket_forest(sketches, need, np.random.default_rng(abs(key[0])))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=PAIR.names)
        give_back()

    sent = held.select("path", "i", "j", "rep", "mins").repartition("path", "i", "j").sortWithinPartitions("path", "i", "j")
    return write_shared(sent.mapInArrow(run, PAIR), name)


def _verify(rows: DataFrame, reps: DataFrame, clusters: DataFrame, threshold: float, words: int) -> DataFrame:
    """Exact links within clusters: (a, null, n) sums and (a, b, 0) forest edges."""
    sized = reps.select("rep", "key", "first", "n", "copies").join(clusters, "rep")
    totals = sized.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum(F.col("n") * 8).alias("bytes"))
    chunks = F.greatest(F.ceil(F.col("sets") / CHUNK_SETS), F.ceil(F.col("bytes") / CHUNK_BYTES)).cast("int")
    sized = write_shared(sized.join(totals.select("cluster", chunks.alias("chunks")), "cluster"), "chunks")
    firsts, wanted = sized.select(F.col("first").alias("doc_id")).distinct(), sized.select("key", "rep", "cluster", "chunks", "copies")
    if sized.count() <= BROADCAST_IDS:
        firsts, wanted = F.broadcast(firsts), F.broadcast(wanted)

    # Rows of an id may be of any class, so sets find theirs by key. Repeated rows of a task are one.
    def sets():
        seen: set[bytes] = set()

        def work(texts):
            out: dict[bytes, bytes] = {}
            for s in shingle_sets(texts, words):
                key = _set_key(s)
                if key not in seen:
                    seen.add(key)
                    out[key] = s.tobytes()
            return [list(out), list(out.values())]

        return work

    full = map_rows(rows.join(firsts, "doc_id", "left_semi"), ["text"], SETS, sets).join(wanted, "key")
    chunk = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    spread = full.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    spread = spread.select("cluster", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "rep", "copies", "set")

    def run(batches):
        for (_, i, j), members in _grouped(batches, ("cluster", "i", "j")):
            unique = list({r["rep"]: r for r in members}.values())
            left, right = [r for r in unique if r["chunk"] == i], [r for r in unique if r["chunk"] == j]
            if len(unique) < 2 or not left or not right:
                continue
            ordered = left if i == j else left + right
            ids, copies = (np.array([r[k] for r in ordered], np.int64) for k in ("rep", "copies"))
            decode = lambda part: [np.frombuffer(r["set"], np.uint64) for r in part]
            found = _verified(ids, copies, decode(left), None if i == j else decode(right), threshold)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=FOUND.names)
        give_back()

    return spread.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(run, FOUND)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and classes of all ``documents``."""
    return jaccard_links(read_table(spark, sf_dir, "documents"))

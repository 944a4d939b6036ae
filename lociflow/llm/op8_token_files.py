"""Token-id files: frequency-ranked ids in a byte-aligned code with separate control bytes."""

from __future__ import annotations

import itertools
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_folder, drop_shared, map_rows, read_table, shared_dir, small_batches, write_shared
from .word_ids import WordIds

__all__ = ["decode_values", "encode_values", "op8_token_files", "read_token_files", "tokenize", "write_token_files"]

MAGIC = b"LFTK\x01"
END_ID = 1
#: Words that a worker remembers; other operators, which share workers within the pipeline, remember fewer.
MEMO_WORDS = 2_000_000
#: Tokens that a block holds at most, unless one document alone has more.
BLOCK_TOKENS = 1 << 20
#: Tokens of a part, which one task sorts and writes; beyond ``MOST_PARTS`` parts, these grow instead.
PART_TOKENS, MOST_PARTS = 1 << 23, 1 << 16

#: By control byte: bytes that each of its four values takes, less one.
_VALUES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """``(control, data)``: two bits a value give its length of 1 to 4 bytes; the data bytes are little-endian."""
    control, data, _, _ = _encode(np.asarray(values, np.uint32), np.array([len(values)]))
    return control.tobytes(), data.tobytes()


def _encode(v: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control and data bytes of the values of some documents, with the places between documents in each. The control
    bytes of each document start on a byte of their own."""
    code = (v > 0xFF).astype(np.uint8)
    wide = 4 if v.max(initial=0) > 0xFFFF else 2
    if wide > 2:
        code += (v > 0xFFFF).astype(np.uint8) + (v > 0xFFFFFF)
    groups = -(-lengths // 4)
    ends, group_ends = np.cumsum(lengths), np.cumsum(groups)
    padded = np.zeros(4 * int(groups.sum()), np.uint8)
    padded[_filled(lengths, groups)] = code
    control = padded[::4].copy()
    for k in (1, 2, 3):
        control |= padded[k::4] << np.uint8(2 * k)
    data = v.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide)[_taken(code, wide)]
    return control, data, np.concatenate([[0], group_ends]), np.concatenate([[0], ends + np.concatenate([[0], np.cumsum(code, dtype=np.int64)])[ends]])


def _filled(lengths: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Marks of the places in groups of four that values take; the last group of a document may have up to three others."""
    marks, ends = np.ones(4 * int(groups.sum()), bool), 4 * np.cumsum(groups)
    spare = 4 * groups - lengths
    for k in (1, 2, 3):
        marks[ends[spare >= k] - k] = False
    return marks


def _taken(code: np.ndarray, wide: int) -> np.ndarray:
    """Marks of the bytes, of ``wide`` each value has, that are written of it: one more than its code."""
    marks = np.empty((len(code), wide), bool)
    marks[:, 0] = True
    for k in range(1, wide):
        np.greater_equal(code, k, out=marks[:, k])
    return marks


def decode_values(control: bytes, data: bytes, slots: int | np.ndarray) -> np.ndarray:
    """The values at ``slots`` (or the first so many): lengths by table lookup of the control bytes, which tell whose each data byte is."""
    codes = _VALUES[np.frombuffer(control, np.uint8)].reshape(-1)
    codes = codes[:slots] if isinstance(slots, int) else codes[slots]
    wide = 4 if codes.max(initial=0) > 1 else 2
    out, taken = np.zeros((len(codes), wide), np.uint8), _taken(codes, wide)
    out[taken] = np.frombuffer(data, np.uint8)[: np.count_nonzero(taken)]
    return out.view(f"<u{wide}").ravel().astype(np.uint32, copy=False)


TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("nth", T.LongType()), T.StructField("ids", T.BinaryType())])


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Rows (doc_id, n_tokens, nth, ids): little-endian unsigned ids of ``width`` bytes (2 or 4), ``end_id`` last.

    ``nth`` numbers a task's rows, which tells rows of one id apart. Null and empty texts are the end id alone; very long
    ones are encoded whole; repeated rows are rows of their own; null ids stay null; an empty table gives no rows; other
    columns are not read. Two bytes hold every id of a vocabulary of at most 65,536; with a larger one, ``width`` is 4.
    """
    kind = f"<u{width}"

    def factory():
        words = WordIds.load(path, width, MEMO_WORDS)
        if width < 4 and words.tokenizer.get_vocab_size() > 1 << 8 * width:
            raise ValueError("ids of this vocabulary need a width of 4")
        end, seen = np.asarray([end_id], kind).tobytes(), itertools.count()

        def work(ids, texts):
            blobs = [b + end for b in words.encode(texts)]
            return [ids, [len(b) // width for b in blobs], [next(seen) for _ in ids], blobs]

        return work

    return map_rows(docs, [docs[id_col].cast("long"), docs[text_col]], TOKENS, factory)


COUNTS = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])
BLOCK = T.StructType([T.StructField("first_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("payload", T.BinaryType())])


def _flat(blobs, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a batch of blobs, and how many each blob has."""
    places = np.frombuffer(blobs.buffers()[1], "<i4")[blobs.offset : blobs.offset + len(blobs) + 1]
    return np.frombuffer(blobs.buffers()[2] or b"", np.uint8)[places[0] : places[-1]].view(f"<u{width}"), np.diff(places).astype(np.int64) // width


def _frequencies(tokens: DataFrame, width: int) -> list[tuple[int, int]]:
    """Counts of all ids, most frequent first; as many rows as the vocabulary has ids at most."""

    def count(batches):
        total = np.zeros(1, np.int64)
        for b in small_batches(batches, 8_000_000):
            got = np.bincount(_flat(b.column(0), width)[0])
            if len(got) > len(total):
                got, total = total, got.astype(np.int64)
            total[: len(got)] += got
        import pyarrow as pa

        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, COUNTS).groupBy("id").agg(F.sum("n").alias("n")).collect()
    return sorted(((r["id"], r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


def _pack(docs: list[tuple[int | None, int, bytes, bytes]], start: int) -> bytes:
    """One block of (doc_id, tokens, control, data): magic, counts, doc ids, null marks, lengths, all control bytes, all data bytes.

    A document's control bytes start on a byte of their own, so the bytes of documents can be joined as they are.
    """
    control, data = (b"".join([d[k] for d in docs]) for k in (2, 3))
    head = MAGIC + struct.pack("<qqqq", start, len(docs), len(control), len(data))
    names = np.asarray([d[0] or 0 for d in docs], "<i8").tobytes() + bytes(d[0] is None for d in docs)
    return head + names + np.asarray([d[1] for d in docs], "<i8").tobytes() + control + data


def _unpack(payload: bytes) -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
    """``(start, doc ids, lengths, ranks)`` of a block."""
    if payload[: len(MAGIC)] != MAGIC:
        raise ValueError("not a block of token ids")
    start, n, n_control, n_data = struct.unpack_from("<qqqq", payload, len(MAGIC))
    at = len(MAGIC) + 32
    docs, nulls = np.frombuffer(payload, "<i8", n, at).tolist(), payload[at + 8 * n : at + 9 * n]
    lengths = np.frombuffer(payload, "<i8", n, at + 9 * n)
    at += 17 * n
    # The last control byte of a document may have unused values; they take no data.
    ranks = decode_values(payload[at : at + n_control], payload[at + n_control : at + n_control + n_data], _filled(lengths, -(-lengths // 4)))
    return start, [None if z else d for d, z in zip(docs, nulls, strict=True)], lengths, ranks


class Deal:
    """Parts of a table in ascending id order, as even as their cuts: a part ends with the ids that equal its upper cut.

    Ids that equal one or more cuts are dealt by ``nth`` over all parts that such cuts border, in which they are first
    or last, so that no id is too frequent for a part. Null ids are before all others.
    """

    def __init__(self, cuts: list[int]):
        self.cuts = np.sort(np.asarray(cuts, np.int64))

    def parts(self, ids: list[int | None], nth: list[int]) -> np.ndarray:
        v = np.array([NULL_ID if i is None else i for i in ids], np.int64)
        low, high = np.searchsorted(self.cuts, v, "left"), np.searchsorted(self.cuts, v, "right")
        return low + np.asarray(nth, np.int64) % (high - low + 1)


NULL_ID = -(1 << 63)
SUMS = T.StructType([T.StructField("part", T.LongType()), T.StructField("n", T.LongType())])


def _starts(dealt: DataFrame, deal: Deal) -> dict[int, int]:
    """By part, the tokens before it."""

    def add(batches):
        import pyarrow as pa

        total = np.zeros(len(deal.cuts) + 1, np.int64)
        for b in batches:
            np.add.at(total, deal.parts(b.column(0).to_pylist(), b.column(1).to_pylist()), np.asarray(b.column(2).to_pylist(), np.int64))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=SUMS.names)

    sums = {r["part"]: r["n"] for r in dealt.select("doc_id", "nth", "n_tokens").mapInArrow(add, SUMS).groupBy("part").agg(F.sum("n").alias("n")).collect()}
    starts, total = {}, 0
    for k in sorted(sums):
        starts[k], total = total, total + sums[k]
    return starts


def write_token_files(tokens: DataFrame, path: str, partitions: int | None = None, width: int = 2) -> None:
    """Write rows of ``tokenize`` to ``path/blocks`` in ascending doc_id order, with ``path/ranks`` beside.

    Ids are renumbered by falling frequency over all rows, so that frequent ones take one byte. Blocks are binary values
    in Parquet containers, since only Spark's writers reach every store; each is self-contained but for the ranks. There
    are ``partitions`` parts, by default as many as the tokens ask for (``PART_TOKENS``); each is a task and a file. Null
    ids come first; rows with one id follow each other in any order. The driver gets one count for each id of the
    vocabulary and one token sum for each part, both bounded whatever the rows.
    """
    spark = tokens.sparkSession
    found = _frequencies(tokens, width)
    ranked = [i for i, _ in found]
    rank = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    spark.createDataFrame([(r, i) for r, i in enumerate(ranked)], "rank int, id long").coalesce(1).write.parquet(f"{path}/ranks")
    n = partitions or min(max(1, -(-sum(k for _, k in found) // PART_TOKENS)), MOST_PARTS)
    # Bounds come from the id column alone, so that no text or id list is read twice to sample it.
    known = F.coalesce(F.col("doc_id"), F.lit(NULL_ID))
    cuts = tokens.select(F.percentile_approx(known, [k / n for k in range(1, n)], max(10_000, 100 * n)).alias("c")).first()["c"] if n > 1 else None
    deal = Deal(cuts or [])
    dealt = tokens if "nth" in tokens.columns else tokens.withColumn("nth", F.lit(0))
    ranks, starts = spark.sparkContext.broadcast(rank), spark.sparkContext.broadcast(_starts(dealt, deal))

    def coded(batches):
        import pyarrow as pa

        def blobs(data: np.ndarray, places: np.ndarray) -> pa.Array:
            return pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places.astype("<i4")), pa.py_buffer(data)])

        for b in small_batches(batches):
            flat, lengths = _flat(b.column(2), width)
            control, data, control_places, data_places = _encode(ranks.value[flat], lengths)
            parts = deal.parts(b.column(0).to_pylist(), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.int32()), pa.array(lengths), blobs(control, control_places), blobs(data, data_places)], names=CODED.names)

    def blocks(batches):
        import pyarrow as pa

        held, size, at, part, k = [], 0, 0, None, 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int64()), pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([_pack(held, at)], pa.binary())], names=BLOCK.names)

        for b in small_batches(batches):
            for d, p, n, control, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (p != part or size + n > BLOCK_TOKENS):
                    yield flush()
                    at, k, held, size = at + size, k + 1, [], 0
                if p != part:
                    part, at, k = p, starts.value[p], 0
                held.append((d, n, control, data))
                size += n
        if held:
            yield flush()

    sent = dealt.select("doc_id", "nth", "ids").mapInArrow(coded, CODED).repartitionById(n, "part").sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    sent.mapInArrow(blocks, BLOCK).write.option("compression", "zstd").parquet(f"{path}/blocks")


CODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("n_tokens", T.LongType()), T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType())])
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids, ids_crc32) from files of ``write_token_files``; ids are decoded from the blocks."""
    ranks = spark.read.schema("rank int, id long").parquet(f"{path}/ranks").orderBy("rank").collect()
    shared = spark.sparkContext.broadcast(np.asarray([r["id"] for r in ranks], "<u4"))

    def factory():
        def work(payloads):
            out = [[], [], [], [], []]
            for payload in payloads:
                start, docs, lengths, ranks = _unpack(payload)
                ids, ends = shared.value[ranks] if len(ranks) else np.zeros(0, "<u4"), np.cumsum(lengths)
                for d, n, e in zip(docs, lengths.tolist(), ends.tolist(), strict=True):
                    blob = ids[e - n : e].tobytes()
                    for column, v in zip(out, (d, start + e - n, n, blob if with_ids else None, zlib.crc32(blob)), strict=True):
                        column.append(v)
            return out

        return work

    return map_rows(spark.read.schema(BLOCK).parquet(f"{path}/blocks"), ["payload"], T.StructType([*DOCS.fields, T.StructField("ids_crc32", T.LongType())]), factory)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text of ``documents``, write the token files in doc_id order, read them back and digest what they hold.

    Null and empty texts are the end id alone. Rows with one id follow each other in any order, null ids come first; an
    empty table gives no rows; very long texts are blocks of their own; other columns are not read. The files are
    deleted when they have been read.
    """
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/lociflow-token-files-{uuid.uuid4().hex}"
    tokens = write_shared(tokenize(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), "tokens")
    try:
        write_token_files(tokens, path)
        drop_shared(tokens)
        return write_shared(read_token_files(spark, path, with_ids=False).drop("ids"), "token-digests")
    finally:
        drop_folder(spark, path)

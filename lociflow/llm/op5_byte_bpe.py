"""Byte-level BPE by longest matches and backtracking over adjacent-token compatibility."""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import Memo, map_rows, read_table

__all__ = ["ByteBpe", "decode_ids", "encode_documents", "op5_byte_bpe"]

_LOADED: dict[tuple[str, str], ByteBpe] = {}


class ByteBpe:
    """Encoder and decoder for a file of base64 tokens and ranks; ids are the ranks.

    Bytes are mapped to Latin-1 characters for pyahocorasick. One automaton pass over a piece gives every token in it;
    the encoder then walks the piece with the longest token at each place, goes to the next shorter one where two
    neighbours could not both come out of the merges, and steps back where none is left. A place that failed is never
    tried again, so the work is linear in the piece. ``limit`` bounds the memo of chunks, which has two generations: what
    is still in use moves from the old one to the new one. Pairs have a memo of twice as many entries.
    """

    def __init__(self, path: str, pattern: str, limit: int = 800_000):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks, self.limit = {token.decode("latin-1"): rank for token, rank in ranks.items()}, limit
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = [len(t) for t in self.tokens]
        self.deepest = max(self.lengths)
        # The libraries' white space is Unicode's property; Python's also has four control characters.
        white = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.pattern = regex.compile(white)
        self.runs = regex.compile(r"\p{White_Space}{3,}|\p{White_Space}{2,}\Z")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = [(k, k) for k in range(len(self.tokens))]
        self.made = bytearray(len(self.tokens))
        self.memo = Memo(self._learn, limit)
        self.width, self.kind = (2, "H") if len(self.tokens) <= 1 << 16 else (4, "I")
        for rank, token in enumerate(self.tokens):
            if len(token) == 1:
                self.made[rank] = 1
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k], rank), ranks.get(token[k:], rank)
                if a < rank and b < rank and self.made[a] and self.made[b] and self._compatible(a, b):
                    self.merged[a, b], self.halves[rank], self.made[rank] = rank, (a, b), 1
                    break
        # By prefix of a token, the longest token that it starts with; by token, the next shorter one.
        self.automaton, self.within, self.shorter = ahocorasick.Automaton(), {}, [-1] * len(self.tokens)
        for rank in sorted(range(len(self.tokens)), key=self.lengths.__getitem__):
            if self.made[rank]:  # a token that no merges make can only be a whole piece
                text = self.tokens[rank].decode("latin-1")
                self.automaton.add_word(text, rank)
                best = -1
                for k in range(1, len(text)):
                    best = self.within.setdefault(text[:k], best)
                self.shorter[rank], self.within[text] = best, rank
        self.automaton.make_automaton()
        self.feed = self._piece("\n")
        self.marks = {c: self._piece(c) for c in ".,;:!?"}
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        texts = [b"%d," % k for k in range(len(self.tokens))]
        digits = np.array(texts).view(np.uint8).reshape(len(texts), -1)
        self.digits = digits, np.array([len(t) for t in texts], np.int64)

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        """One instance per Python worker, so that reused workers keep what they know."""
        if (path, pattern) not in _LOADED:
            _LOADED[path, pattern] = cls(path, pattern)
        return _LOADED[path, pattern]

    def _compatible(self, left: int, right: int) -> bool:
        """Can ``left`` and ``right`` stand side by side in the result of the merges?

        They can if, undoing merges latest first along the border, no pair of parts that face each other would have
        merged before the merge that hides them.
        """
        a, b, before = left, right, 1 << 62
        while True:
            rank = self.merged.get((a, b))
            if rank is not None and rank < before:
                return False
            a_part, b_part = self.halves[a][1], self.halves[b][0]
            if a_part == a and b_part == b:
                return True
            # Undo the later merge; of equal ones, the right one, as merges run from the left.
            if b_part == b or (a_part != a and a > b):
                before, a = a, a_part
            else:
                before, b = b + 1, b_part

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece, as merging its bytes by rank gives them."""
        return tuple(self._ids(piece.decode("latin-1")))

    def _ids(self, text: str) -> list[int]:
        """Ids of a piece of Latin-1 characters that stand for bytes.

        Ids whose neighbours all are compatible are the only such ones. So the automaton's longest matches from left to
        right are taken as they are if they fit, and are otherwise the start of the search.
        """
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        if len(self.pairs) > 2 * self.limit:
            self.pairs.clear()
        ids, pairs = [rank for _, rank in self.automaton.iter_long(text)], self.pairs
        last, fits = ids[0] if ids else -1, bool(ids)
        for rank in ids[1:]:
            fits = pairs.get((last, rank))
            if fits is None:
                fits = pairs[last, rank] = self._compatible(last, rank)
            if not fits:
                break
            last = rank
        return ids if fits and sum(map(self.lengths.__getitem__, ids)) == len(text) else self._search(text)

    def _search(self, text: str) -> list[int]:
        """Longest match at each place, its next shorter one where two neighbours don't fit, a step back where none is left."""
        n, pairs, shorter, lengths = len(text), self.pairs, self.shorter, self.lengths
        dead, ids, at = bytearray(n + 1), [], 0
        rank = self._longest(text, 0)
        while at < n:
            while rank >= 0:
                if not dead[at + lengths[rank]]:
                    if not ids:
                        break
                    fits = pairs.get((ids[-1], rank))
                    if fits is None:
                        fits = pairs[ids[-1], rank] = self._compatible(ids[-1], rank)
                    if fits:
                        break
                rank = shorter[rank]
            if rank >= 0:
                ids.append(rank)
                at += lengths[rank]
                rank = self._longest(text, at) if at < n else -1
            else:
                if not ids:
                    raise ValueError("the vocabulary lacks a byte")
                dead[at] = 1
                rank = ids.pop()
                at -= lengths[rank]
                rank = shorter[rank]
        return ids

    def _longest(self, text: str, at: int) -> int:
        """The longest token that starts at a place, -1 if none does: as far as the trie goes, and back to a token."""
        text = text[at : at + self.deepest]
        return self.within.get(text[: self.automaton.longest_prefix(text)], -1)

    def _piece(self, piece: str) -> bytes:
        ids = self._ids(piece if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("latin-1"))
        return struct.pack(f"<{len(ids)}{self.kind}", *ids)

    def _learn(self, chunk: str) -> bytes:
        """Ids of a chunk: what stands between two spaces, or from a line feed to a space, which it then starts with.

        A chunk that starts with no line feed has a space before it.
        """
        head, body = (self.feed, chunk[1:]) if chunk[:1] == "\n" else (b"", chunk)
        if body.isalpha():
            ids = head + self._piece(body if head else " " + body)
        elif body[-1:] in self.marks and body[:-1].isalpha():
            ids = self.memo[chunk[:-1]] + self.marks[body[-1]]
        else:
            ids = head + b"".join([self._piece(p) for p in self.pattern.findall(body if head else " " + body)])
        if len(chunk) <= 64:
            self.memo[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned numbers of ``width`` bytes; a null text is empty.

        A piece starts at every space or line feed, but within a run of three or more white characters (two at the end),
        all of which but the last are one piece. So runs are cut out, and the chunks between them are looked up.
        """
        if not text:
            return b""
        self.memo.age()
        out, at = [], 0
        for run in self.runs.finditer(text):
            out.append(self._chunks(text[at : run.start()]))
            at = run.end() - (run.end() < len(text))
            out.append(self._piece(text[run.start() : at]))
        out.append(self._chunks(text[at:] if at else text))
        return b"".join(out)

    def _chunks(self, text: str) -> bytes:
        """Ids of a text without long runs of white characters. A line feed is put before it, so that it starts as a line does."""
        if not text:
            return b""
        words = ("\n" + text).replace("\n", " \n").split(" ")
        del words[0]
        return b"".join(map(self.memo.__getitem__, words))[len(self.feed) :]

    def decimal(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Decimal ids, each with a comma after it, and the bytes that each takes."""
        sizes = self.digits[1][ids]
        return self.digits[0][ids][np.arange(self.digits[0].shape[1]) < sizes[:, None]].tobytes(), sizes

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of the ids' tokens, joined, and the bytes of each: table look-ups for all ids at once."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self.places[ids] - ends + sizes, sizes)
        places += np.arange(len(places))
        return self.bytes[places].tobytes(), sizes


IDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids): whole texts as little-endian unsigned 32-bit ids.

    Null and empty texts have no ids. Very long texts are encoded whole, repeated rows each for itself; null ids stay
    null, an empty table gives no rows, and no other column is read.
    """

    def factory():
        bpe = ByteBpe.load(path, pattern)

        def work(names, texts):
            got = [np.frombuffer(bpe.encode(t), f"<u{bpe.width}").astype("<u4") for t in texts]
            return [names, [len(g) for g in got], [g.tobytes() for g in got]]

        return work

    return map_rows(docs, [docs[id_col].cast("long"), docs[text_col]], IDS, factory)


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, data): the bytes of rows of ``encode_documents``; null ids are none."""

    def factory():
        bpe = ByteBpe.load(path, pattern)
        return lambda names, ids: [names, [bpe.decode(np.frombuffer(i or b"", "<u4"))[0] for i in ids]]

    return map_rows(encoded, ["doc_id", "ids"], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("data", T.BinaryType())]), factory)


DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def digests(bpe: ByteBpe, texts: list[str | None]) -> list[list]:
    """Lists of token counts and of hex digests of the decimal ids and of the decoded bytes, for texts of one batch."""
    blobs = [bpe.encode(t) for t in texts]
    counts = np.array([len(b) // bpe.width for b in blobs], np.int64)
    ends = np.cumsum(counts)

    def digest(data: bytes, sizes: np.ndarray, comma: int) -> list[str]:
        at = np.concatenate([[0], np.cumsum(sizes)])
        lows, highs = at[ends - counts].tolist(), at[ends].tolist()
        view = memoryview(data)
        return [hashlib.sha256(view[a : max(a, b - comma)]).hexdigest() for a, b in zip(lows, highs, strict=True)]

    ids = np.frombuffer(b"".join(blobs), f"<u{bpe.width}")
    return [counts.tolist(), digest(*bpe.decimal(ids), 1), digest(*bpe.decode(ids), 0)]


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded again, as digests: one narrow pass.

    Null and empty texts have no ids, and the digests of nothing. Repeated rows and ids, very long texts and null ids are
    rows like others; an empty table gives no rows; other columns are not read.
    """
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN

    def factory():
        bpe = ByteBpe.load(path, pattern)
        return lambda names, texts: [names, *digests(bpe, texts)]

    docs = read_table(spark, sf_dir, "documents")
    return map_rows(docs, [docs["doc_id"].cast("long"), "text"], DIGEST, factory)

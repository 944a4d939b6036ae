"""Kernels of the training-data operators against brute force."""

from __future__ import annotations

import base64
import hashlib
import pickle
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lociflow.llm.common import local_components
from lociflow.llm.op1_jaccard import bucket_forest, runs_for, shingle_sets
from lociflow.llm.op2_multi_index import fit_index, multi_sequence
from lociflow.llm.op4_bitsliced import BitSlicedBlock
from lociflow.llm.op5_byte_bpe import ByteBpe, digests
from lociflow.llm.op6_packing import plan_bins
from lociflow.llm.op7_toxicity import LevenshteinTrie, Lexicon
from lociflow.llm.op8_token_files import Deal, decode_values, encode_values
from lociflow.llm.op10_secrets import find_secrets, redact
from lociflow.llm.suffix_groups import suffix_array, suffix_arrays
from lociflow.llm.word_ids import WordIds

public_tokenizers = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXT = st.text(alphabet=st.sampled_from("aeiothnrsÀéÿß \n\t.,'  \x1cΣİ12%&日本👍"), max_size=60)


@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_suffix_arrays(texts):
    lengths = np.array([len(t) for t in texts], np.int64)
    got = suffix_arrays(np.frombuffer(b"".join(texts), np.uint8), lengths)
    at = 0
    for t in texts:
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert suffix_array(t) == want
        assert (got[at : at + len(t)] - at).tolist() == want
        at += len(t)


@given(st.lists(st.integers(1, 20), max_size=40))
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit_decreasing(items):
    rooms: list[int] = []
    for n in sorted(items, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms[rooms.index(min(fits))] -= n
        else:
            rooms.append(20 - n)
    placed = defaultdict(list)
    count = Counter()
    for length, _, n, first, offset in plan_bins(Counter(items), 20):
        count[length] += n
        for k in range(n):
            placed[first + k].append((offset, length))
    assert count == Counter(items)
    assert len(placed) == len(rooms)
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 20


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
@settings(deadline=None)
def test_value_code_round_trip(values):
    control, data = encode_values(np.array(values, np.uint32))
    assert decode_values(control, data, len(values)).tolist() == values


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference_bpe():
    tiktoken = pytest.importorskip("tiktoken")
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(texts=st.lists(TEXT, max_size=4))
@settings(max_examples=400, deadline=None)
def test_bpe_equals_library(bpe, reference_bpe, texts):
    want = [reference_bpe.encode_ordinary(t) for t in texts]
    assert [np.frombuffer(bpe.encode(t), "<u2").tolist() for t in texts] == want
    counts, ids, data = digests(bpe, texts)
    assert counts == [len(w) for w in want]
    assert ids == [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in want]
    assert data == [hashlib.sha256(t.encode()).hexdigest() for t in texts]


def test_bpe_long_and_null(bpe, reference_bpe):
    for text in ("ab" * 20_000, " " * 500, "x" * 3_000 + "é" * 3_000, "\n\n\na \n b\t \tc  \n", " a", "\u2003\u2003 a"):
        assert np.frombuffer(bpe.encode(text), "<u2").tolist() == reference_bpe.encode_ordinary(text)
    assert bpe.encode(None) == b""
    assert digests(bpe, []) == [[], [], []]


def test_memos_stay_right_when_full(reference_bpe):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("aeinrst.,é", k=rng.randint(1, 9))) for _ in range(30)) for _ in range(40)]
    small = ByteBpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, limit=50)
    assert [np.frombuffer(small.encode(t), "<u2").tolist() for t in texts] == [reference_bpe.encode_ordinary(t) for t in texts]
    library, words = Tokenizer.from_file(WORDS), WordIds(WORDS, limit=50)
    assert [np.frombuffer(w, "<u4").tolist() for w in words.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


#: A library object of our own, which the operator's code never touches.
LIBRARY = Tokenizer.from_file(WORDS)


@given(text=st.lists(st.one_of(TEXT, st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|"])), max_size=4).map("".join))
@settings(max_examples=400, deadline=None)
def test_word_ids_equal_library(text):
    assert np.frombuffer(WordIds.load(WORDS).encode([text])[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_word_ids_of_special_strings():
    words = WordIds.load(WORDS, 2)
    for text in ("<|endoftext|>", "hello <|endoftext|> world", "in<|endoftext|>side", "<|startoftext|>a b", "a b<|endoftext|>"):
        got = np.frombuffer(words.encode([text])[0], "<u2").tolist()
        assert got == LIBRARY.encode(text, add_special_tokens=False).ids
        assert {49406, 49407} & set(got)


def test_deal_of_parts():
    deal = Deal([10, 10, 10, 20])
    assert deal.parts([5, 11, 20, 21, None], [0] * 5).tolist() == [0, 3, 3, 4, 0]
    assert sorted(set(deal.parts([10] * 8, list(range(8))).tolist())) == [0, 1, 2, 3]


@given(st.integers(1, 90), st.integers(1, 5), st.integers(0, 2**32), st.integers(1, 7))
@settings(max_examples=60, deadline=None)
def test_bit_sliced_top(rows, width, seed, k):
    rng = np.random.default_rng(seed)
    values, query = rng.integers(-4, 5, (rows, width)), rng.integers(-4, 5, width)
    own = int(rng.integers(rows))
    want = sorted(((-int(v @ query), i) for i, v in enumerate(values) if i != own))[:k]
    assert [(-s, r) for r, s in BitSlicedBlock(values).top(query, k, own)] == want


def test_multi_sequence_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(9), rng.random(7)
    got = multi_sequence(a, b, 1.1)
    costs = [a[i] + b[j] for i, j in got]
    assert costs == sorted(costs)
    assert set(got) == {(i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= 1.1}


def test_index_reaches_neighbours():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = fit_index(x, 20_000)
    turn = rng.standard_normal(x.shape)
    turn -= (turn * x).sum(1)[:, None] * x
    near = 0.95 * x + np.sqrt(1 - 0.95**2) * turn / np.linalg.norm(turn, axis=1)[:, None]
    visits, cells = index.visits(x), index.cells(near)
    hit = [c in v for c, v in zip(cells.tolist(), visits, strict=True)]
    assert np.mean(hit) > 0.97
    assert index.reaches(x, cells).tolist() == hit


def test_bucket_forest_finds_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (40, 128)).astype(np.uint8)
    copies = np.repeat(base, 5, 0)
    flips = rng.random(copies.shape) < 0.05
    copies[flips] = rng.integers(0, 256, flips.sum())
    a, b = bucket_forest(copies, 84, rng)
    root = local_components(len(copies), a, b)
    assert (root == np.repeat(np.arange(0, 200, 5), 5)).mean() > 0.9
    assert runs_for(0.8, 0.99999) == 17


def test_shingles():
    one, two, none, null, short = shingle_sets(["A b, c D e f", "a b c d e f!", " ,. ", None, "x y"])
    assert one.tolist() == two.tolist()
    assert (len(one), len(none), len(null), len(short)) == (2, 0, 0, 1)


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@given(st.lists(st.text("abc", min_size=1, max_size=10), max_size=6), st.text("abc", max_size=11))
@settings(max_examples=300, deadline=None)
def test_levenshtein_trie(entries, word):
    weights = {e: float(k) for k, e in enumerate(dict.fromkeys(entries))}
    want = [w for e, w in weights.items() if _edits(e, word) <= 1 + (len(e) >= 8)]
    assert LevenshteinTrie(weights).find(word) == max(want, default=None)


def test_lexicon_and_context():
    lexicon = Lexicon({"moron": 5.0, "idiotic": 5.0}, {"bad": 2.0})
    assert lexicon.find("moron") == (5.0, 0)
    assert lexicon.find("badly") == (2.0, 1)
    assert lexicon.find("bad") is None
    assert lexicon.find("morron") == (5.0, 2)
    assert lexicon.find("maroons") is None
    abuse, quote = lexicon.features("you are a moron today"), lexicon.features('he wrote "what a moron" today')
    assert abuse[0] > quote[0]
    assert lexicon.features(None) == lexicon.features("") == [0.0] * 8


def test_misspelt_entries_under_stems():
    lexicon = Lexicon({"idiot": 4.0}, {"scumba": 3.0}, {"scumbag": 5.0})
    assert lexicon.find("scumbags") == (3.0, 1)  # as it is: the stem's
    assert lexicon.find("scunbag") == (5.0, 2)
    assert lexicon.find("skumbaloon") == (3.0, 2)  # an edit in the stem, and more letters after it
    assert lexicon.find("skunbaloon") is None
    assert pickle.loads(pickle.dumps(lexicon)).find("scunbag") == (5.0, 2)
    assert Lexicon({"idiot": 4.0}, {}, known={"idiom": 3}).find("idiom") is None
    for text in ("you id1ot", "you i-d-i-o-t", "you id_iot", "you sc*mbag"):
        words, hits = lexicon.hits(text)
        assert [(k, kind) for k, _, kind in hits] == [(1, 2)]
    assert lexicon.hits("an id-card, it's a well-known lot")[1] == []
    assert [h[0] for h in lexicon.hits("what.idiot")[1]] == [1]


def test_wide_quotations():
    def quoted(text: str) -> bool:
        lexicon = Lexicon({"moron": 5.0}, {})
        words, hits = lexicon.hits(text)
        return lexicon._quoted(text, words, [h[0] for h in hits]) == [True]

    assert quoted('"' + "plain words " * 30 + 'moron" he read')
    assert quoted("“one line\nand a moron on the next” it was")
    assert quoted("he said that you are all such a moron")
    assert not quoted("he said that you are all of you without a doubt a moron")
    assert not quoted('"a" moron "b"')
    assert not quoted('a 5" pipe, moron')


def test_secrets():
    text = 'x PassWord = "abc" token=secret:abcdefgh1 AKIA0123456789ABCD ' + "0123456789abcdef" * 2 + " api_key: Zq8-"
    base, added = find_secrets(text)
    assert [(text[a:b], k) for a, b, k in base] == [("AKIA0123456789ABCD", "access"), ("0123456789abcdef" * 2, "hex")]
    key = "aG9mZ2hL9xQ2vB7nM4kP1sD8"
    text = f"see {key}, and 123e4567-e89b-12d3-a456-426614174000 or example-key-0123456789-abcdef"
    base, added = find_secrets(text)
    assert not base
    assert added and all(text[a:b] in key for a, b, _ in added)
    assert redact(text) != text
    assert find_secrets(None) == find_secrets("") == ([], [])
    assert redact(None) is None


@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=30))
@settings(deadline=None)
def test_local_components(links):
    a, b = (np.array([x[k] for x in links], int) for k in (0, 1))
    root = local_components(16, a, b)
    reach = {i: {i} for i in range(16)}
    for _ in range(16):
        for x, y in links:
            both = reach[x] | reach[y]
            for z in both:
                reach[z] = reach[z] | both
    assert root.tolist() == [min(reach[i]) for i in range(16)]


def test_placeholder_beside_a_key():
    key = "9fK2mQ7xLp4Zt8Rw3Vb6Yc1N"
    for text in (f"example_client_id={key}", f"examples/cfg/{key}", f"{key}/xxxx"):
        assert any(a <= text.index(key) and text.index(key) + len(key) <= b for a, b, _ in find_secrets(text)[1])
        assert key not in redact(text)
    for text in ("example-9fK2mQ7xLp4Zt", "9fK2mQ7xLpxxxx4Zt8Rw3Vb6", "example/550e8400-e29b-41d4-a716-446655440000"):
        assert find_secrets(text)[1] == []


def test_forms_of_a_word_are_remembered_when_they_come_again():
    words = WordIds(WORDS, 2)
    want = np.asarray(LIBRARY.encode("Qwzrtéx, vbnmkl", add_special_tokens=False).ids, "<u2").tobytes()
    for known in ({"qwzrtéx", "vbnmkl"}, {"qwzrtéx", "vbnmkl", "Qwzrtéx"}, {"qwzrtéx", "vbnmkl", "Qwzrtéx", "Qwzrtéx,"}):
        assert words.encode(["Qwzrtéx, vbnmkl"]) == [want]
        assert set(words.memo) <= known and {"qwzrtéx", "vbnmkl"} <= set(words.memo)
    words.encode(["Qwzrtéx, Qwzrtéx,"] * 2)
    assert "Qwzrtéx," in words.memo and words.encode(["Qwzrtéx, vbnmkl"]) == [want]


def test_token_codes_need_few_bytes_a_value():
    import tracemalloc

    from lociflow.llm.op8_token_files import _encode, _pack, _unpack

    values, lengths = (np.arange(200_000) * 7 % 40_000).astype(np.uint32), np.array([0, 1, 99_998, 5, 99_996])
    tracemalloc.start()
    control, data, at, places = _encode(values, lengths)
    coding = tracemalloc.get_traced_memory()[1]
    block = _pack([(k, int(n), control[at[k] : at[k + 1]].tobytes(), data[places[k] : places[k + 1]].tobytes()) for k, n in enumerate(lengths)], 0)
    tracemalloc.reset_peak()
    before, got = tracemalloc.get_traced_memory()[0], _unpack(block)[3]
    decoding = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert np.array_equal(got, values)
    assert coding < 24 * len(values) and decoding < 16 * len(values), (coding, decoding)

"""Whole-text ids of a ``tokenizers`` vocabulary that drops white space, with a bounded memo of words per Python worker."""

from __future__ import annotations

import os
import re

from .common import Memo

__all__ = ["WordIds"]

#: White space that the tokenizer's own pattern and Python agree on; words between it are encoded on their own.
_SPACES = re.compile(r"[ \t\n\r]+")
#: Other characters that Python's ``split`` takes for white space; texts with one are split by the pattern above.
_OTHER_SPACES = ["\x0b", "\x0c", *map(chr, range(0x1C, 0x20)), "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
#: Marks that compose with no letter.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LOADED: dict[tuple[str, int], WordIds] = {}
#: Letters whose lower case and composition are plain; a word of them is one piece of the tokenizer's pattern.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """Characters beyond ASCII of plain words as byte-level vocabularies write them: printable Latin-1 bytes stand for
    themselves, the others for the characters from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(other)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class WordIds:
    """Ids of texts as little-endian unsigned numbers of ``width`` bytes, 4 or 2: the library's own, with its defaults.

    The vocabulary splits at white space before anything else, and its normalisation (composition, lower case) never
    crosses white space, so a text's ids are the ids of its words in order. Only the strings of added tokens are looked
    for in the text itself; a text that holds one goes through the library whole. ``limit`` bounds the memo's entries: it
    has two generations, and words still in use move from the old one to the new one when the new one is full.
    """

    def __init__(self, path: str, width: int = 4, limit: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        # A token that is looked for after normalisation could be in any text.
        self.added = [""] if any(t.normalized for t in added) else [t.content for t in added]
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.model._resize_cache(0)  # words are remembered here
        self.width, self.memo = width, Memo(self._learn, limit)
        self.packed = [k.to_bytes(width, "little") for k in range(min(self.tokenizer.get_vocab_size(), 1 << 8 * width))]
        self.tails: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, width: int = 4, limit: int = 500_000) -> WordIds:
        """One instance per Python worker, so that reused workers keep what they know; the last ``limit`` holds."""
        if (path, width) not in _LOADED:
            _LOADED[path, width] = cls(path, width, limit)
        _LOADED[path, width].memo.limit = limit
        return _LOADED[path, width]

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.tokenizer.encode(text, add_special_tokens=False).ids))

    def _learn(self, word: str) -> bytes:
        """Ids of an unknown word; one that ends in a letter and marks of punctuation is two parts, as marks are one piece.

        Most words come once: of a new one, the plain lower case alone is remembered, and other forms when they come again.
        """
        memo = self.memo
        if word.isalpha() and (word.isascii() or _PLAIN.fullmatch(word)):
            low = word.lower()
            if low != word and (ids := memo.get(low) or memo.old.get(low)) is not None:
                memo[word] = ids
                return ids
            # One piece: the model alone gives what the whole tokenizer would.
            packed = self.packed
            ids = b"".join([packed[t.id] for t in self.model.tokenize(low if low.isascii() else low.translate(self.letters))])
            word = low
        # The lower case of one letter ends in a mark, hence the last character of it.
        elif word[-1] in _MARKS and (core := word.rstrip(_MARKS)) and core[-1].lower()[-1].isalpha():
            tail = word[len(core) :]
            after = self.tails.get(tail)
            if after is None:
                after = self._whole(tail)
                if len(tail) <= 3:  # of which there are few
                    self.tails[tail] = after
            ids = memo.get(core) or memo.old.get(core)
            if ids is None:
                return self._learn(core) + after
            ids += after
        else:
            ids = self._whole(word)
        if len(word) <= 64:  # very long words are not kept
            memo[word] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """A null text is empty."""
        out, find = [], self.memo.__getitem__
        for text in texts:
            if not text:
                out.append(b"")
            elif any(a in text for a in self.added):
                out.append(self._whole(text))
            else:
                self.memo.age()
                words = [w for w in _SPACES.split(text) if w] if any(map(text.__contains__, _OTHER_SPACES)) else text.split()
                out.append(b"".join(map(find, words)))
        return out

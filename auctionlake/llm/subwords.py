"""Whole texts to ids of a public tokenizer file, with words looked up once per worker.

Texts repeat their words, and white space always ends a pre-token of such files, so a text's ids are the ids of its
words one after the other. Each distinct word goes through the tokenizers library once and is then kept in a bounded
table of the Python worker. Files of another make are encoded text by text.
"""

from __future__ import annotations

import json
import os
import re
import weakref
from array import array
from collections.abc import Iterable
from itertools import islice
from string import punctuation

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from .common import kept_in_worker


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level files write for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: The pre-tokens of the public files: contractions, runs of letters, single digits, runs of other characters.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Below this character texts are in composed form and lower case is one and the same in all libraries.
PLAIN = "\u0250"
beyond_plain = re.compile(f"[^\0-{chr(ord(PLAIN) - 1)}]").search


class Words(dict):
    """Ids of words by word; one that is not held is encoded when it is looked up."""

    def __init__(self, coder: Subwords, held: Iterable[tuple[bytes, bytes]] = ()):
        super().__init__(held)
        self.coder = coder

    def __missing__(self, word: bytes) -> bytes:
        got = self.coder.older.get(word) or self.coder.word(word)
        self.coder.keep(word, got)
        return got


class Subwords:
    """Ids of texts as little-endian unsigned 16-bit (or, for large vocabularies, 32-bit) integers in bytes.

    ``kept`` bounds the words and the word parts held: a full table of words is set aside, and the next one takes over what
    is still used; a full table of parts starts again from empty. Letters before marks are kept as a word of their own.
    """

    def __init__(self, path: str, kept: int = 250_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.kept = kept
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.marks = [t["content"].lower().encode() for t in made.get("added_tokens") or []]
        self.hint = os.path.commonprefix(self.marks)  # stands in every text that holds a mark
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = (
            len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("invert") is True
            and steps[0].get("behavior") == "Removed" and r"\s" in steps[0]["pattern"]["Regex"]
            and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
            and any(n.get("type") == "Lowercase" for n in (made.get("normalizer") or {}).get("normalizers", []))
            and not made.get("post_processor")
        )
        if self.by_word:
            self.pieces = regex.compile(steps[0]["pattern"]["Regex"]).findall
            self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
            self.runs = steps[0]["pattern"]["Regex"] == RUNS
            self.plain = {"NFC", "Lowercase"} <= {n.get("type") for n in made["normalizer"]["normalizers"]} <= {"NFC", "Lowercase", "Replace"}
            self.tokenize, self.normalize = self.tokenizer.model.tokenize, self.tokenizer.normalizer.normalize_str
        self.words = Words(weakref.proxy(self))
        self.older: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def whole(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.asarray(ids, self.dtype).tobytes()

    def made(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.tokenize(shown)]).tobytes()

    def part(self, piece: str) -> bytes:
        got = self.parts.get(piece)
        if got is None:
            got = self.made(piece)
            if len(self.parts) >= self.kept:
                self.parts.clear()
            self.parts[piece] = got
        return got

    def word(self, word: bytes) -> bytes:
        """Ids of one word without blanks, A-Z lower-cased."""
        text = word.decode("utf-8", "replace")
        if not text.isprintable():  # libraries differ in which control characters are white space
            return self.whole(word)
        plain = text.isascii()
        if not plain:
            plain = self.plain and not beyond_plain(text)
            text = text.lower() if plain else self.normalize(text)
        if plain and self.runs:  # letters alone, or before marks, need no search
            letters = text.rstrip(punctuation)
            if letters.isalpha():
                if len(letters) == len(text):
                    return self.made(letters)
                return self.stem(letters) + self.part(text[len(letters):])
        pieces = self.pieces(text)
        if len(pieces) == 1:  # kept as a word, not as a part as well
            return self.parts.get(pieces[0]) or self.made(pieces[0])
        return b"".join(map(self.part, pieces))

    def stem(self, letters: str) -> bytes:
        """Ids of the letters before a word's marks, which other words share."""
        key = letters.encode()
        got = self.words.get(key) or self.older.get(key)
        if got is None:
            got = self.made(letters)
            self.keep(key, got)
        return got

    def keep(self, word: bytes, ids: bytes) -> None:
        if len(self.words) >= self.kept:  # words still in use come back from the older table
            self.older = {}
            self.older = dict(self.words)
            self.words.clear()
        self.words[word] = ids

    def settle(self, most: int = 60_000) -> None:
        """Let go of all but the ``most`` words met first, which hold the frequent ones: what a worker keeps while it waits for tasks."""
        self.older, self.parts = {}, {}
        self.words = Words(weakref.proxy(self), islice(self.words.items(), most))
        pa.default_memory_pool().release_unused()

    def one(self, word: bytes) -> bytes:
        """Ids of one word without blanks, A-Z lower-cased, special tokens' strings included."""
        got = self.words.get(word)
        if got is None:
            got = self.older.get(word)
            if got is None:
                got = self.whole(word) if not self.by_word or self.marked(word) else self.word(word)
            self.keep(word, got)
        return got

    def marked(self, folded: bytes) -> bool:
        """Whether a special token's own string stands in the text; such texts are encoded as a whole."""
        return bool(self.marks) and self.hint in folded and any(m in folded for m in self.marks)

    def text(self, text: bytes | None) -> bytes:
        """Ids of a whole text; null has none."""
        if not text:
            return b""
        folded = text.lower()
        if not self.by_word or self.marked(folded):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, folded.split()))


@kept_in_worker(2)
def subwords(path: str) -> Subwords:
    """One table per Python worker and file."""
    return Subwords(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Default place of a public vocabulary file; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)

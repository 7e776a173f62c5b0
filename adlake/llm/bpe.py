"""Token ids of a byte-level BPE vocabulary, as the ``tokenizers`` library gives them.

Text is encoded in units, a run of white space with what follows up to the next space.
The vocabulary's splitting pattern never lets a token cross from a character that isn't
white space to one that is, so the ids of a text are those of its units in order, and a
unit that recurs is encoded once. A cut where white space stands on both sides isn't
made: there the pattern looks ahead. A line's end between other characters is a token of its
own, and letters end where something else begins, so units with such places are made of
parts that recur more often.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"

#: Units kept in each of two generations, and the longest that are kept.
KEPT = 400_000
LONGEST = 40

#: Units of these characters are split here; the library splits the others itself.
PLAIN = regex.compile(r"[\n -~À-ɏ]*")
LETTERS_END = "\u0250"

#: A word of letters with other characters after it.
TAILED = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([^\w\s].*)", re.DOTALL)


def byte_letters() -> dict[int, str]:
    """The letter by which the vocabulary writes each byte: itself if it prints, else
    the next free one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


def _joins(word: str) -> bool:
    """Whether the space before ``word`` may be part of a longer run of white space."""
    return not word or word[0].isspace()


def _letters(word: str) -> bool:
    """Whether a word is all letters, and of those that are split here."""
    return word.isalpha() and (word.isascii() or max(word) < LETTERS_END)


class Encoder:
    """Ids of texts, as little-endian bytes of ``dtype``."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.special = {t["id"]: t["content"] for t in described["added_tokens"]}
        size = max([*described["model"]["vocab"].values(), *self.special]) + 1
        self.dtype = np.dtype(width(path))
        self.packed = "<%dH" if self.dtype.itemsize == 2 else "<%dI"
        letters = byte_letters()
        self.space = letters[ord(" ")]
        self.letters = {b: ord(c) for b, c in letters.items()}
        back = {ord(c): b for b, c in letters.items()}
        self.bytes_of = [b""] * size
        for token, id in described["model"]["vocab"].items():
            self.bytes_of[id] = bytes(back[ord(c)] for c in token)
        for id, token in self.special.items():
            self.bytes_of[id] = token.encode()
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}

    def _merge(self, written: str) -> bytes:
        """Ids of one match of the splitting pattern, in the vocabulary's letters."""
        found = [token.id for token in self.model.tokenize(written)]
        return struct.pack(self.packed % len(found), *found)

    def _piece(self, piece: str) -> bytes:
        ids = self.tokens.get(piece)
        if ids is None:
            ids = self._merge(piece.encode().decode("latin-1").translate(self.letters))
            if len(self.tokens) >= KEPT:
                self.tokens = {}
            if len(piece) <= LONGEST:
                self.tokens[piece] = ids
        return ids

    def unit(self, text: str) -> bytes:
        """Ids of a text by itself."""
        if PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join([self._piece(piece) for piece in self.pieces.findall(text)])
        found = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(self.packed % len(found), *found)

    def _alone(self, text: str) -> bytes:
        """Ids of a text by itself that may recur."""
        ids = self.tokens.get(text)
        if ids is None:
            ids = self.unit(text)
            if len(self.tokens) >= KEPT:
                self.tokens = {}
            self.tokens[text] = ids
        return ids

    def _spaced(self, word: str) -> bytes:
        """Ids of a space and ``word``."""
        ids = self.old.get(word)
        if ids is None:
            if _letters(word):
                written = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                ids = self._merge(self.space + written)
            elif word[-1] in ".,;:" and _letters(word[:-1]):
                ids = self._kept(word[:-1]) + self._piece(word[-1])
            else:
                before, end, after = word.partition("\n")
                if end and not before[-1].isspace() and not _joins(after):
                    return self._kept(before) + self._piece(end) + self._line(after)
                tailed = TAILED.fullmatch(word)
                if tailed and len(word) <= LONGEST:
                    ids = self._kept(tailed[1]) + self._alone(tailed[2])
                else:
                    ids = self.unit(" " + word)
        if len(word) <= LONGEST:
            if len(self.young) >= KEPT:
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def _kept(self, word: str) -> bytes:
        return self.young.get(word) or self._spaced(word)

    def _line(self, text: str) -> bytes:
        """Ids of what begins a line."""
        if text[-1] in ".,;:" and _letters(text[:-1]):
            return self._piece(text[:-1]) + self._piece(text[-1])
        return self._piece(text) if _letters(text) else self.unit(text)

    def parts(self, text: str) -> tuple[list[str], list[bytes]]:
        """Units of a text, which make it up when joined by spaces, and their ids."""
        words = text.split(" ")
        get = self.young.get
        ids = [get(word) for word in words]
        ids[0] = None
        missing = [i for i, part in enumerate(ids) if part is None]
        if any(_joins(words[i]) for i in missing[1:]):
            return self._merged(words)
        ids[0] = self.unit(words[0])
        for i in missing[1:]:
            ids[i] = self._spaced(words[i])
        return words, ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text."""
        return b"".join(self.parts(text)[1])

    def encode_all(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """Ids of each of many texts, with ``end`` after them: words that recur among these
        are looked up once, and the ids are put together as arrays."""
        if not len(texts):
            return pa.array([], pa.large_binary())
        split = pc.split_pattern(texts, " ")
        starts = split.offsets.to_numpy()
        words, firsts = split.flatten(), starts[:-1] - starts[0]
        of_text = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(starts))
        later = np.ones(len(words), bool)
        later[firsts] = False
        coded = words.filter(pa.array(later)).dictionary_encode()
        found = coded.dictionary.to_pylist()
        joins = np.fromiter(map(_joins, found), bool, len(found))
        get = self.young.get
        ids = [b"" if join else get(w) or self._spaced(w) for w, join in zip(found, joins.tolist(), strict=True)]
        codes = np.empty(len(words), np.int32)
        codes[later] = coded.indices.to_numpy()
        # A text's first word stands for itself, or for all of a text with longer white space.
        merged = np.zeros(len(texts), bool)
        merged[of_text[later][joins[codes[later]]]] = True
        for i, word in enumerate(words.take(pa.array(firsts)).to_pylist()):
            ids.append(self.encode(texts[i].as_py()) if merged[i] else self.unit(word))
        ids.append(end)
        codes[firsts] = len(found) + np.arange(len(texts))
        used = ~(later & merged[of_text])
        ends = np.cumsum(np.bincount(of_text[used], minlength=len(texts)))
        codes = np.insert(codes[used], ends, len(ids) - 1)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        size = sizes[codes]
        to = np.cumsum(size)
        # Tokens of a batch are fewer than 2**31, but for a single text of gigabytes.
        kind = np.int32 if to[-1] < 1 << 31 else np.int64
        place = np.repeat(((np.cumsum(sizes) - sizes)[codes] - (to - size)).astype(kind), size)
        place += np.arange(len(place), dtype=kind)
        data = np.frombuffer(b"".join(ids), self.dtype)[place]
        bounds = np.append(0, to[ends + np.arange(len(texts))]) * self.dtype.itemsize
        buffers = [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), buffers)

    def _merged(self, words: list[str]) -> tuple[list[str], list[bytes]]:
        """The same where some words have white space on both sides of their cut."""
        units, ids, at = [], [], 0
        while at < len(words):
            end = at + 1
            while end < len(words) and _joins(words[end]):
                end += 1
            units.append(" ".join(words[at:end]))
            if at and end == at + 1:
                ids.append(self._spaced(words[at]))
            else:
                ids.append(self.unit(" " * bool(at) + units[-1]))
            at = end
        return units, ids

    def decode(self, ids: np.ndarray) -> str:
        """As the library decodes, special tokens included."""
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder; its units outlive a task."""
    return Encoder(path)


def default_path() -> str:
    return public_tokenizers.path(VOCABULARY)


def width(path: str) -> str:
    """How the ids of a vocabulary are laid out in memory."""
    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"

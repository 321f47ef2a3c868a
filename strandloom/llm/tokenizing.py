"""Exact token ids of the public tokenizers, by faster routes where a text allows them.

A text of common characters takes the fast route (tiktoken's merge loop over the same
vocabulary); any other text, and one that holds a special token's string, goes to the
tokenizers library itself. Both give the library's ids.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Characters whose classes, case and normal forms all libraries agree on.
RARE = regex.compile("[^\t-\r\x20-\x7e\xa0-ɏ‐-‧€]")
_ASCII = bytes([*range(9, 14), *range(0x20, 0x7F)])


def rare(text: str) -> bool:
    """Whether a text has characters that only the tokenizers library is asked about."""
    rest = text.encode().translate(None, _ASCII)
    return bool(rest and RARE.search(rest.decode()))


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _library(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class ByteBPE:
    """Byte-level BPE whose text is all that its ids hold."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = _bytes_of_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in k): i for k, i in spec["model"]["vocab"].items() if k not in special}
        self.special = list(special)
        self.library = _library(path)
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (1 + max(*ranks.values(), *special.values()))
        for k, i in (ranks | {k.encode(): i for k, i in special.items()}).items():
            self.bytes[i] = k
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def has_special(self, text: str) -> bool:
        return any(x in text for x in self.special)

    def plain(self, text: str) -> bool:
        """Whether the fast route is open to a text."""
        return not (self.has_special(text) or rare(text))

    def encode(self, text: str) -> np.ndarray:
        if self.plain(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


class WordBPE:
    """Lower-casing BPE with word ends, where white space only separates words.

    Each distinct word is encoded once while it stays in a bounded store: no token spans white
    space. Missing words of a batch are encoded together. The end of a word is a newline byte
    for the merge loop, which no word holds.
    """

    BETWEEN = "\x02"

    def __init__(self, path: str, most: int = 500_000):
        spec = json.load(open(path, encoding="utf-8"))
        letters, vocab = _bytes_of_letters(), spec["model"]["vocab"]
        special = {t["content"] for t in spec["added_tokens"]}
        of = {bytes(letters[c] for c in k.removesuffix("</w>")) + b"\n" * k.endswith("</w>"): i for k, i in vocab.items() if k not in special}
        one = lambda k: len(k.removesuffix(b"\n") or k) == 1
        first = sorted(of, key=lambda k: (not one(k), one(k) and len(k) > 1, of[k]))
        self.ids = np.array([of[k] for k in first], "<u4")
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks={k: i for i, k in enumerate(first)}, special_tokens={})
        self.between = first.index(self.BETWEEN.encode() + b"\n")
        self.special = list(special)
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.library = _library(path)
        self.most, self.known, self.before = most, {}, {}

    def _learn(self, words: set[str]) -> None:
        fresh = []
        for w in words:
            if (ids := self.before.get(w)) is None:
                fresh.append(w)
            else:
                self.known[w] = ids
        if fresh:
            text = unicodedata.normalize("NFC", f" {self.BETWEEN} ".join(fresh)).lower()
            ranks = self.fast.encode_to_numpy("\n".join(self.pattern.findall(text)) + "\n")
            ends = [*np.flatnonzero(ranks == self.between).tolist(), len(ranks)]
            ids, at = self.ids[ranks].tobytes(), 0
            for w, end in zip(fresh, ends, strict=True):
                self.known[w] = ids[4 * at : 4 * end]
                at = end + 1

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [None if any(x in t for x in self.special) or rare(t) else t.split() for t in texts]
        if len(self.known) >= self.most:
            self.known, self.before = {}, self.known
        if missing := set().union(*(w for w in split if w)) - self.known.keys():
            self._learn(missing)
        get = self.known.__getitem__
        return [np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if w is None else b"".join(map(get, w)) for t, w in zip(texts, split, strict=True)]


@functools.cache
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


@functools.cache
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)

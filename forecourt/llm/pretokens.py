"""Byte-level BPE vocabularies: file reading, pre-tokens, words seen before.

Shared by the encoder and the token counter; their merge loops are their own.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

# Fixed value: the split pattern of this tokenizer family.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)
BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
CLEAN = re.compile(r"(?<=\S) (?=\S)")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file in the tokenizers library's JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path}: not a byte-level BPE vocabulary")
        if spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path}: prefix spaces and normalizers are not supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: special tokens that take neighbours are not supported")
        symbols, ids = byte_symbols(), spec["model"]["vocab"]
        self.bytes_of = {i: bytes(symbols[c] for c in s) for s, i in ids.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.byte_id = np.zeros(256, np.int32)
        for c, b in symbols.items():
            self.byte_id[b] = ids[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.size = max(self.bytes_of) + 1
        self.merged = np.array([ids[a + b] for a, b in merges], np.int32)
        self._hash(np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64))
        alternatives = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.special_split = regex.compile("(" + "|".join(alternatives) + ")") if alternatives else None
        self.split = regex.compile(SPLIT)

    def _hash(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, NONE, np.int32)
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = self.slots[at[left]] < 0
            claim = left[free]
            self.slots[at[claim]] = keys[claim]
            won = self.slots[at[left]] == keys[left]
            self.slot_rank[at[left[won]]] = left[won]
            left = left[~won]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids; NONE where no merge exists."""
        keys = left.astype(np.int64) * self.size + right
        at = self._place(keys)
        seen = self.slots[at]
        out = np.where(seen == keys, self.slot_rank[at], NONE)
        todo = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
            seen = self.slots[at[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.slot_rank[at[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Read once per worker."""
    return Vocabulary(path)


class Codes(dict):
    """Numbers chunks in the order they come; ``new`` holds those without a result yet.

    A chunk starts at a space between two visible characters, where a pre-token always
    starts, so its pre-tokens do not depend on its neighbours.  Its key is the string
    without that space; the first chunk of a text has no space and a tuple as key.
    """

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = code = len(self)
        self.new.append(key)
        return code

    def _keys(self, text: str) -> list:
        vocab = self.vocab
        if vocab.special_split is not None and any(s in text for s in vocab.special):
            parts = vocab.special_split.split(text)
            return [k for i, part in enumerate(parts)
                    for k in ([(part,)] if i % 2 else self._keys(part))]
        if not text:
            return []
        blanks = [" ", *(c for c in BLANKS if c in text)]
        if text[0] == " " or text[-1] == " " or any(
                f" {c}" in text or f"{c} " in text for c in blanks):
            keys: list = CLEAN.split(text)
        else:
            keys = text.split(" ")
        keys[0] = (keys[0],)
        return keys

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all chunks in a row, number of chunks of each text)."""
        keys = [self._keys(t) for t in texts]
        sizes = np.fromiter(map(len, keys), np.int64, len(keys))
        codes = map(self.__getitem__, chain.from_iterable(keys))
        return np.fromiter(codes, np.int64, int(sizes.sum())), sizes

    def take_new(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(different pre-tokens of the new chunks, their places in a row, places per chunk)."""
        keys, self.new = self.new, []
        split, special = self.vocab.split.findall, self.vocab.special
        words = [split(" " + k) if isinstance(k, str) else [k[0]] if k[0] in special
                 else split(k[0]) for k in keys]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        number: dict[str, int] = {}
        places = np.fromiter((number.setdefault(w, len(number)) for w in chain.from_iterable(words)),
                             np.int64, int(sizes.sum()))
        return list(number), places, sizes


def ragged(words: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(byte ids, lengths) of the words; a special token is a single id."""
    raw = [w.encode() for w in words]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    ids = vocab.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
    marks = [k for k, w in enumerate(words) if w in vocab.special]
    if marks:
        starts = np.concatenate(([0], lengths.cumsum()))
        keep = np.ones(len(ids), bool)
        for k in marks:
            ids[starts[k]] = vocab.special[words[k]]
            keep[starts[k] + 1:starts[k + 1]] = False
            lengths[k] = 1
        ids = ids[keep]
    return ids, lengths


def take_ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the runs [start, start + length), one run after the other."""
    ends = lengths.cumsum()
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)

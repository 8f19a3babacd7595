"""Token ids of whole texts, piece by piece.

Both supplied vocabularies split texts before anything else: before a run of white space, after a
line break that a word follows, and between an ASCII letter and ASCII punctuation, whatever else
stands around. So a text's ids are those of the pieces between such places, one after the other.
Pieces repeat, so each is encoded once and looked up afterwards, in a table of bounded size. A piece
that is one Latin word skips the library's normalizer and goes to its BPE model at once. Texts in
which a cut might not be harmless (other kinds of space, control signs, strings of special tokens)
are encoded whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from reviewlytics.llm.common import ranks

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces that one worker remembers; beyond, it starts anew.
REMEMBERED = 500_000
_ODD_TEXT = re.compile(
    rb"<\||[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
)
# Kinds of bytes: 1 blank, 2 other space, 3 ASCII letter, 4 ASCII punctuation, and a flag for the first bytes of what
# may make a cut harmful.
_FLAG = 8
_KIND = np.zeros(256, np.uint8)
_KIND[9:14], _KIND[32] = 2, 1
_KIND[65:91] = _KIND[97:123] = 3
_KIND[33:48] = _KIND[58:65] = _KIND[91:97] = _KIND[123:127] = 4
_KIND[[0x3C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] |= _FLAG
_KINDS = _KIND.tobytes()
# (kind << 3 | next kind): whether the text is cut before the next byte.
_CUT = np.zeros(256, np.uint8)
for _a in range(5):
    for _b in range(5):
        _CUT[_a << 3 | _b] = (_b in (1, 2) and _a not in (1, 2)) or (_a == 2 and _b not in (1, 2)) or (_a, _b) == (3, 4)
_CUTS = _CUT.tobytes()
_ENCODERS: dict[str, Encoder] = {}


def byte_letters() -> dict[int, str]:
    """The printable sign that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    """A tokenizer of the tokenizers library with a table of pieces that it has met."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.lower = self.tokenizer.normalizer is not None
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        found, others = [None] * len(pieces), []
        for k, x in enumerate(pieces):
            word = x[1:] if x[:1] == " " else x
            if word.isalpha() and (word.isascii() or max(word) < "\u0100"):
                word = word.lower() if self.lower else x
                if x[0] == " " or not x.isascii():
                    word = word.encode().decode("latin-1").translate(self.letters)
                found[k] = [t.id for t in self.model.tokenize(word)]
            else:
                others.append(k)
        more = self.tokenizer.encode_batch_fast([pieces[k] for k in others], add_special_tokens=False)
        for k, x in zip(others, more):
            found[k] = x.ids
        first = len(self.known)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total = int(sizes.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(found) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        self.size[first : first + len(found)] = sizes
        self.start[first : first + len(found)] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.known.update(zip(pieces, range(first, first + len(found))))

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        if len(self.known) > self.remembered:
            self._clear()
        known = self.known
        new = [x for x in pieces if x not in known]
        for begin in range(0, len(new), 20_000):
            self._learn(new[begin : begin + 20_000])
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and ids before each row (rows + 1)."""
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        kinds = np.frombuffer(data.tobytes().translate(_KINDS), np.uint8)
        odd = np.flatnonzero(kinds & _FLAG)
        kinds = kinds & (_FLAG - 1)
        cut = np.ones(len(data), bool)
        cut[1:] = np.frombuffer((kinds[:-1] << 3 | kinds[1:]).tobytes().translate(_CUTS), bool)
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        if len(odd):
            for r in np.unique(np.searchsorted(offsets, odd, side="right") - 1):
                if _ODD_TEXT.search(data[offsets[r] : offsets[r + 1]].tobytes()):
                    cut[offsets[r] + 1 : offsets[r + 1]] = False
        begins = np.flatnonzero(cut)
        cuts = np.append(begins, len(data)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pieces.dictionary_encode()
        numbers = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        sizes = self.size[numbers]
        ids = self.ids[np.repeat(self.start[numbers], sizes) + ranks(sizes)]
        before = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=before[1:])
        return ids, before[np.searchsorted(begins, offsets)]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; loaded once per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, before: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows with ``end_id`` after each."""
    rows = len(before) - 1
    out = np.full(len(ids) + rows, end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(rows), np.diff(before))] = ids
    return out, before + np.arange(rows + 1)

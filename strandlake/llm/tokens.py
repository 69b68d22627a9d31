"""Token ids of whole texts by the tokenizers library, with a cache of pieces.

A text is cut only where the byte-level pre-tokenizer is certain to cut too,
so that the ids of the pieces, end to end, are the ids of the text. Equal
pieces are encoded once a worker. Strings of special tokens in a text count as
ordinary text. A null text counts as an empty one.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

END_ID = 0
#: Pieces that a worker remembers; it forgets all of them beyond that.
CACHE_PIECES = 250_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# byte classes: other (non-ASCII), letter, digit, space, further white space, punctuation, apostrophe
_CLASS = np.zeros(256, np.uint8)
for _c in range(128):
    _CLASS[_c] = 1 if chr(_c).isalpha() else 2 if chr(_c).isdigit() else 3 if _c == 32 else 4 if 9 <= _c <= 13 else 6 if _c == 39 else 5
#: A cut between neighbours of these classes never splits a pre-token.
_CUT = np.zeros((8, 8), bool)
_CUT[np.ix_([0, 1, 2, 5, 6], [3, 4])] = True
_CUT[4, [0, 1, 2, 5, 6]] = True
_CUT[1, [2, 5, 6]] = _CUT[2, [1, 5, 6]] = True
_CUT[5, [1, 2]] = True
_CUT_AT = _CUT.reshape(-1)


def _wide_space(buf: np.ndarray, n: int) -> np.ndarray:
    """Positions of white space outside ASCII, found by its first bytes (a few others too)."""
    b = buf[: n + 2]
    one, two, three = b[:-2], b[1:-1], b[2:]
    high = np.flatnonzero((one == 0xC2) | ((one >= 0xE1) & (one <= 0xE3)))
    a, c, d = one[high], two[high], three[high]
    wide = ((a == 0xC2) & ((c == 0x85) | (c == 0xA0))) | ((a == 0xE1) & (c == 0x9A)) | ((a == 0xE2) & (((c == 0x80) & ((d <= 0x8A) | (d >= 0xA8))) | (c == 0x81))) | ((a == 0xE3) & (c == 0x80) & (d == 0x80))
    return high[wide]


class Encoder:
    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        known = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in known]
        self.letters = {b: chr(b) for b in known} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        tokenize, whole, letters, new, sizes = self.model.tokenize, self.whole.encode, self.letters, [], []
        for piece in pieces:
            text = piece.decode()
            if (text[1:] if text[0] == " " else text).isalpha():  # one pre-token: straight to the merges
                ids = [t.id for t in tokenize("\u0120" + text[1:] if text[0] == " " and text.isascii() else piece.decode("latin-1").translate(letters))]
            else:
                ids = whole(text, add_special_tokens=False).ids
            new += ids
            sizes.append(len(ids))
        self.index.update(zip(pieces, range(len(self.index), len(self.index) + len(pieces)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum([0, *sizes[:-1]])])
        self.size = np.concatenate([self.size, np.array(sizes, np.int64)])
        self.flat = np.concatenate([self.flat, np.array(new, np.int32)])

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with END_ID behind it; offsets by text)."""
        n, texts = int(off[-1]), len(off) - 1
        if len(self.index) > CACHE_PIECES:
            self.clear()
        k = _CLASS[buf[:n]]
        cut = np.zeros(n + 1, bool)
        if n:
            cut[1:n] = _CUT_AT[(k[:-1] << 3) | k[1:]]
            blank = (k == 3) | (k == 4)  # a run of white space stays with what follows
            cut[2:n] &= ~(blank[:-2] & blank[1:-1])
        wide = _wide_space(buf, n)
        for t in np.unique(np.searchsorted(off, wide, "right") - 1):  # such texts are encoded in one piece
            cut[off[t] : off[t + 1]] = False
        cut[off] = True
        at = np.flatnonzero(cut)
        if n == 0 or len(at) < 2:
            counts, codes = np.zeros(texts, np.int64), np.zeros(0, np.int64)
        else:
            pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))]).dictionary_encode()
            distinct = pieces.dictionary.to_pylist()
            if new := [p for p in distinct if p not in self.index]:
                self._learn(new)
            codes = np.array([self.index[p] for p in distinct], np.int64)[pieces.indices.to_numpy()]
            counts = np.diff(np.searchsorted(at[:-1], off))
        sizes = self.size[codes]
        before = np.concatenate([[0], np.cumsum(sizes)])
        by_piece = np.concatenate([[0], np.cumsum(counts)])
        ends = before[by_piece]
        out = np.empty(int(before[-1]) + texts, np.int32)
        doc_of = np.repeat(np.arange(texts), counts)
        place = np.arange(int(before[-1])) + np.repeat(doc_of, sizes)
        out[place] = self.flat[np.arange(int(before[-1])) + np.repeat(self.start[codes] - before[:-1], sizes)]
        ioff = ends + np.arange(texts + 1)
        out[ioff[1:] - 1] = END_ID
        return out, ioff


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """One a worker process and vocabulary."""
    return Encoder(vocabulary)


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())

"""Word shingles of texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .mph import mix

# A-Z as a-z, ASCII white space as blanks
_FOLD = bytes(32 if c in b" \t\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BYTE = np.random.default_rng(20).integers(0, 2**64, 256, np.uint64)
_Q = 0x9E3779B97F4A7C15
_Q_INVERSE = pow(_Q, -1, 2**64)
_K = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


#: Bytes of texts whose words are hashed together.
TOGETHER = 1 << 15


class Shingler:
    """Sets of `size`-word shingles; words part at ASCII white space, A-Z count as a-z.

    A word's hash is a polynomial of its bytes modulo 2**64, read off a running sum over the text, then mixed with its
    length; a shingle's mixes those of its words.
    """

    def __init__(self, size: int = 3):
        self.size = size
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.full(n, _Q, np.uint64))
            self.down = np.cumprod(np.full(n, _Q_INVERSE, np.uint64))

    def words(self, text: bytes) -> np.ndarray:
        return self._words(text)[0]

    def _words(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word and where it begins."""
        b = np.frombuffer(text.translate(_FOLD), np.uint8)
        if not len(b):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(b) > len(self.up):
            self._powers(2 * len(b))
        edge = np.diff(np.concatenate([[True], b == 32, [True]]).view(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        with np.errstate(over="ignore"):
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * self.up[: len(b)])])
            return mix((run[end] - run[start]) * self.down[start] if len(start) else np.zeros(0, np.uint64), 1) ^ (end - start).astype(np.uint64), start

    @staticmethod
    def _chained(w: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = mix(w[: len(w) - size + 1], size)
            for i in range(1, size):
                x = mix((x ^ (w[i : len(w) - size + 1 + i] * _K[0])) * _K[1], 0)
        return x

    def set_of(self, text: bytes) -> np.ndarray:
        """Sorted distinct shingles; of fewer words the whole sequence, of none nothing."""
        return self.sets_of([text])[0]

    def sets_of(self, texts: list[bytes]) -> list[np.ndarray]:
        """The set of each text. Words of short texts are hashed together, a blank between two texts."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            some, n = [texts[at]], len(texts[at])
            while at + len(some) < len(texts) and n + len(texts[at + len(some)]) < TOGETHER:
                some.append(texts[at + len(some)])
                n += len(some[-1]) + 1
            at += len(some)
            w, start = self._words(b" ".join(some))
            ends = np.cumsum([len(x) + 1 for x in some])
            cut = [0, *np.searchsorted(start, ends).tolist()]
            all_ = self._chained(w, self.size) if len(w) >= self.size else w[:0]
            for a, b in zip(cut, cut[1:]):
                if b - a < self.size:
                    x = self._chained(w[a:b], b - a) if b > a else w[:0]
                else:
                    x = np.sort(all_[a : b - self.size + 1])
                    new = np.empty(len(x), bool)
                    new[0] = True
                    np.not_equal(x[1:], x[:-1], out=new[1:])
                    x = x[new]
                out.append(x)
        return out

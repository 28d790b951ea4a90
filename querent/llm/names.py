"""64-bit names of substrings and words, computed for whole buffers at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.default_rng(2).integers(0, 1 << 64, 256, np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread what the low bits of a polynomial name say over all bits."""
    x = x ^ (x >> _U(29))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(29))


class Names:
    """Names of a buffer's substrings, from prefix sums of bytes' values times powers of an odd base."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(_POWERS[0]) < n:
            size = max(n, 1 << 17)
            for i, b in enumerate((_BASE, _INVERSE)):
                p = np.full(size, _U(b))
                p[0] = 1
                _POWERS[i] = np.multiply.accumulate(p)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_VALUE[data] * _POWERS[0][: n - 1], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Names of all substrings of one length."""
        d = self.sums[length:] - self.sums[:-length]
        d *= _POWERS[1][: len(d)]
        return mix(d)

    def at(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names of given substrings; the length counts."""
        return mix((self.sums[end] - self.sums[begin]) * _POWERS[1][begin] + (end - begin).astype(np.uint64))


#: ASCII characters other than letters and digits separate words.
_BLANK = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def words(texts: list[str | None], limit: int = 1 << 20):
    """Names of the lower-cased words of texts: for each group of texts of about ``limit`` bytes, the
    index of its first text, all names, and where each text's names begin (one more than texts).
    A word that a very long text holds across pieces of it is cut nowhere: texts stay whole."""
    held, size, first = [], 0, 0
    for i in range(len(texts) + 1):
        raw = (texts[i] or "").lower().encode("utf-8", "replace") if i < len(texts) else b""
        if held and (i == len(texts) or size + len(raw) > limit):
            data = np.frombuffer(b" ".join([*held, b""]).translate(_BLANK), np.uint8)
            edges = np.flatnonzero(np.diff(np.r_[False, data != 32, False].view(np.int8)))
            begin, end = edges[::2], edges[1::2]
            bounds = np.cumsum([0, *[len(h) + 1 for h in held]])
            yield first, Names(data).at(begin, end), np.searchsorted(begin, bounds)
            held, size, first = [], 0, i
        held.append(raw)
        size += len(raw)


class Lookup:
    """Index of names in a table of them; -1 for others."""

    def __init__(self, table: np.ndarray):
        self.order = np.argsort(table, kind="stable").astype(np.int32)
        self.sorted = table[self.order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.sorted >> _U(48)] = True

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices found, and their places among the names."""
        at = np.flatnonzero(self.maybe[names >> _U(48)])
        k = np.minimum(np.searchsorted(self.sorted, names[at]), max(len(self.sorted) - 1, 0))
        hit = self.sorted[k] == names[at] if len(self.sorted) else np.zeros(0, bool)
        return self.order[k[hit]], at[hit]

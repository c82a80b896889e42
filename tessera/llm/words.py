"""Words, hashes and windows of whole texts as numpy arrays, for use inside Spark tasks."""

from __future__ import annotations

import numpy as np

#: White space between words: space and the controls 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE2 = np.random.default_rng(20240608).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        row = np.full(max(n, 1 << 16), base, np.uint64)
        row[0] = 1
        _powers[name] = np.multiply.accumulate(row)
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """The words of several texts: byte positions, the text each belongs to, and 64-bit hashes."""

    def __init__(self, texts) -> None:
        parts = [(t if isinstance(t, str) else "").encode("utf-8", "surrogatepass") for t in texts]
        self.bytes = b"\n".join(parts) + b"\n"
        flat = np.frombuffer(self.bytes, np.uint8)
        space = np.concatenate(([True], _SPACE[flat]))
        edge = np.flatnonzero(space[1:] != space[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, np.int64)
        self.text = np.searchsorted(ends, self.start, "right")
        #: Words of text i are first[i] to first[i + 1].
        self.first = np.searchsorted(self.text, np.arange(len(parts) + 1))
        self._flat = flat

    def hashes(self, second: bool = False) -> np.ndarray:
        """A hash of each word; ``second`` takes other values for the bytes."""
        n = len(self._flat)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_BYTE2 if second else _BYTE)[self._flat] * _power("up", _BASE, n), out=total[1:])
        value = (total[self.end] - total[self.start]) * _power("down", _INVERSE, n + 1)[self.start]
        return mix(value + (self.end - self.start).astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.end[i]]


def steps(length: int) -> list[int]:
    """Window lengths 1, 2, 4, ... and at last ``length``, each at most twice the one before and
    rounded so that two windows of one length cover one of the next."""
    out = [length]
    while out[0] > 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


def double(value: np.ndarray, length: int, longer: int, salt: int = 0) -> np.ndarray:
    """Hashes of windows of ``longer`` words from those of ``length``, at most half as long."""
    shift = longer - length
    if len(value) <= shift:
        return np.zeros(0, np.uint64)
    return mix(value[: len(value) - shift] * _U(0xD6E8FEB86659FD93 + 2 * salt) + value[shift:] * _U(0xCA5A826395121157 + 4 * salt))


def sliding_argmin(value: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the position of its smallest (the first, if equal)."""
    n = len(value) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(len(value))
    have = 1
    while have < width:
        shift = min(have, width - have)
        left, right = best[:-shift], best[shift:]
        best = np.where(value[right] < value[left], right, left)
        have += shift
    return best[:n]

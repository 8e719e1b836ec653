"""Words of many texts at once, as numpy arrays: places, hashes, sliding minima."""

from __future__ import annotations

import numpy as np

from .common import BLANKS

_U = np.uint64
_RNG = np.random.default_rng(20240917)
#: A random 64-bit number per byte value, and odd powers by the byte's place in its word.
_BYTE = _RNG.integers(1, 1 << 64, 256, dtype=_U)
_POWER = np.multiply.accumulate(np.full(1 << 16, _RNG.integers(0, 1 << 63, dtype=_U) * _U(2) + _U(1)))
#: Odd multipliers of the words of a gram, by place, one row for each independent hash.
PLACE = _RNG.integers(0, 1 << 63, (2, 4096), dtype=_U) * _U(2) + _U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Words:
    """The words of ``texts``, in order, with the bytes of ``gaps`` between words.

    ``start``, ``end``: place in ``data``; ``text``: index of the text; ``hash``: 64 bits of the
    word's bytes; ``counts``: words per text. Texts are joined with a byte of ``gaps``, so no word
    spans two of them. ``None`` has no words.
    """

    def __init__(self, texts: list[bytes | None], gaps: bytes = BLANKS):
        joint = gaps[:1]
        self.data = joint.join(t or b"" for t in texts) + joint
        buf = np.frombuffer(self.data, np.uint8)
        is_gap = np.zeros(256, bool)
        is_gap[list(gaps)] = True
        gap = is_gap[buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.buf = buf
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        self.bounds = np.concatenate(([0], np.cumsum(sizes)))
        self.text = np.searchsorted(self.bounds, self.start, side="right") - 1
        self.counts = np.bincount(self.text, minlength=len(texts))
        self._is_gap = is_gap
        self.hash = self._hashes() if len(self.start) else np.zeros(0, _U)

    def _hashes(self) -> np.ndarray:
        weight = np.where(self._is_gap, _U(0), _BYTE)[self.buf]
        runs = np.diff(np.append(self.start, len(self.buf)))
        place = np.arange(len(self.buf) - self.start[0], dtype=np.int64) - np.repeat(self.start - self.start[0], runs)
        weight = weight[self.start[0]:] * _POWER[place & (len(_POWER) - 1)]
        total = np.add.reduceat(weight, self.start - self.start[0])
        return mix(total + (self.end - self.start).astype(_U))

    def __len__(self):
        return len(self.start)


def gram_hashes(words: np.ndarray, n: int, row: int = 0) -> np.ndarray:
    """64-bit hash of every run of ``n`` consecutive values."""
    size = max(len(words) - n + 1, 0)
    total = np.zeros(size, _U)
    for k in range(n):
        total += words[k:k + size] * PLACE[row, k % PLACE.shape[1]]
    return mix(total)


def sliding(a: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """``best`` of every ``width`` consecutive values, by doubling."""
    size = 1
    while 2 * size <= width and len(a) > size:
        a = best(a[:-size], a[size:])
        size *= 2
    rest = width - size
    return (best(a[:-rest], a[rest:]) if rest and len(a) > rest else a[:0] if rest else a)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``start[0], start[0] + 1, …`` (``count[0]`` values), then those of ``start[1]``, and so on."""
    total = int(count.sum())
    first = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) - np.repeat(first - start, count)

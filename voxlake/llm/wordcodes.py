"""Words of a text as numbers, without a Python object for each of them."""

from __future__ import annotations

import numpy as np

_random = np.random.default_rng(20)
CODES = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
STEP = np.uint64(int(_random.integers(1, 1 << 62)) * 2 + 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of STEP, from 1 on, and of its inverse, from 0 on."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, STEP)), np.cumprod(np.append(np.uint64(1), np.full(n - 1, INVERSE)))


INVERSE = np.uint64(pow(int(STEP), -1, 1 << 64))
POWERS, INVERSES = _powers(1 << 14)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that scatters 64-bit numbers."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_codes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words (runs of bytes other than \\x20 and \\x09-\\x0D): differences of one running sum."""
    raw = np.frombuffer(data, np.uint8)
    word = np.zeros(len(raw) + 2, bool)
    word[1:-1] = (raw != 0x20) & (raw - np.uint8(9) > 4)
    edge = np.flatnonzero(word[1:] != word[:-1])
    if not len(edge):
        return np.zeros(0, np.uint64)
    first, end = edge[::2], edge[1::2]
    powers, inverses = (POWERS, INVERSES) if len(raw) <= len(POWERS) else _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(CODES[raw] * powers[: len(raw)], out=sums[1:])
        return mixed((sums[end] - sums[first]) * inverses[first] + (end - first).astype(np.uint64) * STEP)

"""Words of many texts at once: places and 64-bit hashes, from arrays of bytes."""

from __future__ import annotations

import numpy as np

#: ``[\x20\x09-\x0D]`` by byte.
WHITE = np.zeros(256, dtype=bool)
WHITE[[32, *range(9, 14)]] = True

_SEED = np.random.Generator(np.random.PCG64(20_240_611))
#: A random value per byte, a random odd base and its inverse: a word's hash is a polynomial in the base.
_VALUES = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_SEED.integers(1, 1 << 62)) * 2 + 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(inverse: int, n: int) -> np.ndarray:
    if len(_powers[inverse]) < n:
        base = np.uint64(pow(_BASE, -1, 1 << 64) if inverse else _BASE)
        steps = np.full(2 * n, base, np.uint64)
        steps[0] = 1
        _powers[inverse] = np.multiply.accumulate(steps)
    return _powers[inverse][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with a line end behind each, as bytes, and where each starts (one more than there are texts)."""
    buffer = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    return buffer, np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)]


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of True."""
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.r_[0, edges]
    if len(inside) and inside[-1]:
        edges = np.r_[edges, len(inside)]
    return edges[::2], edges[1::2]


def hashes(buffer: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each byte range, the same for equal contents wherever they stand."""
    sums = np.r_[np.uint64(0), np.cumsum(_VALUES[buffer] * _power(0, len(buffer)), dtype=np.uint64)]
    return mixed((sums[stops] - sums[starts]) * _power(1, len(buffer) + 1)[starts])

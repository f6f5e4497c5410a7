"""Hashes of all words of a text at once, with numpy."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word; a polynomial hash from prefix sums modulo 2**64, mixed with the length."""
    b = np.frombuffer(text, dtype=np.uint8)
    inside = np.concatenate([[False], ~((b == 32) | ((b >= 9) & (b <= 13))), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, start.astype(np.uint64)
    with np.errstate(over="ignore"):
        power = np.full(len(b), _ODD, dtype=np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        back = np.full(len(b), np.uint64(pow(int(_ODD), -1, 1 << 64)), dtype=np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
        h = (total[end] - total[start]) * back[start]
        return start, end, mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

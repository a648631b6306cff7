"""The binary Golay code of length 23, backwards: nearby 23-bit words get a codeword index in common."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code; a word's remainder by it is its syndrome.
GENERATOR = 0b101011100011
N, CHECKS = 23, 11


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits; for each syndrome 6 error patterns, of which 1 or all count.

    The code is perfect: each of the 2048 syndromes has one pattern of weight 3 or less. A syndrome with a pattern of weight 3
    has five more of weight 4, so a word lies within distance 4 of one codeword or of six.
    """
    powers = []
    for i in range(N):
        x = 1 << i
        for b in range(N - 1, CHECKS - 1, -1):
            if x >> b & 1:
                x ^= GENERATOR << (b - CHECKS)
        powers.append(x)
    low, high = (np.zeros(1 << k, np.int64) for k in (12, 11))
    for i in range(12):
        low[1 << i : 2 << i] = low[: 1 << i] ^ powers[i]
    for i in range(11):
        high[1 << i : 2 << i] = high[: 1 << i] ^ powers[12 + i]
    near: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(N), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= powers[b]
            if weight < 4 or near[syndrome][0].bit_count() == 3:
                near[syndrome].append(sum(1 << b for b in bits))
    patterns = np.array([x + x[:1] * (6 - len(x)) for x in near], np.int64)
    return low, high, patterns


def near_indices(words: np.ndarray) -> np.ndarray:
    """For 23-bit words the 12-bit indices of the codewords within distance 4, six a word; the first is what it decodes to, and stands again where there is only one.

    Words at distance 1: what either decodes to is among the other's six. Words at distance 2: they have one in common.
    """
    low, high, patterns = _tables()
    words = words.astype(np.int64)
    syndrome = low[words & 0xFFF] ^ high[words >> 12]
    return (words[:, None] ^ patterns[syndrome]) >> CHECKS

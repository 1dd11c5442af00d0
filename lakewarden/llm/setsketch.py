"""SetSketch registers (Ertl, "SetSketch: filling the gap between MinHash and HyperLogLog", 2021).

Register i holds ``floor(1 - log_b(x))`` of the least value x that a hash of the elements takes, truncated to
16 bits: exponentially spaced minima. Two sketches merge by the register-wise maximum, and for a base near 1
two registers agree with the probability of the sets' Jaccard similarity, which makes bands of registers
locality-sensitive. With the sizes known, the numbers of larger, smaller and equal registers give the
maximum-likelihood estimate of the similarity.
"""

from __future__ import annotations

import numpy as np

from lakewarden.llm.textkernels import mix

BASE = 1.001
LARGEST = (1 << 16) - 1


def multipliers(registers: int) -> np.ndarray:
    return mix(np.arange(1, registers + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sketch(hashes: np.ndarray, begin: np.ndarray, registers: int) -> np.ndarray:
    """Registers of many sets, a row each; set k has ``hashes[begin[k]:begin[k+1]]`` (repeats don't matter)."""
    out = np.zeros((len(begin) - 1, registers), dtype=np.uint16)
    filled = np.flatnonzero(np.diff(begin))
    if not len(filled):
        return out
    least = np.empty((registers, len(filled)), dtype=np.uint64)
    scratch = np.empty_like(hashes)
    for i, factor in enumerate(multipliers(registers)):
        np.multiply(hashes, factor, out=scratch)
        least[i] = np.minimum.reduceat(scratch, begin[filled])
    value = (least.astype(np.float64) + 1) / 2.0**64
    out[filled] = np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, LARGEST).astype(np.uint16).T
    return out


def merge(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.maximum(one, other)


def similarity(one: np.ndarray, other: np.ndarray, n_one: np.ndarray, n_other: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches (rows) of sets with these sizes."""
    larger, smaller = (one > other).sum(axis=1), (one < other).sum(axis=1)
    equal = one.shape[1] - larger - smaller
    u = n_one / np.maximum(n_one + n_other, 1)
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-300
        return larger * np.log(np.maximum(up, tiny)) + smaller * np.log(np.maximum(down, tiny)) + equal * np.log(np.maximum(1 - up - down, tiny))

    low, high = np.zeros(len(u)), np.minimum(u, v) / np.maximum(np.maximum(u, v), 1e-12)
    for _ in range(40):  # the likelihood is concave
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(a) < likelihood(b)
        low, high = np.where(left, a, low), np.where(left, high, b)
    return (low + high) / 2

"""Random numbers that depend on keys alone, never on partitions."""

from __future__ import annotations

import numpy as np

M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def pcg_hash(x: np.ndarray) -> np.ndarray:
    """The 32-bit pcg output function of an LCG step."""
    x = np.asarray(x, np.uint32)
    with np.errstate(over="ignore"):
        s = x * np.uint32(747796405) + np.uint32(2891336453)
        w = ((s >> ((s >> np.uint32(28)) + np.uint32(4))) ^ s) * np.uint32(277803737)
        return (w >> np.uint32(22)) ^ w


def splitmix64(seed: int, index: np.ndarray) -> np.ndarray:
    """The index-th output (from 0) of SplitMix64 from ``seed``; its state moves by
    a constant, so any output is found without those before it."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed & 0xFFFFFFFFFFFFFFFF) + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(index, np.uint64) + np.uint64(1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def uniform(seed: int, index: np.ndarray) -> np.ndarray:
    """Doubles in [0, 1) from the top 53 bits."""
    return (splitmix64(seed, index) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def normal(seed: int, index: np.ndarray) -> np.ndarray:
    """Standard normals by Box-Muller from outputs 2 i and 2 i + 1."""
    i = np.asarray(index, np.uint64) * np.uint64(2)
    u, v = 1 - uniform(seed, i), uniform(seed, i + np.uint64(1))
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)


def poisson(lam: np.ndarray, seed: int, index: np.ndarray, cap: int = 256) -> np.ndarray:
    """Poisson counts: products of uniforms below a mean of 30, a rounded normal above."""
    lam, index = np.asarray(lam, float), np.asarray(index, np.uint64)
    out = np.maximum(0, np.floor(lam + np.sqrt(np.maximum(lam, 0)) * normal(seed ^ 0x5BF03635, index) + 0.5)).astype(np.int64)
    small = np.flatnonzero(lam < 30)
    stop, p, k = np.exp(-np.maximum(lam[small], 0)), np.ones(len(small)), np.zeros(len(small), np.int64)
    live = np.arange(len(small))
    for draw in range(cap):
        p[live] *= uniform(seed, index[small][live] * np.uint64(cap) + np.uint64(draw))
        live = live[p[live] > stop[live]]
        if not len(live):
            break
        k[live] += 1
    out[small] = k
    return out

"""Random draws that a key and a seed fix, and that SQL can repeat.

A key (a pattern of rows, an item, a label) is a number h below the prime 2^31 - 1, from md5 of its text. Replicate r of a
seed has two such numbers a and b, from md5 of 'seed:r'. The draw is ((a h + b) mod prime)^5 mod prime, as a share of the
prime: any two keys are independent over the replicates, the fifth power is a permutation, and all products fit 64 bits.
Weights are quantiles of tables of the distribution, so a uniform gives the same weight in any engine. Draws depend on no
partition and no order. Keys of equal text share their draws; a share is told to 5e-10."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2**31 - 1

_lgamma = np.vectorize(math.lgamma, otypes=["float64"])


def key_number(text: Column) -> Column:
    """h of a key's text; null as empty."""
    return (F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long") % PRIME).alias("h")


def seeds(seed: object, reps: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of each replicate."""
    hexes = [hashlib.md5(f"{seed}:{r}".encode()).hexdigest() for r in range(reps)]
    return tuple(np.array([int(x[at : at + 15], 16) % PRIME for x in hexes], dtype="int64") for at in (0, 15))


def uniforms(h: np.ndarray, ab: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A row a key, a column a replicate: shares from 0 to below 1."""
    x = (h.astype("int64")[:, None] * ab[0] + ab[1]) % PRIME
    y = x * x % PRIME
    return y * y % PRIME * x % PRIME / PRIME


def _table(lo: int, logs: np.ndarray) -> tuple[int, np.ndarray]:
    cdf = np.cumsum(np.exp(logs))
    return lo, cdf / cdf[-1]


def _reach(mean: float, var: float) -> tuple[int, int]:
    """Places of a table: ten deviations and ten to each side, beyond which no share lies."""
    far = 10 * math.sqrt(var) + 10
    return max(0, math.floor(mean - far)), math.ceil(mean + far)


def poisson_table(mean: float) -> tuple[int, np.ndarray]:
    lo, hi = _reach(mean, mean)
    k = np.arange(lo, hi + 1, dtype="float64")
    return _table(lo, k * math.log(mean) - mean - _lgamma(k + 1))


def binomial_table(n: int, p: float) -> tuple[int, np.ndarray]:
    if n == 0 or p <= 0 or p >= 1:
        return (n if p >= 1 else 0), np.ones(1)
    lo, hi = _reach(n * p, n * p * (1 - p))
    k = np.arange(lo, min(hi, n) + 1, dtype="float64")
    return _table(lo, math.lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p))


def quantiles(u: np.ndarray, table: tuple[int, np.ndarray]) -> np.ndarray:
    return table[0] + np.searchsorted(table[1], u, side="right")

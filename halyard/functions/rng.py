"""The deterministic generators that levels, training and datasets depend on, on 32-bit integers.

Constants below are fixed values of the published generators (a mulberry32 uniform generator, an xmur3-style
string hash); results must equal theirs.
"""

from __future__ import annotations

import math

import numpy as np

_U32 = 0xFFFFFFFF
# fixed values: string hash start and multiplier, uniform increment, sequence salt
HASH_START, HASH_MULTIPLIER, UNIFORM_STEP, SEQUENCE_SALT = 1779033703, 3432918353, 0x6D2B79F5, 0x9E3779B1
MAX_LEVEL, DEFAULT_SEED = 32, 0x5356


def hash_seed(text: str, salt: int = 0) -> int:
    """32-bit seed from the UTF-16 code units of ``text``."""
    h = (HASH_START ^ salt) & _U32
    for unit in np.frombuffer(text.encode("utf-16-le"), "<u2").tolist():
        h = ((h ^ unit) * HASH_MULTIPLIER) & _U32
        h = (h << 13 | h >> 19) & _U32
    return h ^ h >> 16


def uniforms(seed: int, n: int) -> np.ndarray:
    """The first ``n`` uniform numbers of a seed; the state only counts, so all come at once."""
    a = (np.uint64(seed & _U32) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(UNIFORM_STEP)) & np.uint64(_U32)
    with np.errstate(over="ignore"):
        mask = np.uint64(_U32)
        t = ((a ^ a >> np.uint64(15)) * (a | np.uint64(1))) & mask
        t = (t + ((t ^ t >> np.uint64(7)) * (t | np.uint64(61)) & mask) & mask) ^ t
        return ((t ^ t >> np.uint64(14)) & mask) / 4294967296.0


class Uniform:
    """A stream of uniform numbers, drawn in blocks."""

    def __init__(self, seed: int, block: int = 4096):
        self.seed, self.block, self.drawn, self.held = seed & _U32, block, 0, []

    def __call__(self) -> float:
        if not self.held:
            self.held = uniforms(self.seed + self.drawn * UNIFORM_STEP, self.block)[::-1].tolist()
            self.drawn += self.block
        return self.held.pop()


class Gaussian:
    """Standard normal numbers by the polar method; the second of each pair is kept for the next call."""

    def __init__(self, uniform: Uniform):
        self.uniform, self.spare = uniform, None

    def __call__(self) -> float:
        if self.spare is not None:
            out, self.spare = self.spare, None
            return out
        while True:
            u, v = self.uniform() * 2 - 1, self.uniform() * 2 - 1
            s = u * u + v * v
            if 0 < s < 1:
                break
        f = math.sqrt(-2 * math.log(s) / s)
        self.spare = v * f
        return u * f


def level(node_id: str, sequence: int, m: int = 16, seed: int = DEFAULT_SEED) -> int:
    """Top level of the ``sequence``-th insert: geometric, with ratio 1 / m."""
    u = float(uniforms(hash_seed(node_id, (seed ^ sequence * SEQUENCE_SALT) & _U32), 1)[0])
    return min(int(-math.log(1 - u) / math.log(m)), MAX_LEVEL)

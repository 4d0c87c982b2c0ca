"""Sampling: the linear congruential generator and its closed form as a Column, bagging masks, folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.objectives import percentile

#: Fixed values of the generator.
A, C, M = 214013, 2531011, 1 << 32
#: Rows that share a generator when bagging.
BLOCK = 1024


class Lcg:
    def __init__(self, seed: int = 123456789):
        self.x = seed % M

    def _next(self) -> int:
        self.x = (self.x * A + C) % M
        return self.x

    def next_short(self, lower: int, upper: int) -> int:
        return (self._next() >> 16 & 0x7FFF) % (upper - lower) + lower

    def next_int(self, lower: int, upper: int) -> int:
        return (self._next() & 0x7FFFFFFF) % (upper - lower) + lower

    def next_float(self) -> float:
        return (self._next() >> 16 & 0x7FFF) / 32768.0

    def sample(self, n: int, k: int) -> list[int]:
        """k of range(n), ascending: by acceptance with the right odds if k is large, by redraws on collision if it is small."""
        import math

        if k > n or k <= 0:
            return []
        if k == n:
            return list(range(n))
        if k > 1 and k > n / math.log2(k):
            out: list[int] = []
            for i in range(n):
                if self.next_float() < (k - len(out)) / (n - i):
                    out.append(i)
            return out
        chosen: set[int] = set()
        for r in range(n - k, n):
            v = self.next_int(0, r)
            chosen.add(r if v in chosen else v)
        return sorted(chosen)


class Mersenne:
    """The 32-bit Mersenne Twister, seeded with one number, and its uniform doubles of 64 random bits (low word first)."""

    def __init__(self, seed: int):
        self.bits = np.random.MT19937()
        self.bits._legacy_seeding(seed % M)

    def words(self, n: int) -> np.ndarray:
        return self.bits.random_raw(n)

    def uniform(self, n: int) -> np.ndarray:
        """n doubles in [0, 1)."""
        low, high = self.words(2 * n).astype(np.float64).reshape(n, 2).T
        return np.minimum((low + high * M) / float(M) ** 2, np.nextafter(1.0, 0.0))


def jump(k: int) -> tuple[int, int]:
    """(a, c) with x_k = (a * x_0 + c) mod 2^32 for the state after k steps."""
    a, c = 1, 0
    base_a, base_c = A, C
    while k:
        if k & 1:
            a, c = a * base_a % M, (c * base_a + base_c) % M
        base_a, base_c = base_a * base_a % M, (base_c * base_a + base_c) % M
        k >>= 1
    return a, c


def bagging_float(row_id: Column, seed: int, rows: int, bag: int = 0) -> Column:
    """The generator's float for a row in the given bag (0: the first): each block of 1024 rows has a generator of its own,
    seeded seed + block, that goes on from bag to bag. No state is kept: the k-th state is a linear function of the seed."""
    inside = F.pmod(row_id, F.lit(BLOCK)).cast("int")
    block = F.floor(row_id / BLOCK).cast("long")
    full = [jump(bag * BLOCK + i + 1) for i in range(BLOCK)]
    tail = rows % BLOCK
    last = rows // BLOCK
    short = [jump(bag * tail + i + 1) for i in range(tail)]

    def state(table):
        a, c = (F.element_at(F.expr(f"array({', '.join(f'{x[i]}L' for x in table)})"), inside + 1) for i in (0, 1))
        return F.pmod(F.pmod(a * (block + seed), F.lit(M)) + c, F.lit(M))

    x = F.when(block < last, state(full)).otherwise(state(short)) if short else state(full)
    return F.shiftright(x, 16).bitwiseAND(32767) / 32768.0


def bagging_mask(row_id: Column, seed: int, rows: int, fraction: float, bag: int = 0, label: Column | None = None, positive: float | None = None, negative: float | None = None) -> Column:
    x = bagging_float(row_id, seed, rows, bag)
    if label is not None:
        return x < F.when(label > 0, positive).otherwise(negative)
    return x < fraction


def goss(df: DataFrame, size: Column, order: str, top_rate: float, other_rate: float, seed: int) -> DataFrame:
    """df with (sampled, factor): the rows of the top_rate largest sizes with factor 1; of the others a hash sample, scaled up."""
    t = percentile(df.select(size.cast("double").alias("size")), "size", 1.0 - top_rate).first()
    t = t.result if t is not None else 0.0
    top = size >= F.lit(t)
    rate = other_rate / (1.0 - top_rate) if top_rate < 1 else 0.0
    u = F.shiftrightunsigned(F.xxhash64(order, F.lit(seed)), 11) / F.lit(float(2**53))
    return df.withColumn("sampled", top | (u < rate)).withColumn("factor", F.when(top, 1.0).otherwise((1.0 - top_rate) / other_rate if other_rate else 0.0))


def folds(df: DataFrame, n: int, order: Column, seed: int = 0, by: str | None = None) -> DataFrame:
    """df with a fold 0..n-1, by a hash of `by` (rows of one value stay together) or of the order column."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(by) if by else order, F.lit(seed)), F.lit(n)).cast("int"))

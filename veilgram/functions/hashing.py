"""Hash families: the bit positions of a q-gram. Families are applied to distinct q-grams, never to each record."""

from __future__ import annotations

import hashlib
import random
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class HashFamily(Protocol):
    def positions(self, gram: Column, bf_len: int, k: int) -> Column:
        """array<int>, sorted and distinct."""


def _check(bf_len: int, k: int) -> None:
    if bf_len <= 1 or k < 1:
        raise ValueError("bf_len must be over 1 and k over 0")


def unit(key: Column) -> Column:
    """First 8 hex digits of md5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


class IndexedDigest:
    """Position i is the head of md5(gram|i) modulo the length: JVM code only, and expressible in SQL."""

    def __init__(self, salt: str = ""):
        self.salt = salt

    def positions(self, gram: Column, bf_len: int, k: int) -> Column:
        _check(bf_len, k)
        gram = F.concat(gram, F.lit(self.salt))
        one = lambda i: (F.conv(F.substring(F.md5(F.concat_ws("|", gram, i.cast("string"))), 1, 8), 16, 10).cast("bigint") % bf_len).cast("int")
        return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), one)))


#: Fixed values of the Mersenne Twister (32 bits): state size, middle word, matrix, seeding and tempering constants.
STATE, MIDDLE, MATRIX = 624, 397, 0x9908B0DF
FIRST_SEED, SEED_FACTOR, MIX_FACTORS = 19650218, 1812433253, (1664525, 1566083941)
TEMPER_B, TEMPER_C = 0x9D2C5680, 0xEFC60000
U32 = np.uint32


def twister_states(seeds: np.ndarray) -> np.ndarray:
    """(STATE, n) words of n generators, each seeded by a column of seeds (32-bit words, the least first)."""
    size, n = seeds.shape
    base = [FIRST_SEED]
    for i in range(1, STATE):
        base.append((SEED_FACTOR * (base[-1] ^ base[-1] >> 30) + i) & 0xFFFFFFFF)
    state = np.repeat(np.array(base, U32)[:, None], n, axis=1)
    i, at = 1, 0

    def scrambled(factor: int) -> np.ndarray:
        last = state[i - 1]
        return state[i] ^ ((last ^ (last >> U32(30))) * U32(factor))

    for step in range(max(STATE, size) + STATE - 1):
        if step < max(STATE, size):
            state[i] = scrambled(MIX_FACTORS[0]) + seeds[at] + U32(at)
            at = (at + 1) % size
        else:
            state[i] = scrambled(MIX_FACTORS[1]) - U32(i)
        i += 1
        if i == STATE:
            state[0] = state[-1]
            i = 1
    state[0] = 0x80000000
    return state


def twisted(state: np.ndarray) -> np.ndarray:
    """The next STATE outputs of each generator; state goes on."""
    for k in range(STATE):
        joined = (state[k] & U32(0x80000000)) | (state[(k + 1) % STATE] & U32(0x7FFFFFFF))
        state[k] = state[(k + MIDDLE) % STATE] ^ (joined >> U32(1)) ^ (joined & U32(1)) * U32(MATRIX)
    y = state.copy()
    y ^= y >> U32(11)
    y ^= (y << U32(7)) & U32(TEMPER_B)
    y ^= (y << U32(15)) & U32(TEMPER_C)
    return y ^ (y >> U32(18))


def twister_draws(seeds: np.ndarray, below: int, k: int) -> np.ndarray:
    """(n, k): the first k whole numbers under `below` of each generator. An output's leading bits are a number; those too large are left out."""
    state, parts, enough = twister_states(seeds), [], 0
    while enough < k:
        parts.append((twisted(state) >> U32(32 - below.bit_length())).T)
        drawn = np.concatenate(parts, axis=1)
        fits = drawn < below
        enough = fits.sum(1).min() if len(fits) else k
    order = np.argsort(~fits, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(drawn, order, axis=1).astype(np.int64)


class SeededTwister:
    """k draws, with replacement, of a Mersenne Twister seeded by the gram's digest."""

    def __init__(self, digest: str = "md5", salt: str = ""):
        hashlib.new(digest)
        self.digest, self.salt = digest, salt

    def draws(self, gram: str, bf_len: int, k: int) -> list[int]:
        """One gram's, by the standard library: what all_draws() has to equal."""
        rng = random.Random(int(hashlib.new(self.digest, (gram + self.salt).encode()).hexdigest(), 16))
        return [rng.randint(0, bf_len - 1) for _ in range(k)]

    def all_draws(self, grams: list[str], bf_len: int, k: int) -> np.ndarray:
        """(grams, k), over arrays. A digest is a seed of as many words as it has but for leading zero words."""
        raw = [hashlib.new(self.digest, (g + self.salt).encode()).digest().lstrip(b"\0") or b"\0" for g in grams]
        out = np.zeros((len(grams), k), np.int64)
        size = np.array([-(-len(r) // 4) for r in raw])
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            words = np.frombuffer(b"".join(raw[i].rjust(4 * n, b"\0") for i in at), ">u4").reshape(-1, n)[:, ::-1].T.astype(U32)
            out[at] = twister_draws(words, bf_len, k)
        return out

    def positions(self, gram: Column, bf_len: int, k: int) -> Column:
        _check(bf_len, k)
        draws = self.all_draws

        @F.pandas_udf("array<int>")
        def drawn(grams: pd.Series) -> pd.Series:
            return pd.Series([np.unique(x) for x in draws(grams.to_list(), bf_len, k)], dtype=object)

        return drawn(gram)

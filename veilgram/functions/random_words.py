"""Random 64-bit words by counter, over whole arrays, and words of independent biased bits made from them.

A biased bit is 1 if a uniform number is below the probability p, compared digit by digit from the first: a random word
settles half of the bits that are still open, so a word of 64 draws takes about eight random words, and one where p is 1/2."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
#: Fixed values of the Philox 4x64 generator: multipliers and key steps.
MULTIPLIERS = (0xD2E7470EE14C6C93, 0xCA5A826395121157)
STEPS = (0x9E3779B97F4A7C15, 0xBB67AE8584CAA73B)
ROUNDS = 10
#: Binary digits of p that count, and groups of four words that are drawn at a time (in cache).
DIGITS, CHUNK = 32, 1 << 12
LOW = U(0xFFFFFFFF)


def product(factor: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower halves of 128-bit products."""
    low, high = U(factor & 0xFFFFFFFF), U(factor >> 32)
    xl, xh = x & LOW, x >> U(32)
    cross = low * xh
    middle = ((low * xl) >> U(32)) + (cross & LOW) + high * xl  # below 2 ** 64
    return high * xh + (cross >> U(32)) + (middle >> U(32)), U(factor) * x


def philox(counter: list[np.ndarray], key: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Four words for each counter of four words and key of two."""
    a, b, c, d = counter
    k0, k1 = key
    for r in range(ROUNDS):
        if r:
            k0, k1 = k0 + U(STEPS[0]), k1 + U(STEPS[1])
        (h0, l0), (h1, l1) = product(MULTIPLIERS[0], a), product(MULTIPLIERS[1], c)
        a, b, c, d = h1 ^ b ^ k0, l1, h0 ^ d ^ k1, l0
    return [a, b, c, d]


def keys_of(names: list[str]) -> np.ndarray:
    """Two words of key for each name: the halves of its digest."""
    raw = b"".join([hashlib.md5(x.encode(), usedforsecurity=False).digest() for x in names])
    return np.frombuffer(raw, ">u8").reshape(-1, 2).astype(U)


def digits(prob: float) -> list[int]:
    """Binary digits of a probability below 1, the last of them 1."""
    n = int(prob * (1 << DIGITS))
    return [int(x) for x in f"{n:0{DIGITS}b}".rstrip("0")]


def biased(keys: np.ndarray, n_words: int, prob: float, lane: int = 0) -> np.ndarray:
    """(keys, n_words) words whose bits are 1 with probability prob. The words of one key are drawn by fours: word w takes
    output w % 4 of counters (digit, w // 4, lane, 0)."""
    n = len(keys)
    if prob >= 1:
        return np.full((n, n_words), ~U(0))
    fours, bits = -(-n_words // 4), digits(prob)
    out = np.zeros((n * fours, 4), U)
    for a in range(0, n * fours, CHUNK):
        at = np.arange(a, min(a + CHUNK, n * fours))
        key, group = keys[at // fours], (at % fours).astype(U)
        open_ = np.full((len(at), 4), ~U(0))
        for digit, is_one in enumerate(bits):
            zero = np.zeros(len(at), U)
            drawn = np.stack(philox([zero + U(digit), group, zero + U(lane), zero], (key[:, 0], key[:, 1])), axis=1)
            if is_one:
                out[at] |= open_ & drawn
                open_ &= ~drawn
            else:
                open_ &= drawn
            left = open_.any(axis=1)
            if not left.all():
                at, key, group, open_ = at[left], key[left], group[left], open_[left]
            if not len(at):
                break
    return out.reshape(n, fours * 4)[:, :n_words]

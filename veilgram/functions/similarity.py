"""Similarities of q-gram sets and of packed bit arrays, as columns. Formulas keep their floating-point shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def qgram_dice(a: Column, b: Column) -> Column:
    return F.lit(2.0) * common(a, b) / (F.size(a) + F.size(b))


def qgram_jaccard(a: Column, b: Column) -> Column:
    return common(a, b) / F.size(F.array_union(a, b))


def qgram_hamming(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.lit(1.0) - (union - common(a, b)) / union


def _count(words: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(w) for w in words])


def popcount(bf: Column, n_words: int) -> Column:
    return _count([bf[i] for i in range(n_words)])


def bits_and(a: Column | list[Column], b: Column | list[Column], n_words: int) -> Column:
    """Set bits in common; the words are unrolled so that the sum stays in generated code."""
    return _count([a[i].bitwiseAND(b[i]) for i in range(n_words)])


def bits_xor(a: Column | list[Column], b: Column | list[Column], n_words: int) -> Column:
    return _count([a[i].bitwiseXOR(b[i]) for i in range(n_words)])


def dice(c: Column, n1: Column, n2: Column) -> Column:
    return F.lit(2.0) * c / (n1 + n2)


def hamming(d: Column, bf_len: int) -> Column:
    return F.lit(1.0) - d / F.lit(bf_len)


def clamped_jaccard(d: Column, bf_len: int) -> Column:
    """Not intersection over union: one less twice the share of differing bits, 0 at least."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(2.0) * d / F.lit(bf_len))


def set_jaccard(c: Column, n1: Column, n2: Column) -> Column:
    """Of sets of n1 and n2 members, c in common; so set_hamming()."""
    return c / (n1 + n2 - c)


def set_hamming(c: Column, n1: Column, n2: Column) -> Column:
    union = n1 + n2 - c
    return F.lit(1.0) - (union - c) / union

"""Bloom-filter encoding: each distinct q-gram's filter once, then OR-ed over the records' grams.

A filter is packed from the start: array<bigint> of 64-bit words, bit p being bit p % 64 of word p / 64. Sorted positions are a view of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgram.functions.hashing import HashFamily, IndexedDigest


def vocabulary(recs: DataFrame, bf_len: int, k: int, family: HashFamily | None = None) -> DataFrame:
    """q, pos: the position table, keyed by the unsalted q-gram."""
    grams = recs.select(F.explode("qs").alias("q")).distinct()
    return grams.select("q", (family or IndexedDigest()).positions(F.col("q"), bf_len, k).alias("pos"))


def n_words(bf_len: int) -> int:
    return -(-bf_len // 64)


def word_mask(bf_len: int, w: int) -> int:
    """The bits of word w that lie within the filter, as a signed number."""
    bits = (1 << min(64, bf_len - 64 * w)) - 1
    return bits - (1 << 64) if bits >> 63 else bits


def packed(pos: Column, bf_len: int) -> Column:
    """The filter of an array of positions."""
    word = lambda w: F.aggregate(
        F.filter(pos, lambda p: (p >= 64 * w) & (p < 64 * w + 64)),
        F.lit(0).cast("bigint"),
        lambda a, p: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (p - 64 * w).cast("int"))),
    )
    return F.array(*[word(w) for w in range(n_words(bf_len))])


def bit(words: Column, i: Column) -> Column:
    """Whether bit i of the filter is set."""
    word = F.get(words, F.call_function("shiftright", i, F.lit(6)))
    return F.call_function("shiftrightunsigned", word, i.bitwiseAND(63)).bitwiseAND(1) == 1


def positions(words: Column, bf_len: int) -> Column:
    """Sorted positions of the set bits."""
    return F.filter(F.sequence(F.lit(0), F.lit(bf_len - 1)), lambda i: bit(words, i))


def filter_of(df: DataFrame, bf_len: int) -> Column:
    """The packed filter of rows that have words, or else pos."""
    return F.col("words") if "words" in df.columns else packed(F.col("pos"), bf_len)


def set_bits(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.bit_count(w))


def encode_packed(recs: DataFrame, bf_len: int, k: int, family: HashFamily | None = None) -> DataFrame:
    """rec_id, words, n1 for each distinct record. Words are OR-ed by partial aggregation, so that a record's bits move as
    n_words longs; a record that several types hold is only OR-ed with itself."""
    n = n_words(bf_len)
    vocab = vocabulary(recs, bf_len, k, family).select("q", packed(F.col("pos"), bf_len).alias("words"))
    grams = recs.select("rec_id", F.explode("qs").alias("q")).join(vocab, "q")
    ored = grams.groupBy("rec_id").agg(*[F.bit_or(F.col("words")[w]).alias(f"w{w}") for w in range(n)])
    words = [F.col(f"w{w}") for w in range(n)]
    return ored.select("rec_id", F.array(*words).alias("words"), sum((F.bit_count(w) for w in words), F.lit(0)).cast("int").alias("n1"))


def encode(recs: DataFrame, bf_len: int, k: int, family: HashFamily | None = None) -> DataFrame:
    """rec_id, pos, n1: the same as sorted positions."""
    return encode_packed(recs, bf_len, k, family).select("rec_id", positions(F.col("words"), bf_len).alias("pos"), "n1")

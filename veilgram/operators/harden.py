"""BLIP bit flipping under keyed noise: a bit's fate depends on (seed, subset, side, record, position) alone.

ala flips a bit with probability prob; sch replaces it by a fair coin. Three sources of noise: a digest a bit (digest_noise: JVM
code, expressible in SQL), digests that fill whole words of biased bits (word_noise: the same, 64 bits at a time), and Philox
words over whole batches (counter_noise: for large data)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgram.config import LinkConfig
from veilgram.functions import random_words
from veilgram.operators.encode import bit, filter_of, n_words, packed, positions, set_bits, word_mask


def digest_up_to(prob: float) -> str:
    """The last digest (as text) whose first eight digits, as a number in [0, 1), are at most prob; digests are compared with it as they
    are, which is exact, as scaling by a power of two is."""
    n = math.floor(prob * 2**32)
    return f"{n:08x}" + 24 * "f" if n < 2**32 else "g"


def digest_noise(pos: Column, key: Column, bf_len: int, method: str, prob: float, here=None) -> Column:
    """Sorted positions after noise; key: 'seed|subset|side|rec_id'. here tells whether a position is set, if pos doesn't."""
    at = lambda i, what: F.md5(F.concat_ws("|", key, i.cast("string"), F.lit(what)))
    here = here or (lambda i: F.array_contains(pos, i))
    hit = lambda i: at(i, "u") <= digest_up_to(prob)
    on = {"ala": lambda i: here(i) != hit(i), "sch": lambda i: F.when(hit(i), at(i, "c") >= "8").otherwise(here(i))}[method]
    return F.filter(F.sequence(F.lit(0), F.lit(bf_len - 1)), on)


def digest_word(key: Column, w: Column, what: str | Column) -> Column:
    """64 random bits: the first 16 hex digits of md5(key|w|what)."""
    h = F.md5(F.concat_ws("|", key, w.cast("string"), F.lit(what)))
    return F.conv(F.substring(h, 1, 16), 16, -10).cast("bigint")


def word_noise(words: Column, key: Column, bf_len: int, method: str, prob: float) -> Column:
    """Packed filters after noise. A bit is hit if the bits of its random words, as binary digits, are below prob: each word settles half
    of the bits that are still open, and none is drawn once all are settled."""
    masks = F.array(*[F.lit(word_mask(bf_len, w)).cast("bigint") for w in range(n_words(bf_len))])

    digits = F.array(*[F.struct(F.lit(str(i)).alias("name"), F.lit(bool(one)).alias("one")) for i, one in enumerate(random_words.digits(prob) if prob < 1 else [])])

    def settled(a: Column, d: Column, w: Column) -> Column:
        drawn = F.array(a["open"].bitwiseAND(digest_word(key, w, d["name"])))  # of an array, so that it is drawn once
        one = lambda t: F.struct(a["open"].bitwiseXOR(t).alias("open"), a["hit"].bitwiseOR(t).alias("hit"))
        zero = lambda t: F.struct(t.alias("open"), a["hit"].alias("hit"))
        return F.get(F.transform(drawn, lambda t: F.when(d["one"], one(t)).otherwise(zero(t))), F.lit(0))

    def noised(x: Column, w: Column) -> Column:
        mask = F.get(masks, w)
        if prob >= 1:
            hit = mask
        else:
            start = F.struct(mask.alias("open"), F.lit(0).cast("bigint").alias("hit"))
            hit = F.aggregate(digits, start, lambda a, d: F.when(a["open"] == 0, a).otherwise(settled(a, d, w)), lambda a: a["hit"])
        if method == "ala":
            return x.bitwiseXOR(hit)
        return x.bitwiseAND(F.bitwise_not(hit)).bitwiseOR(digest_word(key, w, "c").bitwiseAND(hit))

    return F.transform(words, noised)


def noise_key(seed: int, subset: Column, side: Column, rec_id: Column) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), subset, side, rec_id.cast("string"))


def harden(bfs: DataFrame, bf_len: int, method: str, prob: float, seed: int, by_word: bool = False) -> DataFrame:
    """type, side, rec_id and pos or words -> pos, words and n1 noised; each side and subset has noise of its own. by_word: word_noise."""
    # The key is made once a row, before the rows move, not once a bit. Rows are small and the digests costly: spread them, or adaptive
    # execution packs them into one task.
    keyed = bfs.withColumn("_key", noise_key(seed, F.col("type"), F.col("side"), F.col("rec_id")))
    bfs, key = keyed.repartition(4 * bfs.sparkSession.sparkContext.defaultParallelism, "type", "side", "rec_id"), F.col("_key")
    rows = bfs.withColumn("words", filter_of(bfs, bf_len))
    if by_word:
        noised = rows.withColumn("words", word_noise(F.col("words"), key, bf_len, method, prob))
        return noised.withColumns({"pos": positions(F.col("words"), bf_len), "n1": set_bits(F.col("words"))}).drop("_key")
    noised = rows.withColumn("pos", digest_noise(None, key, bf_len, method, prob, lambda i: bit(F.col("words"), i)))
    return noised.withColumns({"words": packed(F.col("pos"), bf_len), "n1": F.size("pos")}).drop("_key")


def word_matrix(column: pa.Array) -> np.ndarray:
    """Filters of a batch as rows of words."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(column), -1)


def counter_noise(words: np.ndarray, keys: list[str], bf_len: int, method: str, prob: float) -> np.ndarray:
    """Rows of words after noise from a counter-based generator keyed by each row's string."""
    named = random_words.keys_of(keys)
    mask = np.array([word_mask(bf_len, w) for w in range(words.shape[1])], np.int64).view(np.uint64)
    hit = random_words.biased(named, words.shape[1], prob) & mask
    if method == "ala":
        return words ^ hit
    return (words & ~hit) | (random_words.biased(named, words.shape[1], 0.5, lane=1) & hit)


def noisy_dice(pairs: DataFrame, cfg: LinkConfig, noise: str) -> DataFrame:
    """pairs of a few probes (type, probe_id, cand_id, pw, cw: filters) with noisy_sim, under the noise of the linkage."""
    if noise == "md5" or cfg.flip_prob == 0:
        at = lambda side, words, i: digest_noise(None, noise_key(cfg.seed, F.col("type"), F.lit(side), F.col(i)), cfg.bf_len, cfg.flip_method, cfg.flip_prob, lambda x: bit(F.col(words), x)) if cfg.flip_prob else positions(F.col(words), cfg.bf_len)
        rows = pairs.withColumns({"pw": at("p", "pw", "probe_id"), "cw": at("c", "cw", "cand_id")})
        both = F.size("pw") + F.size("cw")
        sim = F.when(both == 0, 0.0).otherwise(F.lit(2.0) * F.size(F.array_intersect("pw", "cw")) / F.when(both > 0, both))
        return rows.withColumn("noisy_sim", sim).drop("pw", "cw")
    rest = pairs.drop("pw", "cw")
    names = rest.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            kinds = cols["type"].to_pylist()
            noised = [counter_noise(word_matrix(cols[w]), [f"{cfg.seed}|{t}|{side}|{i}" for t, i in zip(kinds, cols[who].to_pylist(), strict=True)], cfg.bf_len, cfg.flip_method, cfg.flip_prob) if b.num_rows else np.zeros((0, 1), np.uint64) for w, side, who in (("pw", "p", "probe_id"), ("cw", "c", "cand_id"))]
            size = lambda x: np.bitwise_count(x).sum(1, dtype=np.int64)
            sim = 2.0 * size(noised[0] & noised[1]) / np.maximum(size(noised[0]) + size(noised[1]), 1)
            yield pa.RecordBatch.from_arrays([*[cols[c] for c in names], pa.array(sim)], names=[*names, "noisy_sim"])

    return pairs.select(*names, "pw", "cw").mapInArrow(work, ", ".join(f"`{c}` {t}" for c, t in rest.dtypes) + ", noisy_sim double")

import math

import pytest
from pyspark.sql import functions as F

from veilgram import config
from veilgram.functions import similarity as sim
from veilgram.functions import text
from veilgram.functions.hashing import IndexedDigest, SeededTwister, unit
from veilgram.operators import encode, harden, stats


def test_tokeniser(spark):
    rows = spark.createDataFrame([("hello",), ("ab",), ("aaaa",), ("a",), (" \t A b ",), ("　Zoë\x85",), (None,)], "v string")
    got = [r.s for r in rows.select(text.qgram_set([text.normal_attr(F.col("v"))]).alias("s")).collect()]
    assert got == [["el", "he", "ll", "lo"], ["ab"], ["aa"], [], ["ab"], ["oë", "zo"], []]


def test_positions(spark):
    mt = SeededTwister()
    assert mt.draws("he", 1000, 10) == [26, 703, 566, 466, 390, 825, 765, 858, 150, 809]
    assert mt.draws("é1", 1000, 10) == [852, 529, 130, 882, 600, 121, 912, 38, 365, 505]
    assert mt.draws("he", 1024, 5) == [52, 933, 781, 300, 940]
    assert SeededTwister("sha1").draws("he", 1000, 10) == [241, 990, 501, 281, 257, 631, 401, 16, 441, 205]
    assert SeededTwister("sha1", "test salt str").draws("he", 1000, 10) == [247, 153, 374, 476, 169, 301, 52, 50, 903, 801]
    rows = spark.createDataFrame([("he",), ("o'",)], "q string")
    got = [r.p for r in rows.select(IndexedDigest().positions(F.col("q"), 1000, 10).alias("p")).collect()]
    assert got == [sorted([802, 916, 705, 921, 662, 754, 813, 489, 988, 352]), sorted([110, 490, 924, 194, 544, 363, 645, 550, 118, 449])]
    grams = ["he", "el", "ll", "lo", "o ", " w", "wo", "or", "rl", "ld"]
    rec = spark.createDataFrame([("x", grams)], "rec_id string, qs array<string>")
    for digest, n, first in (("md5", 95, [26, 49, 52, 78, 85, 97, 103, 115, 118, 128, 150, 151]), ("sha1", 97, [16, 22, 45, 48, 50, 59, 68, 70, 87, 94, 101, 152])):
        row = encode.encode(rec, 1000, 10, SeededTwister(digest)).first()
        assert (row.n1, row.pos[:12]) == (n, first)


def test_similarities(spark):
    sets = spark.createDataFrame([(["he", "el", "ll", "lo"], ["he", "el", "lp"]), (["a", "b"], ["a", "c"])], "a array<string>, b array<string>")
    got = [tuple(r) for r in sets.select(sim.qgram_dice(F.col("a"), F.col("b")), sim.qgram_jaccard(F.col("a"), F.col("b")), sim.qgram_hamming(F.col("a"), F.col("b"))).collect()]
    assert got == [(0.5714285714285714, 0.4, 0.4), (0.5, 0.3333333333333333, 0.33333333333333337)]
    bits = spark.createDataFrame([([0b0011], [0b0101]), ([0b0111], [0b0011]), ([0b0011], [0b1100])], "a array<long>, b array<long>")
    n = lambda c: sim.popcount(F.col(c), 1)
    x = sim.bits_xor(F.col("a"), F.col("b"), 1)
    got = [tuple(r) for r in bits.select(sim.dice(sim.bits_and(F.col("a"), F.col("b"), 1), n("a"), n("b")), sim.hamming(x, 4), sim.clamped_jaccard(x, 4)).collect()]
    assert got == [(0.5, 0.5, 0.0), (0.8, 0.75, 0.5), (0.0, 0.0, 0.0)]


def test_packed(spark):
    row = spark.createDataFrame([([0, 63, 64, 129],)], "p array<int>").select(encode.packed(F.col("p"), 130).alias("w")).first()
    assert row.w == [1 - (1 << 63), 1, 2]


def test_optimal_hash_count(spark):
    sets = spark.createDataFrame([([f"{i}" for i in range(20)],)], "qs array<string>")
    assert stats.optimal_hash_count(sets, 1000).first().k_opt == 34
    assert config.hash_count(34, 0.5) == 17
    with pytest.raises(ValueError):
        config.hash_count(1, 0.5)


def test_noise_golden_and_rates(spark):
    pos = spark.range(4).select(*[unit(F.concat_ws("|", F.lit("42|q_f|p|2"), F.col("id").cast("string"), F.lit(c))).alias(c) for c in "uc"]).orderBy("u")
    got = sorted((round(r.u, 9), r.c >= 0.5) for r in pos.collect())
    assert [u for u, _ in got] == sorted([0.509289929, 0.851190345, 0.368422157, 0.136667288])
    rows = spark.range(200).select(F.lit("t").alias("type"), F.lit("p").alias("side"), F.col("id").alias("rec_id"), F.array().cast("array<int>").alias("pos"), F.lit(0).alias("n1"))
    for method, rate in (("ala", 0.1), ("sch", 0.05)):
        n = harden.harden(rows, 500, method, 0.1, 1).agg(F.sum("n1")).first()[0]
        assert abs(n - 1e5 * rate) < 4 * math.sqrt(1e5 * rate)


def test_parameters():
    for bad in ({"encoding": "rse"}, {"hardening": "x"}, {"bf_len": 1}, {"k_ratio": 3}, {"flip_method": "x"}, {"flip_prob": 2}):
        with pytest.raises(ValueError):
            config.LinkConfig(**bad)
    assert config.LinkConfig(flip_method="ala", flip_prob=0.25).epsilon == pytest.approx(math.log(3))

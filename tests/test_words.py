"""Packed filters, random words, products with bounds and top k, generators over arrays, and scans by range, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgram.config import ALL_TYPES, LinkConfig
from veilgram.functions import random_words
from veilgram.functions.hashing import SeededTwister
from veilgram.operators import encode, harden, match
from veilgram.plans.linkage import Linkage
from veilgram.sources import people


def test_philox_is_numpys():
    for k in random_words.keys_of(["42|q_f|p|2", "x", ""]):
        want = np.random.Philox(counter=[6, 7, 8, 9], key=[int(x) for x in k]).random_raw(12)
        got = [random_words.philox([np.array([c], np.uint64) for c in (7 + i, 7, 8, 9)], (k[:1], k[1:])) for i in range(3)]
        assert [int(x[0]) for four in got for x in four] == want.tolist()


@pytest.mark.parametrize("prob", [0.0, 0.5, 0.25, 0.1, 1 / 3, 0.97, 1.0])
def test_biased_words_hold_their_rate(prob):
    words = random_words.biased(random_words.keys_of([str(i) for i in range(3000)]), 5, prob)
    n = words.size * 64
    assert abs(int(np.bitwise_count(words).sum()) - n * prob) <= 4 * math.sqrt(n * prob * (1 - prob)) + n * 2**-32
    for b in (0, 63):  # no place is favoured
        here = int(((words >> np.uint64(b)) & np.uint64(1)).sum())
        assert abs(here - words.size * prob) <= 4.5 * math.sqrt(words.size * prob * (1 - prob)) + 1e-3


def test_biased_words_do_not_depend_on_company(monkeypatch):
    keys = random_words.keys_of([str(i) for i in range(50)])
    whole = random_words.biased(keys, 7, 0.3)
    monkeypatch.setattr(random_words, "CHUNK", 3)
    assert (random_words.biased(keys, 7, 0.3) == whole).all()
    assert (random_words.biased(keys[20:21], 7, 0.3) == whole[20]).all()


def test_encoder_packs(spark):
    recs = spark.createDataFrame([("x", ["he", "el"]), ("x", ["he", "el"]), ("y", ["lo"])], "rec_id string, qs array<string>")
    for bf_len in (64, 100, 256):
        table = {r.q: r.pos for r in encode.vocabulary(recs, bf_len, 7).collect()}
        want = {"x": sorted({*table["he"], *table["el"]}), "y": sorted(table["lo"])}
        rows = encode.encode_packed(recs, bf_len, 7).select("rec_id", "n1", "words", encode.positions(F.col("words"), bf_len).alias("pos"), encode.set_bits(F.col("words")).alias("n")).collect()
        assert {r.rec_id: r.pos for r in rows} == want and all(r.n == r.n1 == len(r.pos) and len(r.words) == encode.n_words(bf_len) for r in rows)
        assert {r.rec_id: r.pos for r in encode.encode(recs, bf_len, 7).collect()} == want


@pytest.mark.parametrize("method", ["ala", "sch"])
def test_word_noise(spark, method):
    """Rates, and no bit beyond the filter's length."""
    bf_len, p = 300, 0.2
    pos = F.filter(F.sequence(F.lit(0), F.lit(bf_len - 1)), lambda i: i % 2 == 0)
    rows = spark.range(300).select(F.lit("t").alias("type"), F.lit("p").alias("side"), F.col("id").alias("rec_id"), pos.alias("pos"), F.lit(0).alias("n1"))
    got = harden.harden(rows, bf_len, method, p, 1, by_word=True).select("words", "n1", "pos").collect()
    changed = sum(len(set(r.pos) ^ set(range(0, bf_len, 2))) for r in got)
    n, rate = 300 * bf_len, p if method == "ala" else p / 2
    assert abs(changed - n * rate) < 4 * math.sqrt(n * rate * (1 - rate))
    assert all(sum((w & (1 << 64) - 1).bit_count() for w in r.words) == r.n1 == len(r.pos) for r in got)
    words = np.array([r.words for r in rows.select(encode.packed(F.col("pos"), bf_len).alias("words")).collect()], np.int64).view(np.uint64)
    noised = harden.counter_noise(words, [str(i) for i in range(300)], bf_len, method, p)
    assert abs(int(np.bitwise_count(noised ^ words).sum()) - n * rate) < 4 * math.sqrt(n * rate * (1 - rate))
    assert not (noised[:, -1] >> np.uint64(bf_len - 64 * (encode.n_words(bf_len) - 1))).any()


def sample(spark, n=400):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        qs = sorted({rng.choice("abcdef") + rng.choice("abcd") for _ in range(rng.choice([1, 2, 5, 12]))})
        rows.append((f"{i}", i, ALL_TYPES[i % 12] if i < 120 else "b", qs))
    return spark.createDataFrame(rows, "rec_id string, ord long, type string, qs array<string>").repartition(4)


def plain(link, bf_len, noise):
    """All pairs, one by one."""
    bits = {}
    kept = {r.rec_id: r.words for r in link.bfs.collect()}
    types = [(r.type, r.rec_id) for r in link.sample.collect()]

    def filter_of(code, side, i):
        if (code, side, i) not in bits:
            w = np.array([kept[i]], np.int64).view(np.uint64)
            bits[code, side, i] = harden.counter_noise(w, [f"{noise[2]}|{code}|{side}|{i}"], bf_len, *noise[:2])[0] if noise else w[0]
        return bits[code, side, i]

    out = {}
    for code, i in types:
        if code != "b":
            p, sims = filter_of(code, "p", i), {}
            for other, j in types:
                if other in (code, "b"):
                    c = filter_of(code, "c", j)
                    both = int(np.bitwise_count(p).sum() + np.bitwise_count(c).sum())
                    sims[j] = 2.0 * int(np.bitwise_count(p & c).sum()) / max(both, 1)
            out[code, i] = sims
    return out


@pytest.mark.parametrize("noise", [None, ("ala", 0.1, 42), ("sch", 0.5, 42)])
def test_products_against_all_pairs(spark, monkeypatch, noise):
    """Blocks of a few records, so that bounds decide; ties at the maximum and at the k-th place."""
    link = Linkage(sample(spark), LinkConfig(bf_len=70))
    want = plain(link, 70, noise)
    monkeypatch.setattr(match, "PROBES", 4)
    monkeypatch.setattr(match, "CANDS", 8)
    best = match.block_product(*link.sides_once, 70, noise).collect()
    assert len(best) == len(want)
    for r in best:
        sims = want[r.type, r.probe_id]
        top = max(sims.values())
        assert (r.best, r.ties, r.hit) == (top, sum(s == top for s in sims.values()), int(sims[r.probe_id] == top))
        assert r.compared <= len(sims)
    k = 5
    got = {}
    for r in match.top_product(*link.sides_once, 70, k, noise).collect():
        got.setdefault((r.type, r.probe_id), []).append((r.place, r.cand_id, r.sim))
    assert {x: sorted(v) for x, v in got.items()} == {x: [(i + 1, c, s) for i, (c, s) in enumerate(sorted(sims.items(), key=lambda cs: (-cs[1], cs[0]))[:k])] for x, sims in want.items()}


def test_bounds_rule_out_pairs():
    """Filters of many densities, each probe among the candidates: most blocks lie below what the own copy gives."""
    rng = np.random.default_rng(3)
    density = rng.integers(1, 60, 3000)
    bits = np.array([rng.permutation(np.arange(256) < 4 * d) for d in density], np.uint8)
    words = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    n1, ids = bits.sum(1, dtype=np.int64), np.arange(3000)
    found = match.Best(match.Probes("f_h", ids[::10], words[::10], 256).ready(), 0)
    match.compare(found, bits.astype(np.float32), n1, ids, 8, 64)
    assert (found.top == 1).all() and (found.hit == 1).all()
    assert found.compared.sum() < 0.2 * 300 * 3000
    assert match.bound(np.array([3, 5]), np.array([5, 9])) == 1.0 and match.bound(np.array([3, 5]), np.array([10, 20])) == 10 / 15 and match.bound(np.array([0, 0]), np.array([4])) == 0.0


def test_twister_is_the_librarys():
    grams = [f"{a}{b}" for a in "abcdeé'" for b in "nopqr "]
    for digest, salt, below, k in (("md5", "", 1000, 10), ("sha1", "pepper", 1024, 7), ("sha256", "", 2, 40), ("md5", "", 3, 900), ("sha512", "x", 100_000, 1)):
        family = SeededTwister(digest, salt)
        assert family.all_draws(grams, below, k).tolist() == [family.draws(g, below, k) for g in grams]
    assert SeededTwister().all_draws([], 10, 3).shape == (0, 3)


def twist(seed_words, n):
    from veilgram.functions import hashing

    return hashing.twister_draws(np.array(seed_words, np.uint32).reshape(-1, 1), 1 << 20, n)[0].tolist()


def test_twister_seeds_of_other_sizes():
    for seed in (0, 1, (1 << 32) - 1, 1 << 32, 1 << 120):
        words = [seed >> 32 * i & 0xFFFFFFFF for i in range(max(1, -(-seed.bit_length() // 32)))]
        rng = random.Random(seed)
        assert twist(words, 20) == [rng.randint(0, (1 << 20) - 1) for _ in range(20)]


ODD = [
    b'id,status_code,fn,ln\n1,A,Jo\xffhn,Smith\n\n2,a,,Lee\n3,a,"An ""x"" n","Multi\n\nline, ""really""\n"\n4,a,short\n 5 , A , Ann , Lee \n6,i,Bob,Ray,more\n7,a,"",last',
    b'id,status_code,fn,ln\n8,a,"\n\n\n",x\n' + b"".join(b'%d,a,"first\nsecond ""%d""",plain\n' % (i, i) for i in range(200)),
    b"id,status_code,fn,ln\n",
    b'id,status_code,fn,ln\n9,a,z,"open\nto the end\n10,a,b,c',
]


@pytest.mark.parametrize("size", [48, 700, 1 << 20])
def test_scan_by_range_is_the_scan(spark, tmp_path, size):
    """Ranges of a few bytes cut records, quotes and empty lines; files come by path, whatever their sizes."""
    for i, data in enumerate(ODD):
        (tmp_path / f"{i}.csv").write_bytes(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        whole = people.scan(spark, str(tmp_path)).orderBy("ord").collect()
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        split = people.scan_split(spark, str(tmp_path)).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.ord for r in whole] == list(range(len(whole))) and len(whole) > 200
    assert [r.id for r in whole][:7] == ["1", "2", "3", "4", " 5 ", "6", "7"]
    fields = lambda rows: [tuple(r)[:5] + (r[people.BAD] is None,) for r in rows]
    assert fields(split) == fields(whole)

import random

import pytest
from pyspark.sql import functions as F

from veilgram.config import ALL_TYPES, LinkConfig
from veilgram.operators import match
from veilgram.plans.linkage import Linkage


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        qs = sorted({rng.choice("abcdef") + rng.choice("abc") for _ in range(rng.randint(2, 5))})
        code = ALL_TYPES[i % 12] if i < 36 else "b"
        rows.append((f"{i}", i, code, qs))
    return spark.createDataFrame(rows, "rec_id string, ord long, type string, qs array<string>").persist()


def rows(df):
    return sorted((r.type, r.probe_id, r.best, r.ties, r.hit, r.outcome) for r in df.collect())


def test_equality_join_is_brute_force(sample):
    link = Linkage(sample, LinkConfig(bf_len=64))
    assert rows(link.clean) == rows(match._best(match.pairs(*link.sides, 64)))


def test_block_product_is_word_counts(sample):
    link = Linkage(sample, LinkConfig(bf_len=100, flip_method="ala", flip_prob=0.05), "md5")
    h = link.hardened.persist()
    p = h.filter("side = 'p'").select("type", F.col("rec_id").alias("probe_id"), "pos", "n1")
    c = h.filter("side = 'c'").select("type", F.col("rec_id").alias("cand_id"), "pos", "n1")
    assert rows(match.block_product(p, c, 100)) == rows(match._best(match.pairs(p, c, 100)))


def test_counter_noise(sample):
    link = Linkage(sample, LinkConfig(bf_len=128, flip_method="ala", flip_prob=0.02))
    once, again = rows(link.noisy), rows(match.block_product(link.sides[0], link.sides[1].repartition(3), 128, ("ala", 0.02, 42)))
    assert once == again
    assert rows(match.block_product(*link.sides, 128, ("ala", 0.0, 42))) == rows(link.clean)


def test_base_once_and_in_passes(sample, monkeypatch):
    """The base as one row a record, and probes in many passes, change nothing."""
    link = Linkage(sample, LinkConfig(bf_len=128, flip_method="sch", flip_prob=0.1))
    want = rows(match.block_product(*link.sides, 128, ("sch", 0.1, 42)))
    assert rows(link.noisy) == want and rows(match.clean(*link.sides)) == rows(link.clean)
    monkeypatch.setattr(match, "MAX_PROBE_BYTES", 128 * 4 * 10)
    assert rows(match.block_product(*link.sides_once, 128, ("sch", 0.1, 42))) == want


@pytest.mark.parametrize("noise", ["md5", "philox"])
def test_diagnostics(sample, noise):
    link = Linkage(sample, LinkConfig(bf_len=128, flip_method="ala", flip_prob=0.05), noise)
    top = link.diagnostics(3, 2)
    assert {"probe_bits", "cand_bits", "noisy_sim"} <= set(top.columns)
    best = {(r.type, r.probe_id): r.best for r in link.noisy.collect()}
    assert all(0 <= r.noisy_sim <= best[r.type, r.probe_id] for r in top.collect())


def test_tally(sample):
    tally = Linkage(sample, LinkConfig(bf_len=64, flip_prob=0.0)).tally.persist()
    assert tally.count() == 12 * 2 * 4
    assert {r.n for r in tally.groupBy("type", "metric").agg(F.sum("n").alias("n")).collect()} == {3}
    wide = match.to_report(tally)
    assert set(wide.columns) == {"id", "og_bf_dice", "blip_bf_dice"} and wide.count() == 12

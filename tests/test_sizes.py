"""Faults that showed on larger tables only, on small tables of the same kind."""

import pytest
from oracle import compare, duck

from veilgram.plans.catalogue import QUERIES
from veilgram.plans.oracles import ORACLES

SF = "/root/testdata/sf0.001"


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["people_ordered", "people_ordered_split"])
def test_values_without_words_keep_their_breaks(spark, tmp_path, name):
    texts = ["one two three", "123", "", None, "only", " \n ", "l'une"]
    d = documents(spark, tmp_path, [(i, texts[i % len(texts)], "en") for i in range(30)])
    assert compare(spark, duck(d), QUERIES[name], ORACLES[name], d) == 30


@pytest.mark.parametrize("name", ["qgram_dice", "qgram_jaccard", "qgram_hamming", "bf_dice", "bf_hamming", "bf_jaccard"])
def test_pairs_of_a_frequent_key_are_spread(spark, monkeypatch, name):
    """Blocks of 3 change no pair, and no join has a frequent key for its only key."""
    from veilgram.operators import pairs

    monkeypatch.setattr(pairs, "BLOCK", 3)
    assert compare(spark, duck(SF), QUERIES[name], ORACLES[name], SF) > 0
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "_i#" in plan and plan.count("Join Inner") == 3  # sizes to each side, and the cells


@pytest.mark.parametrize("prob", [0.0, 0.1, 0.5, 0.7310585786300049, 1.0])
def test_digests_are_compared_as_they_are(spark, prob):
    """The text comparison is the numeric one, at the border too."""
    from pyspark.sql import functions as F

    from veilgram.functions.hashing import unit
    from veilgram.operators.harden import digest_up_to

    last = digest_up_to(prob)
    if prob < 1:
        n = int(last[:8], 16)
        assert n / 2**32 <= prob < (n + 1) / 2**32
    rows = spark.range(2000).select((unit(F.col("id").cast("string")) <= prob).alias("a"), (F.md5(F.col("id").cast("string")) <= last).alias("b"))
    assert rows.filter("a <> b").count() == 0


def test_probes_are_held_packed(spark):
    """What a task holds of a probe is its words, not a number a bit."""
    import numpy as np

    from veilgram.operators import match

    words = np.arange(400, dtype=np.uint64).reshape(100, 4)
    p = match.Probes("f_h", np.arange(100), words, 256).ready()
    assert sum(v.nbytes for v in vars(p).values() if isinstance(v, np.ndarray)) < 100 * 64


def test_noise_keys_are_made_once_a_row(spark):
    from pyspark.sql import functions as F

    from veilgram.operators import harden

    rows = spark.createDataFrame([("f_h", "p", "1", [3, 5])], "type string, side string, rec_id string, pos array<int>")
    plan = harden.harden(rows, 64, "ala", 0.1, 42).select("type", "n1")._jdf.queryExecution().optimizedPlan().toString()
    assert "_key" in plan.split("Repartition")[0] and "conv(" not in plan
    assert harden.harden(rows, 64, "ala", 0.0, 42).select(F.to_json("pos").alias("p")).first().p == "[3,5]"


def test_pairs_of_a_cell_come_by_member(spark):
    """One id stays while the other goes through a block by ord, so that files of pairs stay small; rows of a key are met as blocks."""
    from pyspark.sql import functions as F

    from veilgram.operators import pairs

    rows = spark.createDataFrame([(str(o), o, "k", o % 7) for o in ((37 * i) % 101 for i in range(101))], "rec_id string, ord long, k string, n int")
    found = pairs.within(rows, "k", lambda a, b: (a("n") + b("n")).cast("double"))
    got = [(int(r.a_id), int(r.b_id), r.sim) for r in found.collect()]
    assert sorted(got) == [(a, b, float(a % 7 + b % 7)) for a in range(101) for b in range(a + 1, 101)]
    stays = sum(p[0] == q[0] or p[1] == q[1] for p, q in zip(got, got[1:], strict=False))
    assert stays >= len(got) - 2 * 101
    later = [q[1] > p[1] for p, q in zip(got, got[1:], strict=False) if p[0] == q[0]]
    assert all(later) and found.agg(F.count("*")).first()[0] == 5050


def test_cells_are_dealt_to_several_tasks_a_core(spark):
    from veilgram.operators import pairs

    rows = spark.createDataFrame([(str(i), i, "k") for i in range(3000)], "rec_id string, ord long, k string")
    found = pairs.within(rows, "k", lambda a, b: (a("ord") + b("ord")).cast("double"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    n = 8 * spark.sparkContext.defaultParallelism
    assert plan.count("RepartitionByExpression [k#") == 2 and plan.count(f"], {n}") >= 2
    assert found.count() == 3000 * 2999 // 2


def test_blocks_and_tasks_of_long_keys_are_bounded():
    """Rows of a key are sent to a bounded number of blocks, however many they are; most tasks have pairs of one sum of sizes."""
    from veilgram.operators import pairs

    few = {n: max(1, 1000 - 40 * (n - 11) ** 2) for n in range(6, 17)}
    for times in (1, 10, 100):
        kinds, cells, n = pairs.laid_out([("an", n, m * times) for n, m in few.items()] + [("zz", 3, 5)], 64)
        size = {b: s for key, s, first, k in kinds if key == "an" for b in range(first, first + k)}
        assert set(size) == set(range(len(size))) and len(size) <= 2 * pairs.BLOCKS
        assert {c[:3] for c in cells} == {("an", i, j) for j in size for i in range(j + 1)} | {("zz", 0, 0)}
        assert len(cells) == len(size) * (len(size) + 1) // 2 + 1 and {c[3] for c in cells} <= set(range(n))
        sums = {}
        for key, i, j, task, _ in cells:
            sums.setdefault(task, set()).add((key, key == "an" and size[i] + size[j]))
        assert sum(len(s) == 1 for s in sums.values()) > 0.8 * len(sums)
    assert pairs.laid_out([], 64) == ([], [], 64)


def test_files_of_pairs_hold_few_bits_of_a_pair(spark, tmp_path):
    """No id is written anew for each pair, and few values meet in a file."""
    import random

    from pyspark.sql import functions as F

    from veilgram.operators import pairs

    r = random.Random(5)
    made = [(str(100000 + 7 * i), i, "k", r.getrandbits(20) | 1) for i in range(6000)]
    rows = spark.createDataFrame(made, "rec_id string, ord long, k string, bits long").withColumn("n", F.bit_count("bits"))
    found = pairs.within(rows, "k", lambda a, b: 2.0 * F.bit_count(a("bits").bitwiseAND(b("bits"))) / (a("n") + b("n")), "n")
    found.write.parquet(str(tmp_path / "out"))
    held = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.filter("cast(a_id AS long) < cast(b_id AS long)").count() == 6000 * 5999 // 2
    assert held < 0.8 * got.count(), held / got.count()


def test_words_of_a_pair_are_never_null(spark):
    """With branches for nulls, the code for a pair was over what the JVM compiles."""
    from veilgram.operators import pairs

    rows, words = pairs.spread(spark.createDataFrame([("1", [3, -1])], "rec_id string, bits array<long>"), "bits", 2)
    assert not any(rows.schema[c].nullable for c in words(str))
    assert tuple(rows.first()) == ("1", 3, -1)

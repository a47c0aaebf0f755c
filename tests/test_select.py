import random

import pytest
from pyspark.sql import functions as F

from veilgram.config import SampleConfig
from veilgram.operators import dedupe, evaluate, select, stats

MICRO = ["an nn na", "jo oh hn", "an nd dy", "jo oe", "an ny jo", "zz an"]


def recs(spark, sets):
    return spark.createDataFrame([(f"r{i + 1}", i, sorted(set(s.split()))) for i, s in enumerate(sets)], "rec_id string, ord long, qs array<string>")


def chosen(spark, sets, n):
    r = recs(spark, sets)
    prof = stats.profile(r, stats.ranked(stats.frequencies(r))).persist()
    return {k: {x.rec_id for x in v.collect()} for k, v in select.by_frequency(prof, n).items()}


WANT = {
    1: ("r1", "r6", "r1"), 2: ("r1 r3", "r2 r6", "r1 r2"), 3: ("r1 r3 r5", "r2 r4 r6", "r1 r2 r3"), 4: ("r1 r3 r5 r6", "r1 r2 r4 r5", "r1 r2 r3 r4"),
}


def test_micro_corpus(spark):
    for n, want in WANT.items():
        got = chosen(spark, MICRO, n)
        assert tuple(got[k] for k in ("q_f", "q_r", "q_a")) == tuple(set(w.split()) for w in want), n


def loops(sets, n):
    """The selection as stages that fill up in file order."""
    sets = [set(s.split()) for s in sets]
    df = {}
    for s in sets:
        for q in s:
            df[q] = df.get(q, 0) + 1
    order = sorted(df, key=lambda q: (-df[q], q))
    top, rare = [], []
    for i, s in enumerate(sets):
        if order[0] in s and len(top) < n:
            top.append(i)
        elif order[-1] in s and len(rare) < n:
            rare.append(i)
    for into, ranks in ((top, order[1:]), (rare, order[-2::-1])):
        for q in ranks:
            for i, s in enumerate(sets):
                if len(into) < n and q in s and i not in into:
                    into.append(i)
    mean = min(sum(df.values()) // len(df), max(df.values()))
    near = []
    for d in range(max(df.values()) + 1):
        keys = {q for q in df if abs(df[q] - mean) == d}
        for i, s in enumerate(sets):
            if len(near) < n and s & keys and i not in near:
                near.append(i)
    name = lambda x: {f"r{i + 1}" for i in x}
    return {"q_f": name(top), "q_r": name(rare), "q_a": name(near)}


def test_closed_forms_against_loops(spark):
    rng = random.Random(3)
    for _ in range(6):
        sets = [" ".join(rng.sample("ab bc cd de ef fg gh hi".split(), rng.randint(1, 4))) for _ in range(rng.randint(6, 14))]
        n = rng.randint(1, 5)
        got, want = chosen(spark, sets, n), loops(sets, n)
        assert {k: got[k] for k in want} == want, (sets, n)


def test_upsert(spark):
    rows = spark.createDataFrame([("x", 0, ["ab"]), ("y", 1, ["cd"]), ("x", 2, ["ef"]), ("z", 3, ["ab"])], "rec_id string, ord long, qs array<string>")
    got = sorted(tuple(r) for r in dedupe.upsert(dedupe.distinct_sets(rows)).select("rec_id", "ord", "qs", "n_replaced").collect())
    assert got == [("x", 0, ["ef"], 1), ("y", 1, ["cd"], 0)]


def test_random_samples_are_disjoint_and_stable(spark):
    r = spark.range(100).select(F.col("id").cast("string").alias("rec_id"), F.col("id").alias("ord"))
    nine = r.filter("ord < 10")
    cfg = SampleConfig(n_subset=5, n_base=40)
    sets = [sorted((x.type, x.rec_id) for x in select.random_and_base(select.shuffled(r.repartition(p), nine, cfg), cfg).collect()) for p in (1, 3, 8)]
    assert sets[0] == sets[1] == sets[2]
    assert len({i for _, i in sets[0]}) == 55 and not {i for _, i in sets[0]} & {str(i) for i in range(10)}
    with pytest.raises(select.TooFewRecords):
        select.need(3, 4, "x")


def test_type_counter_and_validation(spark):
    rows = spark.createDataFrame([("1", "f_h", 0), ("1", "l_s", 1), ("1", "f_a", 2), ("2", "b", 3)], "rec_id string, type string, ord int")
    assert {r.types: r.n for r in evaluate.multi_type_counts(rows).collect()} == {"f_h,l_s": 1, "f_a,f_h,l_s": 1}
    with pytest.raises(ValueError):
        evaluate.validate(rows, 1, 1)

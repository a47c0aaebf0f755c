import random

from veilgram.llm import near_dups, simhash


def test_the_dedup_stage_links_by_fingerprints_and_by_similarity(spark):
    """Document 1 has the fingerprint of 0, though their sets of five-word shingles are unlike; 3 is similar to 2 by its set only."""
    import corpus_pipeline

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    tail, base = [" ".join(word() for _ in range(60)) for _ in range(2)], [word() for _ in range(300)]
    edited = list(base)
    edited[40] = edited[90] = edited[160] = edited[220] = "other"
    texts = ["word " * 4000 + tail[0], "word " * 4000 + tail[1], " ".join(base), " ".join(edited), "quite another text of its own words"]
    fp = [simhash.fingerprint(simhash.shingle_hashes(t.encode())) for t in texts]
    assert (fp[0] ^ fp[1]).bit_count() <= 2 < (fp[2] ^ fp[3]).bit_count()
    # 5 repeats 1: one node
    frame = spark.createDataFrame([*enumerate(texts), (5, texts[1]), (None, texts[0])], "doc_id long, text string")
    assert {r.doc_id for r in near_dups.deduplicated(frame).collect()} == {0, 1, 2, 4, None}
    assert {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, frame, "").collect()} == {0, 2, 4, None}


def test_raking_queries_stay_small(spark, monkeypatch):
    """However many rounds are raked, a query holds the windows of STEP of them, with the same weights to the last bit."""
    from veilgram.llm import mixing

    cell = spark.createDataFrame([(f"s{i % 3}", f"l{i % 4}", f"t{i % 5}", 1 + i * i % 97) for i in range(60)], "source string, lang string, topic string, tokens long").groupBy("source", "lang", "topic").agg({"tokens": "sum"})
    cell = cell.withColumnRenamed("sum(tokens)", "tokens")
    seen, sql = [], type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, query, *a, **b: seen.append(query.count("OVER")) or sql(self, query, *a, **b))
    small = sorted(map(tuple, mixing.raked(cell, rounds=11, tolerance=-1.0).collect()))
    assert len(small) == 60 and sum(seen) == 33 and max(seen) <= 6
    monkeypatch.setattr(mixing, "STEP", mixing.BLOCK)
    assert small == sorted(map(tuple, mixing.raked(cell, rounds=11, tolerance=-1.0).collect())) and max(seen) == 24


def test_few_links_are_joined_without_rounds(spark, monkeypatch):
    """Each round is jobs and plans that the driver holds; a path took one round after the other. More edges than a task joins at a time give the same."""
    from veilgram.llm import common, components

    rng = random.Random(5)
    ids = list(range(300))
    rng.shuffle(ids)
    edges = [(ids[i], ids[i + 1]) for i in range(199)] + [(ids[250], ids[i]) for i in range(200, 300)]
    want = {i: min(part) for part in (ids[:200], ids[200:]) for i in part if i != min(part)}
    frame = spark.createDataFrame(edges, "a long, b long")
    written, put = [], common.Scratch.put
    monkeypatch.setattr(common.Scratch, "put", lambda self, name, *a: written.append(name) or put(self, name, *a))
    assert {r.b: r.a for r in components.stars(frame).collect()} == want and len(written) <= 2
    monkeypatch.setattr(components, "EDGES", 7)
    assert {r.b: r.a for r in components.stars(frame).collect()} == want and len(written) > 4
    assert components.stars(frame.limit(0)).count() == 0


def test_sieves_go_to_the_tasks_as_bits(spark):
    import numpy as np

    ids = spark.createDataFrame([(i,) for i in (3, 4, 1000, 2**40)], "doc_id long")
    sieve = near_dups.sieve_of(ids)
    assert sieve.nbytes <= near_dups.SIEVE // 8
    at = [r.p for r in ids.select(near_dups.place("doc_id").alias("p")).collect()]
    rest = np.array([p for p in range(200) if p not in at], np.int32)
    assert near_dups.in_sieve(sieve, np.array(at, np.int32)).all() and not near_dups.in_sieve(sieve, rest).any()

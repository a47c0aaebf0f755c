"""Scoring, line dedup, SimHash, fingerprints and chat against brute force on small tables with odd rows."""

import hashlib
import math
import random
from collections import Counter

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilgram.llm import chat, components, line_dedup, lm_score, merkle, near_dups, simhash

SCHEMA = "doc_id long, text string, score double, shard int, fp string, n_lines string"
SPACE = " \t\n\x0b\x0c\r"


def odd_rows(seed=1):
    rng = random.Random(seed)
    vocab = "the of Ärger to and naïve x Line END".split()
    line = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 9)))
    shared = ["this LINE is shared by many\t", "\x0bthis line is shared by many", "short", "ÄÖÜ line äöü"]
    rows = [(i, "\n".join(rng.choice([line(), rng.choice(shared)]) for _ in range(rng.randint(1, 6)))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "\n\n"), (43, " \t "), (44, rows[3][1]), (45, rows[3][1]), (46, "a b " * 30000), (47, "\n".join(["this line is shared by many"] * 3))]
    return [(i, t, 0.5, 1, "f", "n") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    out, w = [], ""
    for c in (t or "") + " ":
        if c in SPACE:
            out += [w] if w else []
            w = ""
        else:
            w += c.lower() if "A" <= c <= "Z" else c
    return out


@pytest.mark.parametrize("leave_out", [True, False])
def test_lm_score(docs, empty, leave_out):
    texts = {i: words(t) for i, t, *_ in odd_rows()}
    counted = lambda w, k: Counter(tuple(w[i - k : i + 1]) for i in range(k, len(w)))
    n = [sum((counted(w, k) for w in texts.values()), Counter()) for k in range(3)]
    total, mic = sum(n[0].values()), lambda c: round(math.log(c) * 1e6)
    want = {}
    for i, w in texts.items():
        own = [counted(w, k) if leave_out else Counter() for k in range(3)]
        f = lambda k, g: n[k][g] - own[k][g]  # noqa: E731, B023
        s = uni = 0
        for j in range(len(w)):
            for k in range(min(j, 2), -1, -1):
                g = tuple(w[j - k : j + 1])
                if k == 0:
                    s, uni = s + mic(max(f(0, g), 1)) - mic(max(total - len(w) * leave_out, 1)), uni + 1
                elif f(k, g):
                    s += mic(f(k, g)) - mic(f(k - 1, g[:-1]))
                    break
                else:
                    s += mic(0.4)
        want[i] = (len(w), uni, s)
    for chunk in (1, 1 << 20):
        got = {r.doc_id: (r.n_words, r.n_unigram, r.score_micro) for r in lm_score.scores(docs, leave_out=leave_out, chunk=chunk).collect()}
        assert got == want
    assert lm_score.scores(empty).count() == 0
    assert lm_score.scores(docs.filter("doc_id = 40")).first().mean_log is None
    alone = lm_score.scores(docs.filter("doc_id = 0")).first()
    assert alone.n_unigram == alone.n_words and alone.score_micro == sum(mic(0.4) * min(j, 2) for j in range(alone.n_words))


def test_lm_score_fails_if_the_input_changes():
    size, by_order, place = lm_score.grams([b"a b c d"])
    n = len(lm_score.listed(by_order, place))
    with pytest.raises(RuntimeError, match="changed"):
        lm_score.scored_chunk([b"a b c e"], lm_score.np.ones(n, int), int(lm_score.listed(by_order, place).sum()), 3, True)


def line_brute(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    first = {}
    for i, t in sorted(rows):
        for x in (t or "").split("\n"):
            first.setdefault(key(x), i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(docs, empty):
    want = line_brute([(i, t) for i, t, *_ in odd_rows()])
    for batches, fanout in ((4, 2), (1, 2), (7, 3)):
        out = line_dedup.dedup_lines(docs, batches, fanout)
        assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in out.collect()} == want
    assert "fp" in out.columns and out.columns.count("n_lines") == 1
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_runs_go_on(spark):
    """A later batch meets the lines of earlier ones, over several levels."""
    runs = line_dedup.LineRuns(spark)
    dropped = []
    for b in range(5):
        batch = spark.createDataFrame([(k, 0, b) for k in (b, b - 1, 99)], "h1 long, h2 long, doc_id long")
        dropped.append({r.h1 for r in runs.add(batch, f"{runs.root}/b{b}").collect()})
    assert dropped == [set(), {0, 99}, {1, 99}, {2, 99}, {3, 99}]
    assert len(runs.levels) > 2


def test_line_runs_are_neither_dealt_out_nor_sorted_again(spark):
    runs = line_dedup.LineRuns(spark, fanout=4)
    for b in range(3):
        batch = spark.range(1000).selectExpr("id * 7 + 1 AS h1", "id AS h2", f"{b} AS doc_id").repartition(5)
        runs.add(batch, f"{runs.root}/b{b}")
    spark.conf.set(line_dedup.ORDERED, "true")
    plan = runs.fresh(batch)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(line_dedup.ORDERED, "false")
    assert plan.count("SortMergeJoin") == 3 and plan.count("Sort [") == 1 and plan.count("Exchange hash") == 1, plan
    assert plan.rindex("HashAggregate") > plan.rindex("SortMergeJoin"), plan  # grouped first


def test_line_null_id(spark):
    rows = spark.createDataFrame([(None, "a line to be kept once"), (1, "a line to be kept once"), (1, "a line to be kept once")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_dropped) for r in line_dedup.dedup_lines(rows).collect()) == [(-1, 1), (1, 0), (1, 0)]
    rows = spark.createDataFrame([(None, "a line of many rows\nx", 1, 2), (None, "a line of many rows\ny", 1, 2)], "doc_id long, text string, _id int, _drop int")
    out = line_dedup.dedup_lines(rows)
    assert out.columns == ["doc_id", "text", "_id", "_drop", "n_lines", "n_dropped"] and sorted(r.n_dropped for r in out.collect()) == [0, 1]


def simhash_brute(rows, bits=2):
    f = {}
    for i, t in rows:
        w = words(t)
        sh = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        f[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return f, grouped(f, lambda a, b: (a ^ b).bit_count() <= bits)


def grouped(f, near):
    up = {i: i for i in f}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sorted(f):
        for b in f:
            if near(f[a], f[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in f}


@pytest.mark.parametrize("pairs", [32, 1])
def test_simhash(docs, empty, monkeypatch, pairs):
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    f, comp = simhash_brute([(i, t) for i, t, *_ in odd_rows()])
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.components(docs).collect()}
    assert got == {i: (f[i], comp[i]) for i in f}
    assert simhash.components(empty).count() == 0


@pytest.mark.parametrize("pairs", [32, 4])
def test_links_between_fingerprints(spark, monkeypatch, pairs):
    """Chains and clouds of fingerprints a few bits apart: the same components as all pairs."""
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = random.Random(2)
    fps = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(30):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
            fps.add(x)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    nodes = spark.createDataFrame([(signed(v),) for v in fps], "fp long")
    star = {r.b: r.a for r in components.stars(simhash.links(nodes)).collect()}
    want = grouped({signed(v): signed(v) for v in fps}, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {v: star.get(v, v) for v in want} == want


def test_golay_code_is_perfect():
    near, more = simhash.decoding()
    assert len(set(near.tolist())) == 2048 and sorted(Counter((more > 0).sum(1).tolist()).items()) == [(0, 277), (5, 1771)]


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r.b: r.a for r in components.stars(path).collect()} == {**{i: 0 for i in range(1, 61)}, 101: 100}


def near_texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, groups = [], []
    for g in range(12):
        base = [word() for _ in range(300)]
        members = []
        for k in range(4 if g else 50):
            t = list(base)
            for p in rng.sample(range(300), 2 if k else 0):
                t[p] = word()
            members.append(len(rows))
            rows.append((len(rows), " ".join(t)))
        groups.append(members)
    return rows, groups


def test_near_dups(spark, empty):
    rows, groups = near_texts()
    rows += [(len(rows), rows[0][1].upper()), (None, rows[0][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    kept = {r.doc_id for r in near_dups.deduplicated(frame).collect()}
    assert kept == {g[0] for g in groups} | {None}
    assert near_dups.deduplicated(empty).count() == 0


def test_near_dups_against_jaccard(spark):
    """Every pair at 0.8 and more is in one group, and no other links, against all pairs."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(100):
        base = [word() for _ in range(rng.choice([6, 20, 90, 250]))]
        for _ in range(3):
            t = list(base)
            for p in rng.sample(range(len(t)), rng.randint(0, 1 + len(t) // 40)):
                t[p : p + 1] = rng.choice([[], [word()], [word(), word()]])
            texts.append(" ".join(t))
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in enumerate(map(str.split, texts))}
    want = grouped(sets, lambda x, y: 9 * len(x & y) >= 4 * (len(x) + len(y)))
    close = sum(0.75 <= len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.85 for a in sets for b in range(a))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert close > 20 and {r.doc_id for r in near_dups.deduplicated(frame).collect()} == set(want.values())


def test_bitmaps_bound_what_is_shared():
    rng = near_dups.np.random.default_rng(9)
    sets = []
    for size in (0, 1, 5, 400, 511, 512, 513, 3000, 9000):
        base = rng.integers(0, 1 << 63, size).astype("uint64")
        sets += [near_dups.np.unique(base), near_dups.np.unique(near_dups.np.concatenate([base[: size * 9 // 10], rng.integers(0, 1 << 63, size // 10).astype("uint64")]))]
    pairs = [(x, y) for x in sets for y in sets]
    n, m = (near_dups.np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    most = near_dups.most_shared(*[[near_dups.bitmap(p[k]) for p in pairs] for k in (0, 1)], n, m)
    shared = near_dups.np.array([len(near_dups.np.intersect1d(x, y)) for x, y in pairs])
    apart = (n == m) & (n > 300) & (shared == 0)
    assert (most >= shared).all() and (most[apart] < 0.4 * n[apart]).all()


def star_texts():
    """A centre of middle id; each copy is within 0.8 of it, by other words replaced, and not of each other."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    base = [word() for _ in range(400)]
    texts = []
    for _ in range(1500):
        t = list(base)
        for p in rng.sample(range(400), 7):
            t[p] = word()
        texts.append(" ".join(t))
    texts.insert(750, " ".join(base))
    return texts


def test_near_dups_star(spark, monkeypatch):
    texts = star_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    assert [r.doc_id for r in near_dups.deduplicated(frame).collect()] == [0]
    monkeypatch.setattr(near_dups, "BLOCK", 40)
    monkeypatch.setattr(near_dups, "at_hubs", lambda left, order: left.limit(0).select(F.col("id").alias("a"), F.col("id").alias("b")))
    assert [r.doc_id for r in near_dups.deduplicated(frame.filter("doc_id BETWEEN 650 AND 850")).collect()] == [650]


def test_merkle(spark, docs, empty):
    rows = sorted((i, t or "") for i, t, *_ in odd_rows())
    got = {r.doc_id: r for r in merkle.compared(docs).collect()}
    for k, (i, t) in enumerate(rows):
        nxt, r = rows[(k + 1) % len(rows)][1], got[i]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.edited_fingerprint == merkle.tree(edited.encode()).fingerprint()
        assert (r.near_next == 1) == (t == nxt) and 0 <= r.near_edited <= 1
    assert got[44].fingerprint == got[45].fingerprint and len({r.fingerprint for r in got.values()}) == len({t for _, t in rows})
    assert merkle.compared(empty).count() == 0
    one = merkle.compared(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert (one.doc_id, one.near_next) == (None, 1.0)
    assert {r.doc_id: r.fingerprint for r in merkle.fingerprints(docs).collect()} == {i: r.fingerprint for i, r in got.items()}


def mark(text):
    return merkle.tree(text.encode()).fingerprint()


def test_merkle_edits():
    lines = [f"paragraph {i} of words that go on" for i in range(40)]
    other = list(lines)
    other[7] = "something else"
    a, b = (mark("\n".join(x)) for x in (lines, other))
    alike, left, right = merkle.compare(a, b)
    assert (left, right) == ([7], [7]) and 0.9 < alike < 1 and merkle.compare(a, a) == (1.0, [], [])
    swapped = [lines[1], lines[0], *lines[2:]]
    assert 0.9 < merkle.compare(a, mark("\n".join(swapped)))[0] < 1
    alike, left, right = merkle.compare(a, mark("\n".join(lines[:30] + ["a new line"] + lines[30:])))
    assert (left, right) == ([], [30]) and alike < 1
    assert merkle.compare(a, mark("\n".join(lines[5:])))[1:] == (list(range(5)), [])
    assert merkle.compare(mark(""), mark("x"))[0] == 0 and merkle.compare(mark("\n"), mark("\n\n"))[0] < 1
    assert merkle.compare(mark("a b c"), mark("a b\nc"))[0] < 1


def longest(xs, ys):
    """Length of the longest common subsequence by the full table, each element weighing its nodes."""
    row = [0] * (len(ys) + 1)
    for x in xs:
        new = [0]
        for j, y in enumerate(ys):
            new.append(max(row[j] + (x == y), row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_merkle_likeness_against_brute_force():
    """Where no leaf occurs twice, matched leaves are no more than the longest common subsequence of all leaves, and as
    many if one run of words was replaced; near_* never is 1 for unequal texts."""
    rng = random.Random(3)
    leaves = lambda m: [p[k : k + 4] for s in m[33:].split("|") for p in s.split(",") for k in range(0, len(p), 4)]
    for _ in range(150):
        words = [f"w{x}" + rng.choice(["", "", "", "", "\nx"]) for x in rng.sample(range(10**6), rng.randint(1, 200))]
        a = " ".join(words)
        p, q = sorted(rng.sample(range(len(words) + 1), 2))
        other = words[:p] + [f"n{x}" for x in rng.sample(range(10**6), rng.randint(0, 9))] + words[q:]
        b = " ".join(other)
        x, y = mark(a), mark(b)
        shared, rest_x, rest_y = merkle.walk(x, y)
        count = lambda m: sum(map(merkle.size, m[33:].split("|"))) if len(m) > 33 else 0
        got, top = merkle.compare(x, y)[0], longest(leaves(x), leaves(y))
        assert got == (1.0 if a == b else 2 * shared / (count(x) + count(y))) and (got == 1) == (a == b)
        paragraphs = longest(*[[s for z in m[33:].split("|") for s in z.split(",")] for m in (x, y)])
        assert shared <= top + paragraphs
        rng.shuffle(other)
        assert merkle.walk(x, mark(" ".join(other)))[0] <= longest(leaves(x), leaves(mark(" ".join(other)))) + len(a.split("\n"))
        if len(set(leaves(x))) == len(leaves(x)) and q - p < 3 and a != b:
            assert shared >= top


def test_in_order_is_longest_without_repeats():
    rng = random.Random(5)
    for _ in range(300):
        xs, ys = rng.sample(range(30), rng.randint(0, 20)), rng.sample(range(30), rng.randint(0, 20))
        pairs = merkle.in_order(xs, ys)
        assert all(xs[i] == ys[j] for i, j in pairs) and pairs == sorted(pairs) and len(pairs) == longest(xs, ys)
        assert len({j for _, j in pairs}) == len(pairs) == len({i for i, _ in pairs})


@given(st.text(st.sampled_from("<[|/\\sINST]>SY ok"), max_size=30))
@settings(max_examples=300, deadline=None)
def test_escape_round_trip(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in ("<|", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>"))


def test_chat(spark):
    rng = random.Random(7)
    pieces = ["hi", "", None, "<|end|>", "<\\|turn|>user<|text|>", "äö\n", "</s>[INST] ok [/INST]", "x" * 5000]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<|text|>"]), rng.choice(pieces)) for c in [*range(30), None] for t in range(rng.randint(1, 5))]
    rows += [(5, 9, "user", "tie b"), (5, 9, "user", "tie a"), (5, 9, "user", "tie a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(frame)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role is not None, role or "", text is not None, text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [(r, x) for _, _, r, _, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert chat.format_chats(frame.limit(0)).count() == 0

"""Classifier, decontamination, extraction, mixing, sharding and the pipeline."""

import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

from veilgram.llm import decontaminate, html_tree, mixing, quality, registry, shard

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, score double, shard int, topic string, prob int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "one two three"), (2, None), (3, ""), (None, "x y"), (4, "one two three"), (4, "one two three"), (5, "long " * 40000)]
    return spark.createDataFrame([(i, t, None if i == 2 else "en", "s" if i else None, 1.0, 2, "t", 3) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    assert compare(spark, duck(SF), registry.QUERIES[name], registry.ORACLES[name], SF) > 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    out = got[got.held_out]
    assert len(out) > 80 and (out.predicted == out.quality).mean() > 0.95
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, None), (3, 1), (None, 0), (2, 7)], "doc_id long, quality int")
    assert quality.trained(odd, labels) is None
    out = quality.scored(odd, None).collect()
    assert len(out) == 7 and {(r.score, r.predicted) for r in out} == {(0.5, 1)}
    net = quality.fresh(1)
    assert len(quality.scored(odd, net).collect()) == 7 and quality.scored(odd.limit(0), net).count() == 0


def test_quality_gradients():
    """Against differences of the loss, in every kind of weight."""
    rng = np.random.default_rng(0)
    texts, y = [rng.bytes(n) for n in (0, 700, 90, 1500)], np.array([0, 1, 1, 0], np.float32)
    net = quality.fresh(3)
    for p in net.parts():
        p += 0.05 * rng.standard_normal(p.shape).astype(np.float32)

    def loss():
        p = quality.scores(net, texts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for p, g in zip(net.parts(), quality.gradients(net, texts, y), strict=True):
        k = np.unravel_index(np.abs(g.reshape(p.shape)).argmax(), p.shape)
        old, h = p[k], 1e-2
        p[k] = old + h
        up = loss()
        p[k] = old - h
        down = loss()
        p[k] = old
        assert (up - down) / (2 * h) == pytest.approx(float(g.reshape(p.shape)[k]), rel=0.15, abs=1e-4)


def test_quality_covers_whole_text():
    """A byte change anywhere can move a block's value: blocks cover all bytes."""
    net = quality.fresh(1)
    data, first = quality.laid_out([b"a" * 5000])
    assert quality.block_max(net, data)[0].shape[0] == len(data) // quality.BLOCK and first.tolist() == [0]
    pieces = quality.PIECE
    try:
        whole = quality.scores(net, [bytes(range(256)) * 20])
        quality.PIECE = 2
        assert np.allclose(whole, quality.scores(net, [bytes(range(256)) * 20]))
    finally:
        quality.PIECE = pieces


def naive_score(net, text):
    """The definition, window by window: blocks of the padded text's windows that begin in them, chunks of two blocks."""
    blocks = (len(text) + quality.SPAN + quality.BLOCK - 1) // quality.BLOCK
    data = text + b"\0" * (blocks * quality.BLOCK - len(text))
    best = []
    for b in range(blocks):
        at = [i for i in range(b * quality.BLOCK, (b + 1) * quality.BLOCK, quality.STRIDE) if i + quality.SPAN <= len(data)]
        best.append(np.max([net.embed[list(data[i : i + quality.SPAN])].ravel() @ net.filters for i in at], 0))
    chunks = [np.maximum(np.maximum(x, y) + net.bias, 0) for x, y in zip(best, [*best[1:], best[-1]], strict=True)]
    h = np.maximum(np.concatenate([np.max(chunks, 0), np.mean(chunks, 0)]) @ net.hidden + net.hidden_bias, 0)
    return 1 / (1 + np.exp(-float((h @ net.out + net.out_bias)[0])))


def test_quality_scores_against_brute_force():
    rng = np.random.default_rng(4)
    net = quality.fresh(5)
    for p in net.parts():
        p += 0.05 * rng.standard_normal(p.shape).astype(np.float32)
    texts = [b"", b"x", "äöü € text".encode(), *[rng.bytes(int(n)) for n in (503, 504, 505, 511, 512, 513, 1024, 3000)], b"of the and " * 200]
    assert np.allclose(quality.scores(net, texts), [naive_score(net, t) for t in texts], atol=1e-5)
    assert np.allclose([quality.scores(net, [t])[0] for t in texts], quality.scores(net, texts), atol=1e-6)


def test_quality_query_against_brute_force(spark):
    """All rows of the query, whole texts: each score is the definition's under the net that the query fits."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    net = quality.trained(docs, labels)
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = quality.query(spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows[::4]:
        assert abs(r.score - naive_score(net, text[r.doc_id])) < 1e-4 and r.predicted == (r.score >= 0.5)
    from zlib import crc32

    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_quality_sample_is_bounded_by_bytes(spark):
    rows = [(i, ("good words here. " if i % 2 else "xx!! ") * 30, i % 2) for i in range(60)] + [(100, "x" * (quality.LONGEST + 1), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    seen = []
    real, quality.fit = quality.fit, lambda texts, labels: seen.append((sum(map(len, texts)), max(map(len, texts), default=0), len(texts)))
    try:
        quality.trained(docs.drop("quality"), docs.drop("text"), max_bytes=4000)
        quality.trained(docs.drop("quality"), docs.drop("text"))
    finally:
        quality.fit = real
    assert 0 < seen[0][0] <= 4000 and seen[1][1] <= quality.LONGEST and seen[1][2] >= 30


def edit_brute(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5)))
    items = [[word() for _ in range(rng.randint(9, 50))] for _ in range(30)]
    docs, edits = [], []
    for i in range(240):
        item = list(items[i % 30])
        for _ in range(int(len(item) * 0.08) if i % 2 else 0):
            p = rng.randrange(len(item))
            item[p : p + 1] = rng.choice([[], [word()], [item[p], word()]])
        body = [word() for _ in range(200)]
        if i < 200:
            body[100:100] = item
        docs.append((i, " ".join(w.upper() + "," if k % 9 == 0 else w for k, w in enumerate(body))))
        edits.append([w for w in body])
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(99, None), (98, ""), (None, "a b")], "item_id long, text string")
    extra = [(None, docs[0][1]), (0, docs[0][1]), (900, None), (901, "")]
    frame = spark.createDataFrame([*docs, *extra], "doc_id long, text string").withColumn("item_id", F.lit("x"))
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.hits(frame, bench).collect()}
    want = {(i, i % 30): edit_brute(items[i % 30], edits[i]) for i in range(200)}
    assert all(got[k] == 0 for k, d in want.items() if d == 0)
    found = [k for k in want if k in got]
    assert len(found) >= 0.95 * len(want) and all(got[k] == want[k] for k in found)
    assert set(got) <= set(want) | {(None, 0)}
    left = {r.doc_id for r in decontaminate.clean(frame, bench).collect()}
    assert left == {i for i, _ in [*docs, *extra]} - {i for i, _ in got}
    few = decontaminate.portions(bench, 400)
    assert sum(len(p.ids) for p in few) == 30
    assert decontaminate.hits(frame.limit(0), bench).count() == 0 and decontaminate.hits(frame, bench.limit(0)).count() == 0


@pytest.mark.parametrize("where", ["start", "middle", "end"])
def test_decontamination_gathered_edits(where):
    """Passages with all edits up to LIMIT at one place: missing or replaced words."""
    rng = np.random.default_rng(3)
    word = lambda n: rng.integers(1, 500, n).astype(np.uint64)
    lengths = [1, 3, 4, 5, 9, 10, 15, 31, 50, 64, 100, 127]
    items = decontaminate.Items(list(range(len(lengths))), [" ".join(f"w{w}" for w in word(n)).encode() for n in lengths])
    docs, want = [], {}
    for i, item in enumerate(items.words):
        k = int(decontaminate.LIMIT * len(item))
        p = {"start": 0, "middle": (len(item) - k) // 2, "end": len(item) - k}[where]
        for swap in (np.zeros(0, np.uint64), word(k)):
            want[len(docs), i] = k
            docs.append(np.concatenate([word(60), item[:p], swap, item[p + k :], word(60)]))
    got = {(d, i): dist for d, i, dist, _ in decontaminate.matches(items, docs)}
    assert all(got.get(x, 1000) <= k for x, k in want.items())


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2])
def test_decontamination_recall_of_edited(share):
    """Edited passages alone, edits anywhere: all that brute force finds up to LIMIT, at the same distance."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(400)}"
    texts = [[word() for _ in range(rng.randint(20, 127))] for _ in range(40)]
    items = decontaminate.Items(list(range(40)), [" ".join(t).encode() for t in texts])
    docs = []
    for t in texts:
        t = list(t)
        for p in sorted(rng.sample(range(len(t)), max(1, int(share * len(t)))), reverse=True):
            t[p : p + 1] = rng.choice([[], [word()], [t[p], word()]])
        docs.append([*[word() for _ in range(40)], *t, *[word() for _ in range(40)]])
    want = {(i, i): d for i, t in enumerate(texts) if 0 < (d := edit_brute(t, docs[i])) <= decontaminate.LIMIT * len(t)}
    coded = [decontaminate.words(" ".join(d).encode()) for d in docs]
    got = {(d, i): dist for d, i, dist, _ in decontaminate.matches(items, coded)}
    assert len(want) > 30 and {x: got.get(x) for x in want} == want


def test_decontamination_walks_meet_their_recall():
    """Matches whose only unchanged words are one run of q: the worst case of the windows, by the repetitions alone."""
    rng, missed, n = random.Random(21), 0, 0
    fresh = iter(range(1000, 10**9))
    for length in (12, 30, 60):
        k = int(decontaminate.LIMIT * length)
        for _ in range(100):
            item = [f"w{next(fresh)}" for _ in range(length)]
            items = decontaminate.Items([0], [" ".join(item).encode()])
            q = decontaminate.run(length, decontaminate.LIMIT)
            at = sorted(rng.sample(range(length), k))
            text = [f"x{next(fresh)}" if i in at else w for i, w in enumerate(item)]
            found = decontaminate.matches(items, [decontaminate.words(" ".join(["a"] * 9 + text + ["b"] * 9).encode())])
            missed, n = missed + (not found or found[0][2] != k), n + 1
            p = rng.randrange(length - q + 1)  # and the candidates of one run in fresh words
            alone = [f"y{next(fresh)}" for _ in range(p)] + item[p : p + q] + [f"z{next(fresh)}" for _ in range(length - p - q)]
            got = items.candidates(decontaminate.words(" ".join(alone).encode()), np.array([length]))
            missed, n = missed + (not len(got[0])), n + 1
    assert missed <= 1, (missed, n)


def test_clean_keeps_columns_of_any_name(spark):
    frame = spark.createDataFrame([(1, "a b c d e", "x", "y"), (2, "q r s t u", "x", "y")], "doc_id long, text string, _own string, _bad string")
    bench = spark.createDataFrame([(5, "a b c d e")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.clean(frame, bench).collect()] == [(2, "q r s t u", "x", "y")]
    long_text = "filler " * 400000 + "a b c d e" + " more" * 100000
    frame = spark.createDataFrame([(1, long_text)], "doc_id long, text string")
    assert [(r.item_id, r.start_word) for r in decontaminate.hits(frame, bench).collect()] == [(5, 400000)]


def test_decontamination_first_word():
    rng = np.random.default_rng(2)
    item = [f"w{w}" for w in rng.integers(0, 900, 30)]
    items = decontaminate.Items([0], [" ".join(item).encode()])
    for lead in (0, 3, 17):
        for kept in (item, item[:10] + item[12:]):
            doc = decontaminate.words(" ".join([*["x"] * lead, *kept, "y", "y"]).encode())
            assert decontaminate.matches(items, [doc]) == [(0, 0, 30 - len(kept), lead)]


def test_clean_judges_rows_without_id(spark):
    item = "a passage of the benchmark that must not be in here"
    rows = [(None, f"so {item} it is"), (None, "a clean text"), (None, "a clean text"), (1, item), (2, "clean too")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in decontaminate.clean(frame, bench).collect()) == [(0, "a clean text")] * 2 + [(2, "clean too")]


def test_distances():
    rng = np.random.default_rng(1)
    items = [rng.integers(2, 6, rng.integers(1, 9)).astype(np.uint64) for _ in range(60)]
    texts = [rng.integers(2, 6, rng.integers(1, 15)).astype(np.uint64) for _ in range(60)]
    assert decontaminate.distances(items, texts).tolist() == [edit_brute(a.tolist(), b.tolist()) for a, b in zip(items, texts, strict=True)]


def test_html_marginals_are_exact():
    """Against sums over all labellings of a small tree."""
    from itertools import product

    page = html_tree.parse("<body><div class=ad><p>x y.</p></div><p>main text here, yes.</p></body>")
    rng = np.random.default_rng(0)
    unary, pair = rng.standard_normal((html_tree.N_FEATURES, 2)), rng.standard_normal((2, 2, 2))
    f = html_tree.forest([page])
    n = len(f.parent)
    total, on = 0.0, np.zeros(n)
    for y in product((0, 1), repeat=n):
        s = sum(y[i] * (f.x[i] @ unary[:, f.kind[i]]) + (pair[f.kind[i], y[f.parent[i]], y[i]] if i else 0) for i in range(n))
        total += np.exp(s)
        on += np.exp(s) * np.array(y)
    assert np.allclose(html_tree.marginals(f, unary, pair)[0], on / total)


def test_html_held_out_pages():
    rng, w = random.Random(1234), html_tree.model()
    good = n = 0
    for _ in range(150):
        page, y = html_tree.labelled(html_tree.make_page(rng))
        p = html_tree.marginals(html_tree.forest([page]), *w)[0]
        good, n = good + sum((p[i] >= 0.5) == y[i] for i in page.text), n + len(page.text)
    assert good / n > 0.98


def test_html_text(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="cookie-notice">We use cookies, please accept.</div><article><h1>A title &amp; more</h1><p>First <b>bold</b> paragraph&nbsp;with
 text, that goes on for a while.<br>And on, and so on, again and again.<script>var t="</p>";</script></p><div class="ad">Buy this now.</div>
<p>Second paragraph &lt;here&gt;, with enough words in it to be read.</article><div class="comments"><p>Nice post, thanks.</p></div>
<form><p>Search the site</p></form><footer>&copy; example &middot; All rights.</footer></body></html>"""
    rows = spark.createDataFrame([(1, "u", page, "old"), (2, "u", None, "old"), (3, "u", "", None), (4, "u", "<p><<b <!-- x", None)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_tree.main_text(rows).collect()}
    assert got[1] == "A title & more\nFirst bold paragraph with text, that goes on for a while. And on, and so on, again and again.\nSecond paragraph <here>, with enough words in it to be read."
    assert got[2] == got[3] == "" and 4 in got
    assert html_tree.main_text(rows.limit(0)).count() == 0


def test_html_odd_markup():
    """Read by the standard's states: quotes count at the start of a value only, and nothing after odd tags is lost."""
    w, p = html_tree.model(), "A paragraph {} of words, long enough to be read as text, and more."
    body = lambda *parts: f"<body><nav><a href=/>Home</a></nav><article><h1>Some title</h1>{''.join(parts)}</article><footer>&copy; 2020</footer>"
    three = [p.format(k) for k in ("one", "two, it's odd", "three")]
    want = "\n".join(["Some title", *three])
    cases = [
        body(f"<p don't>{three[0]}", f"<p>{three[1]}</p>", f'<p a"b>{three[2]}</p>'),
        body(f"<p title='a > b' class=x>{three[0]}</p>", f'<p data="<p>">{three[1]}</p>', f"<P CLASS=\"a\"id='b'/>{three[2]}</P>"),
        body(f"<p>{three[0]}</p><!-- <p>not this</p> --><!--->", f"<p>{three[1]}</p><?php x ?>", f"<p>{three[2]}</p></3>"),
        body(f"<p>{three[0]}</p><svg>", f"<p>{three[1]}</p><button>", f"<p>{three[2]}</p>"),
        body(f"<p>{three[0]}</p><script>if (a</b) '</p>'</script>", f"<p>{three[1]}</p><style>a>b</style x>", f"<p>{three[2]}</p>"),
    ]
    assert html_tree.extract(cases, w) == [want] * len(cases)
    assert html_tree.extract([body(f"<p>{three[0].replace('paragraph', 'paragraph &lt; 3 < 4 <5')}</p>")], w)[0].endswith("A paragraph < 3 < 4 <5 one of words, long enough to be read as text, and more.")
    assert html_tree.extract([body(f"<p>{three[0]}</p>") + '<p class="never closed ends at the next >' + three[1] + "</p>"], w)[0].startswith("Some title\n" + three[0])
    assert html_tree._hints("title='class=ad' class=content class=ad") == (html_tree._hints("class=content")[0], False, " content")


def test_html_long_pages_in_linear_time():
    import time

    w = html_tree.model()
    for piece in ('<p class="x ', "<div>", "</div><p>x", "<p a='><p b=\">", "<button>x", "<svg><p>x", "<!-- ", "<!-", "</p>x<b ", "<p>" + "word " * 50 + "</p>"):
        began = time.perf_counter()
        html_tree.extract(["<body>" + piece * (5_000_000 // len(piece))], w)
        assert time.perf_counter() - began < 60, piece


def test_html_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "<p>x", "mine", 2)], "page_id long, html string, parent string, text int")
    out = html_tree.main_text(rows)
    assert out.columns == ["page_id", "html", "parent", "text"] and out.first().parent == "mine"


def test_html_pages_of_the_table(spark):
    for r in html_tree.query(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer)", r.html, re.S)[1]
        blocks = [" ".join(__import__("html").unescape(re.sub("<[^>]*>", " ", x) if "<br>" in x else re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_mixing_meets_its_margins(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    keys = mixing.Keys(docs)
    given = keys.cells(keys.marked(docs))
    rows = mixing.raked(given)
    cell, given = rows.toPandas(), given.toPandas()
    given["t"] = given.tokens**mixing.TEMPERATURE
    for m in mixing.MARGINS:
        want = given.groupby(m).t.sum()
        assert np.allclose(cell.groupby(m).w.sum(), want / want.sum(), atol=1e-8)
    assert mixing.margin_error(rows) <= mixing.TOLERANCE
    target = spark.createDataFrame([("en", 1.0), ("fr", 1.0), ("xx", 5.0)], "key string, share double")
    assert {r.lang for r in mixing.mixed(docs, {"lang": target}).select("lang").distinct().collect()} == {"en", "fr"}


def test_mixing_by_shuffles_and_by_a_given_topic(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted((r.doc_id, r.topic, round(r.prob, 9)) for r in mixing.mixed(docs).collect())
    monkeypatch.setattr(mixing, "CELLS", 1)
    assert sorted((r.doc_id, r.topic, round(r.prob, 9)) for r in mixing.mixed(docs).collect()) == want
    marked = docs.withColumn("label", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("t"), F.col("doc_id") % 3)))
    got = mixing.mixed(marked, topic="label")
    assert {r.topic for r in got.collect()} == {"(null)", "t1", "t2"} and "label" in got.columns


def test_mixing_odd_rows(spark, odd):
    out = mixing.mixed(odd)
    assert out.columns.count("topic") == 1 and out.count() <= 7 and mixing.mixed(odd.limit(0)).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    clash = odd.withColumns({c: F.lit("mine") for c in ("_source", "_lang", "_topic", "_lot", "_most", "_words", "_hits")})
    got = mixing.mixed(clash)
    assert got.columns[: len(clash.columns) - 2] == [c for c in clash.columns if c not in ("topic", "prob")]
    assert {tuple(r) for r in got.select("_source", "_lang", "_topic", "_lot", "_most", "_words", "_hits").collect()} <= {("mine",) * 7}
    unnamed = spark.createDataFrame([(None, f"text {i} of many", "en", "s") for i in range(400)] + [(i, "word " * 40, "en", "t") for i in range(100)], "doc_id long, text string, lang string, source string")
    assert 0 < mixing.mixed(unnamed).filter("doc_id IS NULL AND text LIKE '%many'").count() <= 400


def test_shards(spark, odd):
    for n in (1, 2, 7, 40, 97):
        got = [r[0] for r in spark.range(n).select(shard.place(F.col("id"), n, 3)).collect()]
        assert got == [shard.permute(i, n, 3) for i in range(n)] and sorted(got) == list(range(n))
    out = shard.assign_shards(odd, 3)
    got = out.toPandas()
    sizes = got.groupby("shard").slot.agg(["count", "max"])
    assert len(got) == 7 and sizes["count"].max() - sizes["count"].min() <= 1 and (sizes["max"] == sizes["count"] - 1).all()
    assert "Python" not in out._jdf.queryExecution().toString()
    assert shard.assign_shards(odd.limit(0)).count() == 0
    a, b = (shard.query(spark, SF).repartition(k).toPandas().sort_values("doc_id").reset_index(drop=True) for k in (1, 5))
    assert a.equals(b) and a.groupby("shard").size().max() - a.groupby("shard").size().min() <= 1


def test_shards_of_repeated_ids(spark):
    """The same rows in another order and number of partitions get the same shards and slots; names may clash."""
    rows = [(i // 4 if i % 3 else None, f"t{i}", "a", "b") for i in range(400)]
    seen = []
    for seed, parts in ((1, 1), (2, 7)):
        random.Random(seed).shuffle(rows)
        frame = spark.createDataFrame(rows, "doc_id long, text string, _number string, _place string").repartition(parts)
        out = shard.assign_shards(frame)
        assert out.columns == ["doc_id", "text", "_number", "_place", "shard", "slot"]
        seen.append(sorted((r.doc_id or -1, r.text, r._number, r.shard, r.slot) for r in out.collect()))
    assert seen[0] == seen[1] and len({x[3:] for x in seen[0]}) == 400


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES][-1] == "sharding"
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, SF).persist()
        assert 0 < out.count() <= seen.count(), name
        assert set(docs.columns) <= set(out.columns)
        if name != "sharding":
            assert out.columns == docs.columns
            assert out.join(seen, docs.columns, "left_anti").count() == 0
        seen = out
    hits = decontaminate.hits(seen, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert hits.count() == 0
    want = sorted((r.doc_id, r.shard, r.slot) for r in seen.collect())
    assert sorted((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_pipeline_odd_rows(spark):
    """Nulls in any column, empty, repeated and long rows, clashing columns and an empty table, through all stages."""
    import corpus_pipeline

    names = "_id _own _source _lang _lot _number _place _order _tie key digest score predicted id part topic tokens prob".split()
    some = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows = [*some, (None, None, None, None, None), (None, "", "en", None, 0), (5000, None, None, "s", 0), (5001, "", "en", "s", 0), some[0], some[1], (None, some[2][1], "en", "s", 1), (5002, "word " * 60000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs = docs.withColumns({n: F.lit("mine") for n in names})
    for frame in (docs, docs.limit(0)):
        seen = frame
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, seen, SF).persist()
            assert out.count() <= seen.count(), name
            assert out.columns[: len(docs.columns)] == docs.columns, name
            assert {tuple(r) for r in out.select(*names).distinct().collect()} <= {("mine",) * len(names)}, name
            if name != "mixing" and frame is docs:
                assert out.count() > 0, name
            seen = out


def test_rest_works_without_the_subpackage(tmp_path):
    """A copy without the llm folders and the pipeline still imports."""
    import shutil

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "veilgram", tmp_path / "veilgram", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 30 and len(e.oracle_sql()) > 30"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)

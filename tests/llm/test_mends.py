"""Pages that mark nothing, inner headers and footers; fingerprints of repeated, short and space-free texts."""

import random
from html.parser import HTMLParser

import pytest

from veilgram.llm import html_tree, merkle

LONG = "A paragraph {} of words, long enough to be read as text, and more. It goes on for a while, as articles do."
ONE, TWO, THREE = (LONG.format(x) for x in ("one", "two", "three"))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<html><body><div><div>{ONE}</div><div>{TWO}</div></div></body></html>", [ONE, TWO]),
        (f"<div>{ONE}</div><div>{TWO}</div>", [ONE, TWO]),
        (f"{ONE} {TWO}", [f"{ONE} {TWO}"]),
        (ONE, [ONE]),
        (f"<html><head><title>t</title></head><body>{ONE}<br><br>{TWO}</body></html>", [f"{ONE} {TWO}"]),
        (f"<body><div><a href=/>Home</a> <a href=/b>News</a></div><div><div>{ONE}</div><div>{TWO}</div></div><div>&copy; 2020 Example</div></body>", [ONE, TWO]),
        (f"<table><tr><td><a href=x>Home</a></td><td>{ONE}<p>{TWO}</td></tr></table>", [ONE, TWO]),
        (f"<body><nav><a href=/>Home</a></nav><article><h1>Some title</h1><p>{ONE}</p><p>{TWO}</p><footer>tags: a, b</footer></article><footer>&copy; 2020</footer></body>", ["Some title", ONE, TWO]),
        (f"<body><nav><a href=/>Home</a></nav><article><header><p>By Ann Lee, today</p></header><h1>Some title</h1><p>{ONE}</p><p>{TWO}</p><footer><p>Filed under news, sport.</p></footer></article></body>", ["Some title", ONE, TWO]),
        (f"<body><div id=nav><ul><li><a href=/>Home</a></li></ul></div><div><h1>Title here</h1><p>{ONE}</p><p>{TWO}</p><p>{THREE}</p></div><div class=footer>c</div></body>", ["Title here", ONE, TWO, THREE]),
    ],
)
def test_html_pages_that_mark_little(page, want):
    assert html_tree.extract([page], html_tree.model()) == ["\n".join(want)]


class Blocks(HTMLParser):
    """Text between block tags by the standard library's parser, for pages of plain nesting."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.held, self.hidden = [], "", 0

    def flush(self):
        self.out += [" ".join(self.held.split())] if self.held.split() else []
        self.held = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("title", "style", "script"):
            self.hidden += 1
        elif tag in html_tree.BLOCKS or tag == "head":
            self.flush()
        elif tag == "br":
            self.held += " "

    def handle_endtag(self, tag):
        if tag in ("title", "style", "script"):
            self.hidden -= 1
        elif tag in html_tree.BLOCKS or tag == "head":
            self.flush()

    def handle_data(self, data):
        self.held += "" if self.hidden else data


def test_html_segments_are_those_of_another_parser():
    rng = random.Random(99)
    for _ in range(60):
        page = html_tree.make_page(rng).replace("<button>Go</button>", " ")
        other = Blocks()
        other.feed(page)
        other.flush()
        assert list(html_tree.parse(page).text.values()) == other.out


def mark(text):
    return merkle.tree(text.encode()).fingerprint()


def test_merkle_likeness_of_repeated_short_and_unspaced_texts():
    share = lambda a, b: merkle.compare(mark(a), mark(b))[0]
    words = "word " * 20000
    assert 0.4 < share(words, words[:50000] + "other " * 8000) < 0.6
    assert max(len(p) for p in mark(words)[33:].split(",")) > 100  # many pieces
    short = "one two three four five six seven eight nine ten"
    assert 0.3 < share(short, short[:24] + "z" * 24) < 0.7
    for text in ("x" * 20000, "日本語の文章です。" * 1000):
        assert 0.3 < share(text, text[: len(text) // 2] + "Z" * (len(text) // 2)) < 0.7
        assert share(text, "Q" + text) > 0.8
    rng = random.Random(1)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20000))
    assert share(letters, letters[:7000] + "insertion" + letters[7000:]) > 0.95


def test_merkle_roots_hold_the_exact_text():
    long = "ab" * 40
    texts = ["a b", "a  b", "a b ", " a b", "a\nb", "a\n\nb", "ab", long, long[:40] + " " + long[40:], long + " " + long, long + long, "\xff", "a\x00b", long + "\x00", ""]
    roots = [mark(t)[:32] for t in texts]
    assert len(set(roots)) == len(texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (merkle.compare(mark(a), mark(b))[0] == 1) == (i == j)


def test_merkle_is_below_one_though_leaves_collide(monkeypatch):
    """Leaf digests of one value: everything seems to match, and the roots tell that it doesn't."""
    real = merkle.digest
    monkeypatch.setattr(merkle, "digest", lambda tag, data: b"\0" * 3 + real(tag, data)[3:] if tag == b"leaf" else real(tag, data))
    assert 0 < merkle.compare(mark("a b c d"), mark("a b c e"))[0] < 1


def test_nothing_is_left_behind(spark):
    """No table in the catalog and no cached rows, once a query's result is there."""
    from veilgram.llm import line_dedup, simhash

    sf = "/root/testdata/sf0.001"
    tables, held = {t.name for t in spark.catalog.listTables()}, spark.sparkContext._jsc.getPersistentRDDs().size()
    for query in (line_dedup.query, simhash.query):
        assert query(spark, sf).count() > 0
    assert {t.name for t in spark.catalog.listTables()} == tables
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held


# Rows that the other tests leave out: several without an id, repeated ids, rows repeated whole, extra columns.


def odd(spark):
    texts = ["one two three four five six", "one two three four five six", "seven eight nine ten\neleven twelve", None, "", "one two three four five seven", "a b c d e f g"]
    rows = [(i, t, "x", 7) for i, t in zip([None, None, 3, None, 3, 4, None], texts, strict=True)] + [(4, texts[5], "x", 7)] * 2 + [(None, texts[6], "x", 7)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, fp string, n_chars int").repartition(3)


def test_scores_of_rows_without_ids_and_of_repeated_rows(spark):
    from veilgram.llm import lm_score

    rows, docs = odd(spark)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_unigram, r.score_micro) for r in lm_score.scores(docs).collect())
    one = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_unigram, r.score_micro) for r in lm_score.scores(docs.coalesce(1)).collect())
    assert got == one and len(got) == len(rows)
    # Ids say nothing of a score: with others, each text's is the same.
    named = spark.createDataFrame([(i, t) for i, (_, t, *_) in enumerate(rows)], "doc_id long, text string")
    again = {r.doc_id: (r.n_words, r.n_unigram, r.score_micro) for r in lm_score.scores(named).collect()}
    assert sorted(again.values()) == sorted(x[2:] for x in got)


def test_simhash_of_rows_without_ids_and_of_repeated_ids(spark):
    from veilgram.llm import simhash

    rows, docs = odd(spark)
    got = simhash.components(docs).collect()
    assert len(got) == len(rows)
    named = {i: t for i, (_, t, *_) in enumerate(rows)}
    marks = {r.doc_id: r.fp for r in simhash.components(spark.createDataFrame(list(named.items()), "doc_id long, text string")).collect()}
    assert sorted(r.fp for r in got) == sorted(marks.values())
    by = {}
    for (i, *_), k in zip(rows, named, strict=True):
        by.setdefault(marks[k], []).append(i)
    for r in got:  # these fingerprints are far apart but for equal ones, so a component is a fingerprint
        ids = [i for i in by[r.fp] if i is not None]
        assert r.component_id == (min(ids) if ids else None) or any((r.fp ^ f) & (1 << 64) - 1 and ((r.fp ^ f) & (1 << 64) - 1).bit_count() <= 2 for f in by)


def test_merkle_of_rows_without_ids_and_of_repeated_ids(spark):
    rows, docs = odd(spark)
    got = merkle.compared(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.n_chars) for r in got) == sorted((i is None, i or 0, mark(t or ""), len(t or "")) for i, t, *_ in rows)
    assert sorted(map(str, merkle.compared(docs.coalesce(1)).collect())) == sorted(map(str, got))


def test_html_of_repeated_rows_and_without_ids(spark):
    page = f"<body><nav><a href=/>Home</a></nav><article><p>{ONE}</p></article></body>"
    rows = [(None, "u", page), (None, "u", page), (2, None, page), (2, None, page), (None, None, None)]
    got = [r.text for r in html_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got) == ["", *[ONE] * 4]


def test_chat_of_turns_without_number_and_with_other_columns(spark):
    from veilgram.llm import chat

    rows = [(1, None, "user", "late", "x"), (1, 0, "user", "first", "y"), (1, None, "assistant", "later", "z")]
    frames = [spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string").repartition(n) for n in (1, 3)]
    a, b = (chat.digests(chat.format_chats(f)).first() for f in frames)
    assert a == b and a.n_turns == 3 and a.loss_chars == len("later")

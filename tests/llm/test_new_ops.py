"""Phrases, pieces and time-ordered encoding against brute force, the library whose results they give, and SQL, with odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from oracle import compare, duck
from pyspark.sql import functions as F

from veilgram.llm import phrases, pieces, target_encoding

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("op", [phrases, target_encoding])
def test_queries_equal_their_sql(spark, op):
    assert compare(spark, duck(SF), op.query, op.SQL, SF) > 0


# phrases


def phrase_rows():
    rng = random.Random(4)
    vocab = ["the", "Of", "and", "naïve", "ÄRGER", "x", "a b", "'"]
    text = lambda: "".join(rng.choice(vocab) + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "!\r"]) for _ in range(rng.randint(0, 40)))
    rows = [(i, text(), rng.choice(["en", "de", None])) for i in range(120)]
    return rows + [(None, None, "en"), (1, "", None), (1, " \t ;", "fr"), (2, "only once here", "it"), (3, rows[0][1], rows[0][2]), (4, "the of " * 3000, "en")]


def brute_phrases(rows, least, longest, top, kept):
    counts, n = Counter(), Counter()
    for _, text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(c, "\0")
        for piece in low.split("\0"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    out = {}
    long = [(lg, p, a) for (lg, p), a in counts.items() if len(p) > 1 and a >= least]
    for lang, p, a in long:
        cuts = [(phrases.SCALE * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        if not any(lg == lang and len(q) > len(p) and 100 * b >= kept * a and any(q[i : i + len(p)] == p for i in range(len(q))) for lg, q, b in long):
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize(("least", "bits", "top"), [(2, 512, 2000), (5, 1 << 18, 7), (30, None, 2000)])
def test_phrases_against_brute_force(spark, least, bits, top):
    """512 buckets hold many phrases each: false hits cost counting only."""
    docs = spark.createDataFrame(phrase_rows(), "doc_id long, text string, lang string").withColumns({"rank": F.lit("r"), "n": F.lit(1), "phrase": F.lit("p")}).repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(docs, least, top=top, bits=bits).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute_phrases(phrase_rows(), least, phrases.LONGEST, top, phrases.KEPT)


def test_phrases_flush_and_empty(spark, monkeypatch):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert phrases.collocations(docs.limit(0)).count() == 0
    monkeypatch.setattr(phrases, "HELD", 8)
    monkeypatch.setattr(phrases, "GATHERED", 50)
    sent = [r for b in _counted(rows) for r in b.to_pylist() if r["part"] is None]
    total = Counter()
    for r in sent:
        total[r["lang"], r["phrase"]] += r["n"]
    assert len(sent) > len(total)
    monkeypatch.undo()
    assert total == Counter({(r["lang"], r["phrase"]): r["n"] for b in _counted(rows) for r in b.to_pylist() if r["part"] is None})


def _counted(rows):
    """The first pass over one partition, in this process and in batches of three rows."""
    import pyarrow as pa

    batches = [pa.record_batch([[lang or "und" for _, _, lang in rows[i : i + 3]], [t for _, t, _ in rows[i : i + 3]]], ["lang", "text"]) for i in range(0, len(rows), 3)]
    taken = []

    class Frame:
        class sparkSession:
            class conf:
                set = staticmethod(lambda k, v: None)

        mapInArrow = staticmethod(lambda f, schema: taken.extend(f(iter(batches))))

    phrases.counting_pass(Frame, 1, 512, None, None, False)
    return taken


def test_exact_arithmetic_over_64_bits(spark):
    big = 1 << 60
    schema = "lang string, phrase string, n long"
    one = spark.createDataFrame([("en", "a", big), ("en", "b", big + 3)], schema)
    two = spark.createDataFrame([("en", "a b", big - 7)], schema)
    r = phrases.candidates([one, two]).first()
    assert (r.a, r.l, r.r, r.score) == (big - 7, big, big + 3, 2_000_000 * (big - 7) // (2 * big + 3))


# pieces


def field(n, value):
    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    return varint(n << 3) + varint(value) if isinstance(value, int) else varint(n << 3 | 2) + varint(len(value)) + value


def variant(charmap=b"", dummy=1, squeeze=0, fallback=1):
    """The public model under another normaliser, or without byte pieces."""
    data = pieces.model_bytes(public_tokenizers.path(pieces.MODEL))
    listed = [v for n, v in pieces.fields(data) if n == 1]
    kept = [v for v in listed if fallback or dict(pieces.fields(v)).get(3, 1) != pieces.BYTE]
    spec = field(1, b"x") + field(2, charmap) + field(3, dummy) + field(4, squeeze) + field(5, 1)
    return b"".join(field(1, v) for v in kept) + field(2, dict(pieces.fields(data))[2] + field(35, fallback)) + field(3, spec)


def nfkc():
    norm = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    return dict(pieces.fields(dict(pieces.fields(norm))[3]))[2]


BITS = ["Hello", " ", "  ", "\n", "\t", "ﬁ", "Ａ", "é", "<s>", "<0x41>", "▁", "​", " ", "x́", "　", "日本語の", "ｶﾞ", "①", "…", "x" * 70, "\0", "🙂", "½", " .", "word", "ÄÖ", "😀😀", "­", "㌔", "각", "ㅏ"]


def odd_texts(n=300):
    rng = random.Random(1)
    return ["", " ", "  ", "▁", "a", " a ", "\n", *["".join(rng.choice(BITS) for _ in range(rng.randint(1, 30))) for _ in range(n)]]


@pytest.mark.parametrize("mapped", [False, True])
@pytest.mark.parametrize(("dummy", "squeeze", "fallback"), [(1, 0, 1), (0, 0, 1), (1, 1, 1), (1, 0, 0), (0, 1, 0)])
def test_pieces_are_the_librarys(mapped, dummy, squeeze, fallback):
    proto = variant(nfkc() if mapped else b"", dummy, squeeze, fallback)
    model, lib, texts = pieces.Model(proto), sentencepiece.SentencePieceProcessor(model_proto=proto), odd_texts()
    ids, begins, ends, text_ends = model.encode(texts)
    start = 0
    for t, end in zip(texts, text_ends.tolist(), strict=True):
        own = ids[start:end]
        assert own.tolist() == lib.encode(t, add_bos=True, add_eos=True), t
        spans = [t.encode()[a:b].decode() for a, b in zip(begins[start:end].tolist(), ends[start:end].tolist(), strict=True)]
        assert spans[1:-1] == [p.surface for p in lib.encode(t, return_type="proto").pieces], t
        assert model.decode(own) == lib.decode(own.tolist()), t
        start = end


def test_decoding_any_ids():
    proto = variant()
    model, lib, rng = pieces.Model(proto), sentencepiece.SentencePieceProcessor(model_proto=proto), random.Random(2)
    for _ in range(2000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(259, 32000), model.ids["▁"]]) for _ in range(rng.randint(0, 8))]
        assert model.decode(np.array(ids, np.int64)) == lib.decode(ids), ids


def test_long_stretches_and_forgotten_segments(monkeypatch):
    monkeypatch.setattr(pieces, "HELD", 20)
    proto = variant()
    model, lib = pieces.Model(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    for t in ("ab" * 3000, "日本" * 2000, "x" * 5000, "a,b;" * 1000, *odd_texts(60)):
        ids, *_ = model.encode([t, t])
        assert ids.tolist() == 2 * lib.encode(t, add_bos=True, add_eos=True)


def test_other_models_are_refused():
    data = pieces.model_bytes(public_tokenizers.path(pieces.MODEL))
    with pytest.raises(ValueError):
        pieces.Model(data + field(1, field(1, b"<own>") + field(3, pieces.USER_DEFINED)))


def test_pieces_over_tables(spark):
    path = public_tokenizers.path(pieces.MODEL)
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*odd_texts(80), None, "word " * 40000, "twice", "twice"]
    docs = spark.createDataFrame([(None if i % 50 == 3 else i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(4)
    rows = pieces.decoded(pieces.encoded(docs, path), path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == lib.encode(r.text or "", add_bos=True, add_eos=True) and r.decoded == lib.decode(r.ids)
        assert len(r.begins) == len(r.ends) == len(r.ids) and (not r.text or (r.begins[0], r.ends[-1]) == (0, len(r.text.encode())))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((len(r.ids), sha(np.array(r.ids, "<u4").tobytes()), sha(r.decoded.encode()), sha(np.array(list(zip(r.begins, r.ends, strict=True)), "<u4").tobytes())) for r in rows)
    assert sorted(tuple(r)[1:] for r in pieces.digests(docs, path).collect()) == want
    empty = docs.limit(0)
    assert pieces.digests(empty, path).count() == pieces.encoded(empty, path).count() == 0


def test_pieces_query_is_the_librarys(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.query(spark, SF).collect()}
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())
    for i, t in texts.items():
        ids = lib.encode(t, add_bos=True, add_eos=True)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    assert len(got) == len(texts)


# time-ordered encoding


def shop(spark, empty=False):
    rng = random.Random(7)
    sales = [(i, rng.choice([None, 1, 1, 1, 2, 3, 99]), "s", None if i % 17 == 5 else rng.choice([1000, 1001, 1500, 1_000_000, rng.randint(-5000, 10**7)])) for i in range(80)] + [(None, 1, "s", 5)]
    lines = [(rng.choice([i, i, 7, 200, None]), rng.choice([None, 1, 1, 1, 2, 3, 50]), rng.choice([None, 5, 5, 6, 70]), rng.choice(["returned", "kept", None])) for i in list(range(80)) * 6]
    lines += lines[:20]
    items = [(1, "toys"), (2, None), (3, "tools"), (4, "toys"), (None, "none")]
    vendors, clients = [(5, 1), (6, None)], [(1, "retail"), (2, "retail"), (3, None)]
    keep = (lambda rows: []) if empty else (lambda rows: rows)
    frame = lambda rows, schema: spark.createDataFrame(keep(rows), schema).repartition(3)
    tables = (
        frame(sales, "sale_id long, client_id long, class string, us long").withColumn("sold_at", F.timestamp_micros("us")).withColumn("fold", F.lit("f")),
        frame(lines, "sale_id long, item_id long, vendor_id long, flag string").withColumns({"n": F.lit(9), "us": F.lit(1), "fold": F.lit("x")}),
        frame(items, "item_id long, kind string").withColumn("class", F.lit(1)),
        frame(vendors, "vendor_id long, nation_id int"),
        frame(clients, "client_id long, segment string"),
    )
    return tables, (sales, lines, dict(items), dict(vendors), dict(clients))


def brute_encoding(sales, lines, items, vendors, clients, gap):
    times = {s: (-1 if c is None else c, us, zlib.crc32(str(s).encode()) % 5) for s, c, _, us in sales if s is not None and us is not None}
    rows = [(s, -1 if i is None else i, v, *times[s], flag == "returned") for s, i, v, flag in lines if s in times]
    out = {}
    for s, i, v, c, us, fold, _ in rows:
        def rate(prior, same):
            hist = [r for r in rows if r[5] != fold and r[4] < us - gap and same(r)]  # noqa: B023
            n, back = len(hist), sum(r[6] for r in hist)
            return n, prior if n < 1 else (1_000_000 * back + 50 * prior) // (n + 50)

        base = rate(500_000, lambda r: True)[1]
        got = []
        for at, of, own in ((1, items, i), (2, vendors, v), (3, clients, c)):
            prior = rate(base, lambda r: of.get(r[at]) == of.get(own))[1]  # noqa: B023
            got += rate(prior, lambda r: r[at] == own)  # noqa: B023
        mine = [r for r in rows if r[:3] == (s, i, v)]
        out[s, i, v] = (len(mine), sum(r[6] for r in mine), *got)
    return out


@pytest.mark.parametrize(("gap", "bucket", "fan"), [(0, 6, 4), (499, 8, 3), (700, 4096, 1024)])
def test_target_encoding_against_brute_force(spark, gap, bucket, fan):
    """Small buckets make every key hot and put levels upon levels."""
    tables, raw = shop(spark)
    got = {(r.sale_id, r.item_id, r.vendor_id): tuple(r)[3:] for r in target_encoding.encoded(*tables, gap=gap, bucket_rows=bucket, fan=fan).collect()}
    assert got == brute_encoding(*raw, gap)


def test_target_encoding_of_empty_tables(spark):
    assert target_encoding.encoded(*shop(spark, empty=True)[0]).count() == 0
    full, none = shop(spark)[0], shop(spark, empty=True)[0]
    assert target_encoding.encoded(*full[:2], *none[2:]).count() > 0

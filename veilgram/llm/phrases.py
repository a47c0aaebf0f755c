"""Phrase collocations by hash-pruned counting passes (PCY, DHP) with Apriori pruning.

A-Z are lower-cased; a text is split at SEPARATORS into pieces and those at spaces and tabs into words; a phrase is 2 to LONGEST words
in a row within a piece. All is per lang (null: und). f(phrase) counts occurrences, overlaps included. Candidates have a =
f >= LEAST. Cut after its first k words, with l and r the counts of both parts, a candidate scores floor(SCALE * a / (l + r)); its
lowest cut counts, the smallest k among equals. A candidate that lies within a longer one of at least KEPT percent of its count goes.

Plan: pass k reads the documents and counts phrases of k words exactly, but only those whose two parts of k - 1 words are
frequent (Apriori) and whose bucket holds LEAST at least; in the same pass phrases of k + 1 words are counted by bucket. Both tests
read bitmaps of M bits, which are what is broadcast: M follows the input's bytes up to MOST_BITS (8 MB), whatever the input.
A bitmap's false hits only cost counting: counts are exact, by the words themselves, and LEAST is asked of them in the end. A task
sends its bucket counts as bytes, each at most LEAST (sums from LEAST on are told apart just as well), and its phrases added up; so
a phrase that very many documents hold is a row a task. Parts are joined to their counts; nothing else reaches the driver but
bitmaps. The best of a language are found by row numbers in hashed groups first, whose best meet in fewer groups, then in one:
no group holds more than TOP rows of each before it.

A word's number within a task is exact (a dictionary); 64-bit hashes are for buckets alone. What a task holds is bounded: after
HELD different phrases or words it sends what it has added up.

Defined cases: null, empty and wordless texts hold nothing; null doc_ids and repeated rows count as rows of their own; ties end
with the phrase, in byte order; a language without candidates has no rows; empty tables give none; other columns are not read."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgram.llm import common

SEPARATORS, LEAST, LONGEST, SCALE, KEPT, TOP, NO_LANG = b".,;:!?\n\x0b\x0c\r", 30, 4, 2_000_000, 80, 2000, "und"
#: Bits of a bitmap: a power of two from the first to the second, with BYTES_A_BIT of text for each; parts that sum bucket counts.
LEAST_BITS, MOST_BITS, BYTES_A_BIT, PARTS = 1 << 18, 1 << 26, 64, 64
#: Different words or phrases that a task holds before it sends them, and occurrences that it gathers before it adds them up.
HELD, GATHERED = 1 << 20, 1 << 21
U = np.uint64
#: Marks the end of a piece among the words: no byte of UTF-8.
END = b"\xff"
PLAIN = bytes(END[0] if c in SEPARATORS else c + 32 if 65 <= c <= 90 else 32 if c == 9 else c for c in range(256))
ROWS = "size int, lang string, phrase string, n long, part int, data binary"


def words_of(texts: list[bytes]) -> list[bytes]:
    """Words of all texts with END between pieces."""
    joined = END.join(texts).translate(PLAIN).replace(END, b" \xff ")
    # split() also parts at bytes that are separators here, of which none is left
    return joined.split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    return x ^ (x >> U(29))


def longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one word more."""
    return mixed(hashes * U(0xD6E8FEB86659FD93) + words)


def seed_of(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def phrase_hash(lang: str, phrase: str) -> int:
    h = None
    with np.errstate(over="ignore"):
        for w in phrase.encode().split(b" "):
            x = np.array([xxhash.xxh3_64_intdigest(w) ^ seed_of(lang)], U)
            h = x if h is None else longer(h, x)
    return int(h[0])


class Bitmap:
    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, U(64 - (8 * len(bits)).bit_length() + 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.bits[at >> U(3)] >> (U(7) - (at & U(7))).astype(np.uint8)) & 1 == 1


class Words(dict):
    """Numbers of words, from 1 in the order met; 0 is END. hashes[i] and texts[i] belong to number i."""

    def __init__(self, lang: str):
        super().__init__({END: 0})
        self.lang, self.seed, self.texts, self.hashes = lang, seed_of(lang), [END], np.zeros(1024, U)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.texts)
        self.texts.append(word)
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(n, U)])
        self.hashes[n] = xxhash.xxh3_64_intdigest(word) ^ self.seed
        return n


class Counter:
    """Phrases of `size` words of one language and task: rows of word numbers, added up now and then."""

    def __init__(self, words: Words, size: int):
        self.words, self.size = words, size
        self.begin()

    def begin(self) -> None:
        self.rows, self.counts, self.gathered = [np.zeros((0, self.size), np.int64)], [np.zeros(0, np.int64)], 0

    def add(self, rows: np.ndarray) -> None:
        self.rows.append(rows)
        self.counts.append(np.ones(len(rows), np.int64))
        self.gathered += len(rows)
        if self.gathered >= GATHERED:
            self.add_up()

    def add_up(self) -> int:
        rows, counts = np.concatenate(self.rows), np.concatenate(self.counts)
        code = rows[:, 0]
        for k in range(1, self.size):  # exact: the number of a shorter phrase among those here, and a word's
            code = np.unique(code, return_inverse=True)[1] if k > 1 else code
            code = code << 32 | rows[:, k]
        _, first, same = np.unique(code, return_index=True, return_inverse=True)
        self.rows, self.counts, self.gathered = [rows[first]], [np.bincount(same, counts, len(first)).astype(np.int64)], 0
        return len(first)

    def sent(self) -> Iterator[pa.RecordBatch]:
        self.add_up()
        rows, counts = self.rows[0], self.counts[0]
        for a in range(0, len(rows), 1 << 14):
            some, texts = rows[a : a + (1 << 14)].tolist(), self.words.texts
            yield out(self.size, self.words.lang, [b" ".join([texts[i] for i in r]) for r in some], counts[a : a + (1 << 14)])
        self.begin()


def out(size: int, lang: str | None, phrases: list[bytes], counts: np.ndarray, parts: list[int] | None = None, data: list[bytes] | None = None) -> pa.RecordBatch:
    n = len(phrases) if data is None else len(data)
    columns = [pa.array([size] * n, pa.int32()), pa.array([lang] * n, pa.string()), pa.array(phrases if data is None else [None] * n, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(parts or [None] * n, pa.int32()), pa.array(data or [None] * n, pa.binary())]
    return pa.record_batch(columns, ["size", "lang", "phrase", "n", "part", "data"])


def counting_pass(docs: DataFrame, size: int, bits: int, frequent, buckets, last: bool, least: int = LEAST) -> DataFrame:
    """docs (lang, text): exact counts of the phrases of `size` words that pass (size 1: of all words), and, unless last, bucket
    counts of those with one word more. frequent, buckets: broadcast bitmaps, for sizes from 2."""
    shift, part = U(65 - bits.bit_length()), bits // PARTS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, tuple[Words, Counter]] = {}
        held = np.zeros(0 if last else bits, np.uint8)
        shorter, here = (Bitmap(np.frombuffer(b.value, np.uint8)) if b else None for b in (frequent, buckets))
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), common.raw(batch.column(1)), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                words, counter = langs.get(lang) or langs.setdefault(lang, (w := Words(lang), Counter(w, size)))
                tokens = words_of(own)
                ids = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
                one = words.hashes[ids]
                if size == 1:
                    at, h = np.flatnonzero(ids), one
                    counter.add(ids[at, None])
                    ok = ids != 0
                    begin = np.flatnonzero(ok[:-1] & ok[1:])
                    h = h[begin]
                else:
                    begin, h = passing(ids, one, size, shorter, here)
                    counter.add(np.stack([ids[begin + k] for k in range(size)], axis=1))
                    # one word more: both parts of `size` words have to pass
                    follows = np.flatnonzero(np.diff(begin, append=-1) == 1)
                    begin, h = begin[follows], h[follows]
                if not last:
                    found = np.bincount((longer(h, one[begin + size]) >> shift).astype(np.int64), minlength=bits) if len(begin) * 8 > bits else None
                    if found is None:
                        at, n = np.unique(longer(h, one[begin + size]) >> shift, return_counts=True)
                        at = at.astype(np.int64)
                        held[at] = np.minimum(held[at] + np.minimum(n, least), least)
                    else:
                        held = np.minimum(held + np.minimum(found, least), least).astype(np.uint8)
                if len(words) > HELD or (counter.gathered == 0 and len(counter.rows[0]) > HELD):
                    yield from counter.sent()
                    del langs[lang]
        for _, counter in langs.values():
            yield from counter.sent()
        if held.any():
            yield out(size + 1, None, [], np.zeros(PARTS, np.int64), list(range(PARTS)), [zstandard.compress(held[p * part : (p + 1) * part].tobytes(), 1) for p in range(PARTS)])

    return common.in_arrow(docs, work, ROWS)


def passing(ids: np.ndarray, one: np.ndarray, size: int, shorter: Bitmap, here: Bitmap) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings of phrases of `size` words that both tests let through, and their hashes."""
    h, ok = one, ids != 0
    for k in range(1, size - 1):  # hashes of the parts of size - 1 words
        h, ok = longer(h[:-1], one[k:]), ok[:-1] & (ids[k:] != 0)
    begin = np.flatnonzero(ok)
    inside = np.zeros(len(ok), bool)
    inside[begin[shorter.holds(h[begin])]] = True
    begin = np.flatnonzero(inside[:-1] & inside[1:])
    h = longer(h[begin], one[begin + size - 1])
    left = here.holds(h)
    return begin[left], h[left]


def bucket_bitmap(rows: DataFrame, bits: int, least: int = LEAST) -> bytes:
    """The bits whose buckets hold least: tasks sum the counts of a part of the buckets each; a bit a bucket comes to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zstandard.decompress(data), np.uint8)
                held[p] = np.minimum(held[p] + got, least) if p in held else got.copy()
        if held:
            yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([np.packbits(x >= least).tobytes() for x in held.values()], pa.binary())], ["part", "bits"])

    found = common.in_arrow(rows.filter("part IS NOT NULL").select("part", "data").repartition(PARTS, "part"), work, "part int, bits binary").collect()
    return joined(found, bits)


def phrase_bitmap(frequent: DataFrame, bits: int) -> bytes:
    """The bits of the frequent phrases."""
    shift, part = 65 - bits.bit_length(), bits // PARTS

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.array([phrase_hash(x, p) >> shift for x, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], np.int64))
            owner = at // part
            edge = np.searchsorted(owner, np.arange(PARTS + 1))
            full = np.flatnonzero(np.diff(edge)).tolist()
            yield pa.record_batch([pa.array(full, pa.int32()), pa.array([(at[edge[p] : edge[p + 1]] - p * part).astype("<i4").tobytes() for p in full], pa.binary())], ["part", "data"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(p, np.zeros(part, bool))[np.frombuffer(data, "<i4")] = True
        if held:
            yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], ["part", "bits"])

    found = common.in_arrow(common.in_arrow(frequent.select("lang", "phrase"), hashed, "part int, data binary").repartition(PARTS, "part"), work, "part int, bits binary").collect()
    return joined(found, bits)


def joined(found: list, bits: int) -> bytes:
    parts = {r["part"]: bytes(r["bits"]) for r in found}
    empty = bytes(bits // PARTS // 8)
    return b"".join(parts.get(p, empty) for p in range(PARTS))


def bitmap_bits(n_bytes: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, n_bytes // BYTES_A_BIT).bit_length()))


def frequent_phrases(docs: DataFrame, scratch: common.Scratch, least: int = LEAST, longest: int = LONGEST, bits: int | None = None) -> tuple[list[DataFrame], DataFrame]:
    """By size the tables (lang, phrase, n) of phrases with n >= least, and (lang, n) of all words."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    bits = bits or bitmap_bits(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"])
    found, totals, sent = [], None, (None, None)
    for size in range(1, longest + 1):
        rows = scratch.store("pass", counting_pass(docs, size, bits, *sent, last=size == longest, least=least))
        counts = rows.filter("part IS NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        if size == 1:
            totals = scratch.store("totals", rows.filter("part IS NULL").groupBy("lang").agg(F.sum("n").alias("n")))
        found.append(scratch.store(f"size-{size}", counts.filter(F.col("n") >= least)))
        if size < longest:
            sent = (sc.broadcast(phrase_bitmap(found[-1], bits)), sc.broadcast(bucket_bitmap(rows, bits, least)))
    scratch.drop("pass")
    return found, totals


def first_words(k) -> F.Column:
    return F.substring_index("phrase", " ", k)


def candidates(found: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, l, r, score of each candidate."""
    longest, out = len(found), None
    for size in range(2, longest + 1):
        best = found[size - 1].withColumnRenamed("n", "a")
        for k in range(1, size):
            left = found[k - 1].select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
            right = found[size - k - 1].select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
            cut = best.withColumns({"first": first_words(k), "rest": first_words(k - size)})
            cut = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
            exact = F.lit(SCALE).cast("decimal(10,0)") * F.col("a").cast("decimal(20,0)")
            score = F.call_function("div", exact, F.col("l").cast("decimal(20,0)") + F.col("r")).cast("long")
            at = F.struct(score.alias("score"), F.lit(k).alias("k"), "l", "r")
            best = cut.withColumn("cut", F.least("cut", at) if k > 1 else at).drop("first", "rest", "l", "r")
        out = best if out is None else out.unionByName(best)
    return out.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def within_longer(found: list[DataFrame], kept: int = KEPT) -> DataFrame:
    """(lang, phrase) that lie within a longer candidate of at least kept percent of their count."""
    inside = []
    for size in range(3, len(found) + 1):
        for part in range(2, size):
            for a in range(size - part + 1):
                middle = F.substring_index(F.substring_index("phrase", " ", a + part), " ", -part)
                inside.append(found[size - 1].select("lang", middle.alias("phrase"), F.col("n").alias("more")))
    if not inside:
        return found[0].select("lang", "phrase").limit(0)
    most = reduce(DataFrame.unionByName, inside).groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    own = reduce(DataFrame.unionByName, found[1:-1])
    decimal = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by)
    return own.join(most, ["lang", "phrase"]).filter(decimal("more", 100) >= decimal("n", kept)).select("lang", "phrase")


def ranked(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` rows of each lang with their rank."""
    n = common.partitions(rows.sparkSession)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for groups in dict.fromkeys((n, math.isqrt(n), 1)):
        part = ["lang", F.pmod(F.xxhash64("phrase"), F.lit(n)) % groups] if groups > 1 else ["lang"]
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col("rank") <= top)
    return rows


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, kept: int = KEPT, bits: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    scratch = common.Scratch(docs.sparkSession, "phrases")
    found, totals = frequent_phrases(docs, scratch, least, longest, bits)
    best = ranked(candidates(found).join(within_longer(found, kept), ["lang", "phrase"], "left_anti"), top)
    out = best.join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    gram = lambda k: " UNION ALL ".join(f"SELECT lang, {size}::INT AS size, array_to_string(ws[i:i+{size - 1}], ' ') AS phrase FROM (SELECT lang, ws, unnest(range(1, len(ws) - {size} + 2)) AS i FROM pieces WHERE len(ws) >= {size})" for size in range(1, k + 1))
    return f"""
WITH pieces AS MATERIALIZED (SELECT lang, ws FROM (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM (
  SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)) WHERE len(ws) > 0),
n AS (SELECT lang, sum(len(ws)) AS n FROM pieces GROUP BY lang),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*)::HUGEINT AS c FROM ({gram(LONGEST)}) GROUP BY lang, size, phrase HAVING count(*) >= {LEAST}),
cand AS MATERIALIZED (SELECT lang, size, phrase, c AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
cuts AS (SELECT lang, size, phrase, a, k, array_to_string(ws[1:k], ' ') AS p, array_to_string(ws[k+1:size], ' ') AS q FROM (SELECT *, unnest(range(1, size)) AS k FROM cand)),
s AS (SELECT x.lang, x.phrase, x.a, x.k, p.c AS l, q.c AS r, {SCALE} * x.a // (p.c + q.c) AS score FROM cuts x JOIN f p ON p.lang = x.lang AND p.phrase = x.p AND p.size = x.k JOIN f q ON q.lang = x.lang AND q.phrase = x.q AND q.size = x.size - x.k),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (SELECT lang, a, array_to_string(ws[i:i+w-1], ' ') AS phrase FROM (SELECT lang, a, ws, w, unnest(range(1, size - w + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS w FROM cand WHERE size > 2))),
most AS (SELECT lang, phrase, max(a) AS more FROM parts GROUP BY lang, phrase),
kept AS (SELECT b.* FROM best b LEFT JOIN most m ON m.lang = b.lang AND m.phrase = b.phrase WHERE m.more IS NULL OR 100 * m.more < {KEPT} * b.a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= {TOP}"""


SQL = _sql()

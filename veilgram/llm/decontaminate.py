"""Benchmark decontamination: the CGK random walk maps edit distance to Hamming distance; repeated bit sampling of its
output finds candidate places, and an exact edit distance verifies them.

Texts are sequences of words (A-Z lowered, ASCII punctuation as white space), each a 64-bit hash. A match of an item of L
words is a part of a document at up to k = LIMIT * L word insertions, deletions and replacements.

The walk of a window reads the word under its pointer and, by a random bit of (repetition, step, word), moves on or reads it
again; two sequences that differ by edits fall back into step, so their outputs agree at most steps. Windows begin
at every word of every document and of every item, so they cover items whole wherever the edits lie. A repetition samples some
steps of the walk (always the first and the last), and a document's window that agrees with an item's at all of them is a
candidate for that item at that offset.

Recall: k edits leave q = L // (k + 1) words in a row unchanged somewhere. A walk of 2q - 1 steps that stays within them finds
the match whatever surrounds them; an item's window counts only if its walk stays in the item and its samples see q // 2 + 1
different places of it at least, so that keys are selective. The chance of both is counted over all walks and samples, and
repetitions are as many as bring the chance of missing the worst case, a match with one such run alone, to 1 - RECALL.
Other runs, and walks that edits don't put out of step, only add to that.

A hit gives the item's place to within k words. Hits of one item at about the same place are verified once, on a stretch
that holds whatever match any of them belongs to: the smallest number of edits that turn the item into some part of the
stretch, against the limit. So each distance is the smallest in the document.

Items are sent to tasks in portions of at most MAX_BYTES, one pass and one set of written hits each; more items mean
further passes, not a larger broadcast.

Defined cases: null and wordless texts and items match nothing; equal (doc_id, item_id) pairs are one row, the best; a
null doc_id is kept as such; empty tables give no rows; very long texts are searched whole; start_word is the first word of
a part at the smallest distance; clean() keeps columns of any name."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from functools import cached_property
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgram.llm import common

LIMIT, RECALL, QMAX, SEED = 0.2, 0.9999, 8, 5
MAX_BYTES = 2 << 20
PLAIN = bytes.maketrans(string.ascii_uppercase.encode() + string.punctuation.encode(), string.ascii_lowercase.encode() + b" " * len(string.punctuation))
U = np.uint64


def words(text: bytes) -> np.ndarray:
    w = text.translate(PLAIN).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))


def run(n: int, limit: float) -> int:
    """Words in a row that the edits within the limit leave unchanged somewhere in an item of n words."""
    return min(QMAX, n // (int(limit * n) + 1))


def samplings(q: int) -> list[tuple[int, ...]]:
    """All choices of sampled steps: the first, the last and half of those between."""
    inner = range(1, 2 * q - 2)
    return [tuple(sorted({0, 2 * q - 2, *c})) for c in combinations(inner, (len(inner) + 1) // 2)]


def repetitions(q: int) -> int:
    good = n = 0
    for bits in product((0, 1), repeat=2 * q - 2):
        at = np.concatenate([[0], np.cumsum(bits)])
        for steps in samplings(q):
            good, n = good + (at[-1] < q and len(set(at[list(steps)])) > q // 2), n + 1
    return 1 if good == n else math.ceil(math.log(1 - RECALL) / math.log(1 - good / n))


def mixed(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    key = (key ^ word) * U(0x9E3779B97F4A7C15)
    return key ^ (key >> U(29))


def moved(word: np.ndarray, turn: np.uint64) -> np.ndarray:
    """1 where a walk that reads the word moves on."""
    return ((word * turn) >> U(63)).astype(np.int8)


def sieve_of(keys: np.ndarray) -> np.ndarray:
    """A flag for each beginning of a key, of some sixteen times as many as there are keys."""
    out = np.zeros(1 << max(16, (16 * len(keys)).bit_length()), bool)
    out[at_sieve(keys, out)] = True
    return out


def at_sieve(keys: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    return keys >> U(65 - len(sieve).bit_length())


#: Samples after which a document's window is dropped if no item's begins so; windows that are walked at a time, in cache.
EARLY, BLOCK = 3, 1 << 14


class Walk:
    """One repetition for items of runs of q words: its sampled steps, and a multiplier a step whose top bit moves on."""

    def __init__(self, q: int, r: int):
        choices = samplings(q)
        self.steps = choices[xxhash.xxh3_64_intdigest(f"{SEED}|{q}|{r}") % len(choices)]
        self.early = self.steps[min(EARLY, len(self.steps)) - 1]
        self.turns = np.array([xxhash.xxh3_64_intdigest(f"{SEED}|{q}|{r}|{i}") | 1 for i in range(2 * q - 2)], U)

    def keys(self, tokens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows at the first n tokens: key, that of the first EARLY samples, last place read, different places
        sampled. tokens go on beyond n."""
        at, key, last, seen = np.arange(n), np.zeros(n, U), np.full(n, -1), np.zeros(n, np.int8)
        for step in range(self.steps[-1] + 1):
            if step in self.steps:
                key = mixed(key, tokens[at])
                seen += at != last
                last = at.copy()
                if step == self.early:
                    first = key
            if step < self.steps[-1]:
                at = at + moved(tokens[at], self.turns[step])
        return key, first, at, seen

    def sieved(self, tokens: np.ndarray, n: int, early: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows whose keys the sieves let through, and the keys. Most end after the first EARLY samples."""
        begin = at = np.arange(n)
        key = np.zeros(n, U)
        for step in range(self.steps[-1] + 1):
            if step in self.steps:
                key = mixed(key, tokens[at])
                if step == self.early:
                    left = np.flatnonzero(early[at_sieve(key, early)])
                    begin, at, key = begin[left], at[left], key[left]
            if step < self.steps[-1]:
                at = at + (moved(tokens, self.turns[step])[at] if len(at) == n else moved(tokens[at], self.turns[step]))
        left = np.flatnonzero(sieve[at_sieve(key, sieve)])
        return begin[left], key[left]


class Items:
    """The items of one portion, ready to look windows up in. Tables are built where they are used."""

    def __init__(self, ids: list[int], texts: list[bytes], limit: float = LIMIT):
        both = [(i, w) for i, t in zip(ids, texts, strict=True) if len(w := words(t))]
        self.ids, self.words, self.limit = [i for i, _ in both], [w for _, w in both], limit
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.run = np.array([run(n, limit) for n in self.size.tolist()], np.int64)
        self.repeat = {q: repetitions(q) for q in np.unique(self.run).tolist()}

    @cached_property
    def tables(self) -> list[tuple[Walk, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        out = []
        for q, repeat in self.repeat.items():
            which = np.flatnonzero(self.run == q)
            size = self.size[which]
            ends = np.cumsum(size)
            flat = np.concatenate([*[self.words[i] for i in which.tolist()], np.zeros(2 * q, U)])
            item, offset = np.repeat(which, size), np.arange(ends[-1]) - np.repeat(ends - size, size)
            for r in range(repeat):
                walk = Walk(q, r)
                key, first, at, seen = walk.keys(flat, int(ends[-1]))
                good = np.flatnonzero((at < np.repeat(ends, size)) & (seen > q // 2))
                good = good[np.argsort(key[good], kind="stable")]
                out.append((walk, sieve_of(first[good]), sieve_of(key[good]), key[good], item[good].astype(np.int32), offset[good].astype(np.int32)))
        return out

    def candidates(self, tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, block) without repeats: the item may begin about the block of k + 1 words, counted from the
        document's first. ends: of each document."""
        got = [np.zeros((3, 0), np.int64)]
        padded = np.concatenate([tokens, np.zeros(2 * QMAX, U)])
        for walk, early, sieve, keys, items, offsets in self.tables:
            parts = [walk.sieved(padded[a : a + BLOCK + 2 * QMAX], min(BLOCK, len(tokens) - a), early, sieve) for a in range(0, len(tokens), BLOCK)]
            at = np.concatenate([np.zeros(0, np.int64), *[p[0] + k * BLOCK for k, p in enumerate(parts)]])
            key = np.concatenate([np.zeros(0, U), *[p[1] for p in parts]])
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            k = hi - lo
            rep = np.repeat(np.arange(len(k)), k)
            row = lo[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(k) - k, k)
            doc = np.searchsorted(ends, at[rep], "right")
            begin = at[rep] - np.concatenate([[0], ends])[doc] - offsets[row]
            item = items[row].astype(np.int64)
            got.append(np.unique(np.stack([doc, item, begin // (self.edits(item) + 1)]), axis=1))
        return tuple(np.unique(np.concatenate(got, axis=1), axis=1))

    def edits(self, item: np.ndarray) -> np.ndarray:
        return (self.limit * self.size[item]).astype(np.int64)


def distances(items: list[np.ndarray], stretches: list[np.ndarray]) -> np.ndarray:
    """Smallest edit distance of each item to any part of its stretch: one row of the table at a time, all pairs at once."""
    n, most, wide = len(items), max(map(len, items)), max(map(len, stretches))
    a, b = np.zeros((n, most), U), np.full((n, wide), 1, U)
    for k, (x, y) in enumerate(zip(items, stretches, strict=True)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    size = np.array([len(x) for x in items])
    col = np.arange(wide + 1, dtype=np.int32)
    row, out = np.zeros((n, wide + 1), np.int32), np.zeros(n, np.int64)
    for i in range(1, most + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = np.minimum(row[:, :-1] + (b != a[:, i - 1 : i]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - col, axis=1) + col
        done = size == i
        out[done] = row[done].min(1)
    return out


def edit_row(item: np.ndarray, stretch: np.ndarray, anywhere: bool) -> np.ndarray:
    """Edit distances of the item to the parts of the stretch that end at each place and begin anywhere, or at its start."""
    col = np.arange(len(stretch) + 1)
    row = np.zeros_like(col) if anywhere else col
    for i, w in enumerate(item, 1):
        new = np.concatenate([[i], np.minimum(row[:-1] + (stretch != w), row[1:] + 1)])
        row = np.minimum.accumulate(new - col) + col
    return row


def first_word(item: np.ndarray, stretch: np.ndarray) -> int:
    """Where the first of the nearest parts begins."""
    end = int(edit_row(item, stretch, True).argmin())
    return end - int(edit_row(item[::-1], stretch[:end][::-1], False).argmin())


def matches(items: Items, docs: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """(document, item, distance, first word) of the best match of each pair."""
    if not items.ids or not docs:
        return []
    doc, item, block = items.candidates(np.concatenate(docs), np.cumsum([len(d) for d in docs]))
    order = np.argsort(items.size[item], kind="stable")  # little padding
    doc, item, block = doc[order], item[order], block[order]
    k = items.edits(item)
    lo, hi = np.maximum(0, block * (k + 1) - k), block * (k + 1) + 2 * k + items.size[item]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for a in range(0, len(doc), 1000):
        part = list(zip(doc[a : a + 1000].tolist(), item[a : a + 1000].tolist(), lo[a : a + 1000].tolist(), hi[a : a + 1000].tolist(), strict=True))
        dist = distances([items.words[i] for _, i, _, _ in part], [docs[d][x:y] for d, _, x, y in part])
        for (d, i, x, y), n, most in zip(part, dist.tolist(), k[a : a + 1000].tolist(), strict=True):
            if n <= most:
                best[d, i] = min(best.get((d, i), (n, x, y)), (n, x, y))
    return [(d, i, n, x + first_word(items.words[i], docs[d][x:y])) for (d, i), (n, x, y) in sorted(best.items())]


def portions(benchmark: DataFrame, max_bytes: int = MAX_BYTES, limit: float = LIMIT) -> Iterator[Items]:
    rows = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    n = max(1, math.ceil(1.5 * total / max_bytes)) if total > max_bytes else 1
    for p in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == p).orderBy("item_id", "text").collect()  # about max_bytes
        yield Items([r["item_id"] for r in part], [r["text"].encode() for r in part], limit)


def hits(docs: DataFrame, benchmark: DataFrame, limit: float = LIMIT) -> DataFrame:
    """doc_id, item_id, distance, n_words, start_word, similarity of each contaminated document and item."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, distance long, n_words long, start_word long"

    def searched(items: Items) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_pylist()
                found = matches(items, [words(t) for t in common.raw(b.column(1))])
                rows = [(ids[d], items.ids[k], dist, len(items.words[k]), at) for d, k, dist, at in found]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "distance", "n_words", "start_word"])

        return common.in_arrow(slim, work, schema)

    spark = docs.sparkSession
    at = common.fresh_folder(spark, "decontaminate")
    for items in portions(benchmark, limit=limit):
        searched(items).write.mode("append").parquet(at)
    found = spark.read.schema(schema).parquet(at)
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "start_word", "n_words")).alias("m"))
    return best.select("doc_id", "item_id", "m.distance", "m.n_words", "m.start_word", (F.lit(1.0) - F.col("m.distance") / F.col("m.n_words")).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; each row without doc_id is judged on its own text."""
    own = common.unused(docs, "_own")
    bad = hits(docs.select(common.ident(docs).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(own)).distinct()
    return docs.withColumn(own, common.ident(docs)).join(bad, own, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

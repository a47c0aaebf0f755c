"""SimHash near-duplicates through Golay-code fuzzy hashing.

Fingerprint: words are split at ASCII white space after lowering A-Z, shingles of n words (repeats included; fewer
words: the whole sequence) are hashed by XXH64 with seed 42, and a bit is 1 if set in over half of the hashes. No words:
all bits zero.

Candidates: the 64 bits are three segments (23, 23 and 18 bits). If two fingerprints differ in 2 bits at most, then in one
of the pairs (first, second), (second, third), (third, first) the one segment is equal and the other differs in one
bit at most. The other segment is decoded to nearby codewords of the binary Golay code (23, 12): a word within 2 of its
codeword gives that one's index, a word at 3 also the indices of the five codewords at 4. Words one bit apart
always share an index. So each fingerprint has up to 18 keys (pair, equal segment, codeword index).

Verification: members of a key are compared by exact bit count. Keys of over PAIRS members are linked without
pairs: a member meets the others at hubs, itself and its 64 one-bit neighbours; two members share a hub just if they
differ in 2 bits at most, and a hub has 65 members at most.

Defined cases: null text has no words; documents of equal fingerprint are one node; null doc_id counts as largest; other columns
are not read; an empty table gives no rows; a fingerprint of a very large group of documents is one row until the last join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgram.llm import common
from veilgram.llm.components import stars

SEED, WORDS, PAIRS = 42, 3, 32
#: First bit and length of the segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the Golay code.
GOLAY = 0b101011100011


def shingle_hashes(text: bytes, n: int = WORDS) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(words) - n + 1)
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[s:e], SEED) for s, e in zip(starts[:k].tolist(), ends[-k:].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bytes are counted in blocks of 128 rows, whose sums fit a byte."""
    n = len(hashes)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    whole = n // 128 * 128
    count = bits[:whole].reshape(-1, 128, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(shingle_hashes(t, n)) for t in common.raw(b.column(1))], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return common.in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, fp long")


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word modulo the generator."""
    out = np.zeros(len(words), np.int64)
    for bit in range(23):
        r = 1 << bit
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= GOLAY << (k - 11)
        out ^= np.where(words >> bit & 1, r, 0)
    return out


def decoding() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error patterns to the nearest codeword, and to the five next ones if that is at 3 (else zeros)."""
    near, more = np.zeros(2048, np.int64), [[] for _ in range(2048)]
    for w in (1, 2, 3, 4):
        patterns = np.array([sum(1 << i for i in c) for c in combinations(range(23), w)], np.int64)
        for p, s in zip(patterns.tolist(), syndromes(patterns).tolist(), strict=True):
            if w < 4:
                near[s] = p
            else:
                more[s].append(p)
    return near, np.array([(m + [0] * 5)[:5] for m in more], np.int64)


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) of all keys of the fingerprints (uint64)."""
    near, more = decoding()
    seg = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for f in range(3):
        equal, fuzzy = seg[f], seg[(f + 1) % 3]
        s = syndromes(fuzzy)
        head = (f << 35) | (equal << 12)
        rows.append(np.arange(len(fps)))
        keys.append(head | (fuzzy ^ near[s]) >> 11)
        for k in range(5):
            some = np.flatnonzero(more[s, k])
            rows.append(some)
            keys.append(head[some] | (fuzzy[some] ^ more[s[some], k]) >> 11)
    return np.concatenate(rows), np.concatenate(keys)


def keyed(nodes: DataFrame) -> DataFrame:
    """fp -> key, fp."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            row, key = golay_keys(fps)
            yield pa.record_batch([pa.array(key), pa.array(fps[row].view(np.int64))], ["key", "fp"])

    return common.in_arrow(nodes.select("fp"), work, "key long, fp long")


def links(nodes: DataFrame) -> DataFrame:
    """a, b: fingerprints at 2 or fewer differing bits that connect all such."""
    scratch = common.Scratch(nodes.sparkSession, "simhash-links")
    keys = scratch.hold("keys", keyed(nodes))
    size = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = scratch.hold("shared", keys.join(size, "key"))
    scratch.drop("keys")
    few = shared.filter(F.col("n") <= PAIRS)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").filter((F.col("a") < F.col("b")) & near).select("a", "b")
    out = scratch.put("links", pairs.unionByName(hub_links(shared.filter(F.col("n") > PAIRS).select("fp").distinct())))
    scratch.drop("shared")
    return out


def hub_links(many: DataFrame) -> DataFrame:
    one_bit: Column = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    hubs = many.select("fp", F.explode(one_bit).alias("hub")).groupBy("hub").agg(F.collect_set("fp").alias("members"))
    return hubs.filter(F.size("members") > 1).select(F.array_min("members").alias("a"), F.explode("members").alias("b")).filter("a <> b")


def components(docs: DataFrame, n: int = WORDS, scratch: common.Scratch | None = None) -> DataFrame:
    """doc_id, fp, component_id of each row."""
    scratch = scratch or common.Scratch(docs.sparkSession, "simhash")
    marks = scratch.put("marks", fingerprints(docs, n))
    order = F.coalesce("doc_id", F.lit(common.LAST))
    nodes = scratch.put("nodes", marks.groupBy("fp").agg(F.min(order).alias("least")))
    star = stars(links(nodes))
    head = nodes.join(star.withColumnsRenamed({"b": "fp", "a": "head"}), "fp", "left").select("fp", F.coalesce("head", "fp").alias("head"), "least")
    least = head.groupBy("head").agg(F.min("least").alias("component_id"))
    out = marks.join(head.join(least, "head").select("fp", "component_id"), "fp")
    return out.select("doc_id", "fp", F.when(F.col("component_id") < common.LAST, F.col("component_id")).alias("component_id"))


def linked(docs: DataFrame, scratch: common.Scratch) -> DataFrame:
    """a, b: each document that isn't its component's first, with that one."""
    own = common.Scratch(docs.sparkSession, "simhash")
    rest = components(docs, scratch=own).filter("component_id <> doc_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    out = scratch.put("fingerprints", rest.distinct())
    own.drop("marks", "nodes")
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

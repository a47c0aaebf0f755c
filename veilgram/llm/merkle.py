"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of paragraphs.

A paragraph is a line. It is cut into pieces of words at content-defined places: where the checksum of the last two words is a
multiple of PIECE, LEAST words on at least and MOST at most; words of over LONG bytes are taken as several, of up to MOST_BYTES
each, cut after certain bytes. Paragraphs are cut into sections after a blank line or one whose digest is a multiple of
SECTION. So an edit moves no cut but those beside it, a short text has some pieces, and no piece is large, whatever
the text repeats. Every node's digest covers its children's, the root's thus the
exact text: roots test equality, and walking down differing branches locates edits.

A fingerprint is the tree: the root in hex, a colon, and the sections, split by |, of paragraphs, split by commas, of leaf
digests (3 bytes each, base64). Two fingerprints are compared from the root down: equal roots are likeness 1 and the
walk ends; else sections are matched in order (equal ones at both ends, then the longest run of others in the same
order), and only what lies between matched ones is entered, first its paragraphs, then their leaves. Likeness is twice the
matched nodes (paragraphs and leaves) over all of both, below 1 for unequal texts; paragraphs without a match are the edits.

Defined cases: null text is empty, with no nodes; two empty texts are alike, an empty and another one are not; rows
follow each other by (doc_id, text), those without doc_id last, by hash of their text; a single document is its own next
one; an empty table gives no rows; one task holds two whole texts at a time; other columns are not read."""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgram.llm import common

PIECE, LEAST, MOST, SECTION = 3, 2, 16, 8
LONG, MOST_BYTES = 48, 64
#: Parts of a long word: up to a byte that is 5 modulo 8, or MOST_BYTES.
PARTS = re.compile(b"(?s).{3,%d}?[%s]|.{1,%d}" % (MOST_BYTES - 1, b"".join(re.escape(bytes([c])) for c in range(5, 256, 8)), MOST_BYTES))


def digest(tag: bytes, data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16, person=tag).digest()


@dataclass
class Tree:
    """sections: a (digest, paragraphs) each; paragraphs: a (digest, leaf digests) each."""

    root: bytes
    sections: list[tuple[bytes, list[tuple[bytes, list[bytes]]]]]

    def fingerprint(self) -> str:
        marks = [",".join(base64.b64encode(b"".join(leaf[:3] for leaf in leaves)).decode() for _, leaves in s) for _, s in self.sections]
        return f"{self.root.hex()}:{'|'.join(marks)}"


def in_parts(word: bytes) -> list[bytes]:
    """Those but the last end with a byte that no text has, so that parts and words are told apart."""
    parts = PARTS.findall(word)
    return [*[p + b"\xff" for p in parts[:-1]], parts[-1]]


def paragraph(line: bytes) -> tuple[bytes, list[bytes]]:
    """Digests of a line and of its pieces."""
    words = line.split(b" ")
    if len(line) > LONG and max(map(len, words)) > LONG:
        words = [x for w in words for x in (in_parts(w) if len(w) > LONG else [w])]
    leaves, at, last = [], 0, 0
    for i, v in enumerate(map(crc32, words), 1):
        if i - at >= LEAST and (v + 3 * last) % PIECE == 0 or i - at >= MOST:
            leaves.append(digest(b"leaf", b" ".join(words[at:i])))
            at = i
        last = v
    if at < len(words) and line:
        leaves.append(digest(b"leaf", b" ".join(words[at:])))
    return digest(b"paragraph", b"".join(leaves)), leaves


def tree(text: bytes) -> Tree:
    sections, held = [], []
    for line in text.split(b"\n") if text else []:
        held.append(paragraph(line))
        if not line or held[-1][0][0] % SECTION == 0:
            sections.append(held)
            held = []
    if held:
        sections.append(held)
    nodes = [(digest(b"section", b"".join(p for p, _ in s)), s) for s in sections]
    return Tree(digest(b"root", b"".join(d for d, _ in nodes)), nodes)


def in_order(xs: list[str], ys: list[str]) -> list[tuple[int, int]]:
    """Places of equal elements in the same order: at both ends, and between them the longest such run, where the k-th
    occurrence of an element matches the k-th of the other side."""
    n, m, low = len(xs), len(ys), 0
    while low < min(n, m) and xs[low] == ys[low]:
        low += 1
    high = 0
    while high < min(n, m) - low and xs[n - 1 - high] == ys[m - 1 - high]:
        high += 1
    seen, where = Counter(), {}
    for j in range(low, m - high):
        where[ys[j], seen[ys[j]]] = j
        seen[ys[j]] += 1
    seen, tails, runs = Counter(), [], []  # runs: the last (i, j, run before) of the best run of each length
    for i in range(low, n - high):
        j = where.get((xs[i], seen[xs[i]]))
        seen[xs[i]] += 1
        if j is not None:
            k = bisect_left(tails, j)
            run = i, j, runs[k - 1] if k else None
            if k == len(tails):
                tails.append(j)
                runs.append(run)
            else:
                tails[k], runs[k] = j, run
    middle, run = [], runs[-1] if runs else None
    while run:
        middle.append(run[:2])
        run = run[2]
    return [(k, k) for k in range(low)] + middle[::-1] + [(n - k, m - k) for k in range(high, 0, -1)]


def gaps(pairs: list[tuple[int, int]], n: int, m: int) -> Iterator[tuple[int, int, int, int]]:
    """What lies between matched places: from and to on either side."""
    i = j = 0
    for x, y in [*pairs, (n, m)]:
        if x > i or y > j:
            yield i, x, j, y
        i, j = x + 1, y + 1


def size(section: str) -> int:
    """Paragraphs and leaves."""
    commas = section.count(",")
    return commas + 1 + (len(section) - commas) // 4


def walk(a: str, b: str) -> tuple[int, list[int], list[int]]:
    """Nodes that match of two fingerprints' trees, and the numbers of the paragraphs of either that don't."""
    xs, ys = (t.split("|") if t else [] for t in (a.partition(":")[2], b.partition(":")[2]))
    at_x, at_y = ([0, *accumulate(s.count(",") + 1 for s in z)] for z in (xs, ys))
    pairs = in_order(xs, ys)
    shared, rest_x, rest_y = sum(size(xs[i]) for i, _ in pairs), [], []
    for i0, i1, j0, j1 in gaps(pairs, len(xs), len(ys)):
        ps, qs = ([p for s in z for p in s.split(",")] for z in (xs[i0:i1], ys[j0:j1]))
        inner = in_order(ps, qs)
        shared += sum(1 + len(ps[k]) // 4 for k, _ in inner)
        for k0, k1, l0, l1 in gaps(inner, len(ps), len(qs)):
            u, v = "".join(ps[k0:k1]), "".join(qs[l0:l1])
            if u and v:
                shared += len(in_order([u[k : k + 4] for k in range(0, len(u), 4)], [v[k : k + 4] for k in range(0, len(v), 4)]))
            rest_x += range(at_x[i0] + k0, at_x[i0] + k1)
            rest_y += range(at_y[j0] + l0, at_y[j0] + l1)
    return shared, rest_x, rest_y


def compare(a: str, b: str) -> tuple[float, list[int], list[int]]:
    """Likeness of two fingerprints, and the numbers of the paragraphs of either under differing branches."""
    if a[:32] == b[:32]:
        return 1.0, [], []
    nodes = sum(sum(map(size, t[33:].split("|"))) if len(t) > 33 else 0 for t in (a, b))
    shared, rest_a, rest_b = walk(a, b)
    return min(2.0 * shared / nodes, 1 - 1 / (nodes + 1)), rest_a, rest_b  # leaf digests are short, so all may seem to match


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of each row: a narrow map."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = common.raw(b.column(1))
            marks = [tree(t).fingerprint() for t in texts]
            yield pa.record_batch([b.column(0), pa.array([len(t.decode()) for t in texts], pa.int64()), pa.array(marks, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return common.in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, n_chars long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, kind, doc_id, text) such that within a part each document of kind 0 is followed by its next one.
    Texts are shuffled once, to ranges of doc_id; the first document of each range (one a range, found by ids) is
    repeated at the end of the range before as kind 1, that of the first range at the very end."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.ident(docs).alias("_order"), F.coalesce("text", F.lit("")).alias("text"))
    n = common.partitions(docs.sparkSession)
    cuts = common.id_cuts(rows.select("_order"), "_order", 4 * n)
    part = common.range_number(F.col("_order"), cuts)
    first = {r["part"]: r["o"] for r in rows.select(part.alias("part"), "_order").groupBy("part").agg(F.min("_order").alias("o")).collect()}  # a row a range
    if not first:
        return rows.select(F.lit(0).alias("part"), F.lit(0).alias("kind"), "doc_id", "text")
    ends = sorted(first)
    before = {p: ends[i - 1] for i, p in enumerate(ends)}
    spark = docs.sparkSession
    heads = spark.createDataFrame([(first[p], before[p]) for p in ends], "_order long, part int")
    tails = rows.join(F.broadcast(heads), "_order").groupBy("part").agg(F.min("text").alias("text"))
    full = rows.select(part.alias("part"), F.lit(0).alias("kind"), "doc_id", "_order", "text").unionByName(
        tails.select("part", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(common.LAST).alias("_order"), "text")
    )
    return full.repartition(n, "part").sortWithinPartitions("part", "kind", "_order", "text").select("part", "kind", "doc_id", "text")


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next, edited_paragraphs (of the
    edited text, under differing branches) of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # part, doc_id, text, fingerprint of the document whose next one is to come
        for b in batches:
            out = []
            for part, kind, ident, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                own = tree(text.encode()).fingerprint()
                if held and held[0] == part:
                    _, i, t, mark = held
                    half = len(t) // 2
                    edited = t[: len(t) - half] + text[:half]
                    new = tree(edited.encode()).fingerprint()
                    alike, _, rest = compare(mark, new)
                    out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), mark, new, alike, compare(mark, own)[0], len(rest)))
                held = (part, ident, text, own) if kind == 0 else None
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            cols = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], NAMES)

    return common.in_arrow(with_next(docs), work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_paragraphs long")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_paragraphs"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark.read.parquet(f"{sf_dir}/documents.parquet"))

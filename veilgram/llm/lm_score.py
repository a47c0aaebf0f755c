"""Stupid-backoff scores of every document under the n-gram counts of all other documents.

Words are split at ASCII white space after lowering A-Z. With f the count of an n-gram over all documents but the scored
row (its own occurrences are no evidence for it; leave_out=False counts them too), a word w after u, v scores
f(uvw) / f(uv) if f(uvw) > 0; else ALPHA times f(vw) / f(v) if f(vw) > 0; else ALPHA again times f(w) / N, N the number of
words; a word found nowhere else counts as one. Orders that reach before the document's first word are left out without
a factor. Logarithms of counts are whole millionths, so that sums are the same for any partitioning.

Plan: documents are exploded to n-gram hashes (64 bits) in chunks of whole documents; a chunk's different n-grams with their
counts, sorted and delta-coded, go to the partitions of their hash range, which are the count tables. A partition
sums the counts by hash, joins the sums back to the n-grams of each chunk and returns them to the chunk in their
order (those of 2 and more: the rest are 1). There they are joined to the exploded n-grams and summed per
document. Nothing is collected; what moves grows with the input, and an n-gram that very many documents hold is one
entry a chunk. A chunk has CHUNK bytes and a hash range the n-grams of BUCKET bytes of text, or the square root of 128
times the input's bytes if that is more (113 MB at 100 TB): so one chunk has some hundred n-grams in each range.

The documents are read twice, by the same deterministic scan, which a task on another executor repeats; if the n-grams of the
two readings differ (by their number or the sum of their hashes), the task fails rather than return wrong scores (write a
nondeterministic input to a table first).

Defined cases: null or wordless text has no words, score 0 and a null mean; null doc_ids and repeated rows are rows of
their own; an empty table gives no rows; a chunk holds one whole document at least, however long; other columns are not
read."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgram.llm import common

ORDER, ALPHA, CHUNK, BUCKET = 3, 0.4, 8 << 20, 4 << 20
U = np.uint64


def micro(counts: np.ndarray) -> np.ndarray:
    """Logarithm in millionths of each count."""
    return np.rint(np.log(counts) * 1e6).astype(np.int64)


PENALTY = int(micro(np.array([ALPHA]))[0])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Words of each text; by order the hashes of the n-grams that end at each word; the word's number in its text."""
    words, sizes = [], []
    for t in texts:
        w = t.lower().split()
        words.append(np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w)))
        sizes.append(len(w))
    size = np.array(sizes, np.int64)
    token = np.concatenate(words) if words else np.zeros(0, U)
    place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
    out = [mixed(token + U(1))]
    for k in range(2, order + 1):
        g = np.zeros_like(token)
        g[1:] = mixed(out[-1][:-1] * U(0x9E3779B97F4A7C15) + token[1:] + U(k))
        out.append(g)
    return size, out, place


def listed(by_order: list[np.ndarray], place: np.ndarray) -> np.ndarray:
    """All n-grams that lie within their document."""
    return np.concatenate([g[place >= k] for k, g in enumerate(by_order)])


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, so that small numbers compress to their own bytes."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def packed(sorted_hashes: np.ndarray, counts: np.ndarray) -> bytes:
    delta = np.diff(sorted_hashes, prepend=U(0))
    return zstandard.compress(planes(delta) + planes(counts), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(data)
    return np.cumsum(unplaned(raw[: len(raw) // 2]), dtype=np.uint64), unplaned(raw[len(raw) // 2 :]).astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.Table]]:
    """(number, doc_id and text) of successive chunks of a partition. The partition's number is a column of the
    rows, as a task of a union has another number than the scan's partition it reads."""
    number, held, total = None, [], 0
    for b in batches:
        if number is None and b.num_rows:
            number = b.column(2)[0].as_py() << 32
        held.append(b.select([0, 1]))
        total += b.nbytes
        if total >= size:
            yield number, pa.Table.from_batches(held)
            number, held, total = number + 1, [], 0
    if number is not None and held:
        yield number, pa.Table.from_batches(held)


ROWS = "chunk long, bucket int, data binary"


def row(chunk: int, buckets: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([chunk] * len(data), pa.int64()), pa.array(buckets, pa.int32()), pa.array(data, pa.binary())], ["chunk", "bucket", "data"])


def exploded(docs: DataFrame, buckets: int, order: int, size: int) -> DataFrame:
    """A row for each chunk and bucket: the chunk's n-grams of that hash range with their counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in chunks(batches, size):
            _, by_order, place = grams(common.raw(rows["text"].combine_chunks()), order)
            u, c = np.unique(listed(by_order, place), return_counts=True)
            bucket = ((u >> U(32)) * U(buckets)) >> U(32)
            edge = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(edge))
            for a in range(0, len(full), 64):
                some = full[a : a + 64].tolist()
                yield row(chunk, some, [packed(u[edge[b] : edge[b + 1]], c[edge[b] : edge[b + 1]]) for b in some])

    return common.in_arrow(docs, work, ROWS)


def counted(blocks: DataFrame) -> DataFrame:
    """Per bucket: sums by hash, joined back to each chunk's n-grams of the bucket: a bit for each that occurs twice at
    least, and those sums."""

    def totals(bucket: int, held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = [unpacked(d) for _, d in held]
        hashes, counts = np.concatenate([h for h, _ in parts]), np.concatenate([c for _, c in parts])
        order = np.argsort(hashes, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(hashes[order]) != 0]))
        total = np.empty_like(counts)
        total[order] = np.repeat(np.add.reduceat(counts[order], first), np.diff(np.concatenate([first, [len(order)]])))
        at = 0
        for (chunk, _), (h, _) in zip(held, parts, strict=True):
            t = total[at : at + len(h)]
            at += len(h)
            more = t > 1
            head = np.array([len(h), h.sum(dtype=np.uint64)], "<u8").tobytes()
            yield row(chunk, [bucket], [head + zstandard.compress(np.packbits(more).tobytes() + planes(t[more]), 1)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for chunk, bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if bucket != now and held:
                    yield from totals(now, held)
                    held = []
                now = bucket
                held.append((chunk, data))
        if held:
            yield from totals(now, held)

    return common.in_arrow(blocks, work, ROWS)


def texts_by_chunk(docs: DataFrame, size: int) -> DataFrame:
    """The documents of each chunk as one compressed row, bucket -1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in chunks(batches, size):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows)
            yield row(chunk, [-1], [sink.getvalue().to_pybytes()])

    return common.in_arrow(docs, work, ROWS)


def returned(data: list[bytes]) -> tuple[np.ndarray, int]:
    """Counts of a chunk's n-grams in hash order, and the sum of their hashes."""
    out, check = [np.zeros(0, np.int64)], 0
    for d in data:
        (n, part), raw = np.frombuffer(d[:16], "<u8").tolist(), zstandard.decompress(d[16:])
        bits = -(-n // 8)
        more = np.unpackbits(np.frombuffer(raw[:bits], np.uint8), count=n).astype(bool)
        t = np.ones(n, np.int64)
        t[more] = unplaned(raw[bits:]).astype(np.int64)
        out.append(t)
        check = (check + part) % (1 << 64)
    return np.concatenate(out), check


def scored_chunk(texts: list[bytes], counts: np.ndarray, check: int, order: int, leave_out: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, sum of millionths without the words' number N, and how often N is divided by, of each text."""
    size, by_order, place = grams(texts, order)
    u, inverse = np.unique(listed(by_order, place), return_inverse=True)
    if (len(u), int(u.sum(dtype=np.uint64))) != (len(counts), check):
        raise RuntimeError(f"the input changed between two readings: {len(u)} n-grams, {len(counts)} counts")
    doc = np.repeat(np.arange(len(size)), size)
    f, at = [], 0
    for k in range(order):
        left, inside = np.zeros(len(place), np.int64), np.flatnonzero(place >= k)
        gram = inverse[at : at + len(inside)]
        at += len(inside)
        left[inside] = counts[gram]
        if leave_out:
            _, same, own = np.unique(gram * len(size) + doc[inside], return_inverse=True, return_counts=True)
            left[inside] -= own[same]
        f.append(left)
    value, open_, uni = np.zeros(len(place), np.int64), np.ones(len(place), bool), np.zeros(len(place), np.int64)
    for k in range(order - 1, 0, -1):
        inside = place >= k
        seen = open_ & inside & (f[k] > 0)
        i = np.flatnonzero(seen)
        value[i] += micro(f[k][i]) - micro(f[k - 1][i - 1])
        open_ &= ~seen
        value[open_ & inside] += PENALTY
    i = np.flatnonzero(open_)
    value[i] += micro(np.maximum(f[0][i], 1))
    uni[i] = 1
    ends = np.concatenate([[0], np.cumsum(size)])
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
    return size, total(value), total(uni)


def scores(docs: DataFrame, order: int = ORDER, leave_out: bool = True, chunk: int | None = None) -> DataFrame:
    """doc_id, n_words, n_unigram (words scored by their own count), score_micro, mean_log of each row."""
    spark, n = docs.sparkSession, common.partitions(docs.sparkSession)
    held = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    least = math.isqrt(128 * held)
    chunk, buckets = chunk or max(CHUNK, least), max(n, -(-held // max(BUCKET, least)))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("part"))
    blocks = exploded(docs, buckets, order, chunk).repartition(n, "bucket").sortWithinPartitions("bucket", "chunk")
    both = counted(blocks).unionByName(texts_by_chunk(docs, chunk)).repartition(n, "chunk").sortWithinPartitions("chunk", "bucket")

    def flush(rows: list[bytes]) -> pa.RecordBatch:
        table = pa.ipc.open_stream(rows[0]).read_all()
        size, value, uni = scored_chunk(common.raw(table["text"].combine_chunks()), *returned(rows[1:]), order, leave_out)
        return pa.record_batch([table["doc_id"].combine_chunks(), pa.array(size), pa.array(uni), pa.array(value)], ["doc_id", "n_words", "n_unigram", "value"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for c, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if c != now and rows:
                    yield flush(rows)
                    rows = []
                now = c
                rows.append(data)
        if rows:
            yield flush(rows)

    parts = common.Scratch(spark, "lm-score").put("parts", common.in_arrow(both, work, "doc_id long, n_words long, n_unigram long, value long"))
    total = parts.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("_n"))  # one row
    others = F.col("_n") - (F.col("n_words") if leave_out else F.lit(0))
    n_log = F.round(F.log(F.greatest(others, F.lit(1))) * 1e6).cast("long")
    score = F.col("value") - F.col("n_unigram") * n_log
    out = parts.crossJoin(F.broadcast(total)).select("doc_id", "n_words", "n_unigram", score.alias("score_micro"))
    return out.withColumn("mean_log", F.when(F.col("n_words") > 0, F.col("score_micro") / F.lit(1e6) / F.col("n_words")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH s AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
t AS MATERIALIZED (SELECT doc_id, w, lag(w) OVER d AS v, lag(w, 2) OVER d AS u FROM (SELECT doc_id, unnest(l) AS w, unnest(range(0, len(l))) AS i FROM s) WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
o1 AS MATERIALIZED (SELECT doc_id, w, count(*) AS c, sum(count(*)) OVER (PARTITION BY w) - count(*) AS f FROM t GROUP BY doc_id, w),
o2 AS MATERIALIZED (SELECT doc_id, v, w, sum(count(*)) OVER (PARTITION BY v, w) - count(*) AS f FROM t WHERE v IS NOT NULL GROUP BY doc_id, v, w),
o3 AS MATERIALIZED (SELECT doc_id, u, v, w, sum(count(*)) OVER (PARTITION BY u, v, w) - count(*) AS f FROM t WHERE u IS NOT NULL GROUP BY doc_id, u, v, w),
n AS (SELECT doc_id, sum(c) AS own, sum(sum(c)) OVER () - sum(c) AS rest FROM o1 GROUP BY doc_id),
x AS (SELECT t.doc_id, t.u, t.v, a.f AS f1, b.f AS f2, o3.f AS f3, h2.f AS g2, h1.f AS g1, rest FROM t JOIN n ON n.doc_id = t.doc_id JOIN o1 a ON a.doc_id = t.doc_id AND a.w = t.w
  LEFT JOIN o2 b ON b.doc_id = t.doc_id AND b.v = t.v AND b.w = t.w LEFT JOIN o3 ON o3.doc_id = t.doc_id AND o3.u = t.u AND o3.v = t.v AND o3.w = t.w
  LEFT JOIN o2 h2 ON h2.doc_id = t.doc_id AND h2.v = t.u AND h2.w = t.v LEFT JOIN o1 h1 ON h1.doc_id = t.doc_id AND h1.w = t.v),
y AS (SELECT doc_id, coalesce(f3, 0) = 0 AND coalesce(f2, 0) = 0 AS uni,
  CASE WHEN f3 > 0 THEN round(1e6 * ln(f3)) - round(1e6 * ln(g2)) WHEN f2 > 0 THEN (CASE WHEN u IS NULL THEN 0 ELSE {PENALTY} END) + round(1e6 * ln(f2)) - round(1e6 * ln(g1))
  ELSE (CASE WHEN u IS NULL THEN 0 ELSE {PENALTY} END) + (CASE WHEN v IS NULL THEN 0 ELSE {PENALTY} END) + round(1e6 * ln(greatest(f1, 1))) - round(1e6 * ln(greatest(rest, 1))) END AS m FROM x),
z AS (SELECT doc_id, count(*) AS n, count(*) FILTER (uni) AS k, CAST(sum(CAST(m AS BIGINT)) AS BIGINT) AS m FROM y GROUP BY doc_id)
SELECT s.doc_id, coalesce(n, 0) AS n_words, coalesce(k, 0) AS n_unigram, coalesce(m, 0) AS score_micro, CAST(m AS DOUBLE) / 1e6::DOUBLE / n AS mean_log FROM s LEFT JOIN z ON z.doc_id = s.doc_id
"""

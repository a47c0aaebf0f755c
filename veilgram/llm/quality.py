"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded (WIDTH dimensions each, learned), FILTERS learned filters of SPAN bytes pass over them at a stride of
STRIDE, and their responses are max-pooled over chunks of two blocks of BLOCK bytes that overlap by one block and
together cover the whole document. A document's features are the largest and the mean chunk value of each filter; a
small hidden layer joins them into one probability.

The network is fitted on the driver on at most MAX_ROWS labelled rows (half of each class, chosen by hash of doc_id), whole
texts of MAX_BYTES together at most, none over LONGEST: these bounds are the only sample in it. Rows whose crc32(doc_id as text) mod 3 is HELD_OUT are never fitted on.
Scoring is a narrow map over all rows with the fitted weights (some kB) in the closure.

Defined cases: null text is empty; an empty text is one block of zero bytes and gets a score like any other; null
labels are left out, repeated labels of a document count as their largest; with labels of one class or none every
score is 0.5, predicted 1; an empty table gives no rows; very long texts are scored whole, PIECE blocks at a time; other
columns, of any name, are kept by scored(), but for score and predicted."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgram.llm import common

WIDTH, SPAN, STRIDE, FILTERS, BLOCK, HIDDEN = 8, 8, 2, 32, 512, 16
MAX_ROWS, EPOCHS, BATCH, RATE, SEED, HELD_OUT = 2000, 10, 32, 0.01, 17, 1
MAX_BYTES, LONGEST = 64 << 20, 1 << 20
#: Blocks convolved at a time.
PIECE = 1024


@dataclass
class Net:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


def fresh(seed: int = SEED) -> Net:
    rng = np.random.default_rng(seed)
    g = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    z = lambda n: np.zeros(n, np.float32)
    return Net(g(256, WIDTH, scale=0.5), g(SPAN * WIDTH, FILTERS, scale=0.15), z(FILTERS), g(2 * FILTERS, HIDDEN, scale=0.15), z(HIDDEN), g(HIDDEN, 1, scale=0.3), z(1))


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each padded by at least SPAN zero bytes to whole blocks; first block of each."""
    sizes = np.array([(len(t) + SPAN + BLOCK - 1) // BLOCK for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    data = np.zeros(int(sizes.sum()) * BLOCK + SPAN, np.uint8)
    for t, f in zip(texts, first.tolist(), strict=True):
        data[f * BLOCK : f * BLOCK + len(t)] = np.frombuffer(t, np.uint8)
    return data, first


def last_blocks(first: np.ndarray, data: np.ndarray) -> np.ndarray:
    return np.append(first[1:], (len(data) - SPAN) // BLOCK) - 1


def block_max(net: Net, data: np.ndarray, where: bool = False, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Largest response of each filter among the windows that begin in each block, and the place of its window.
    Windows of one phase are a reshaped view of the embedded bytes, so each phase is one matrix product. Windows
    that go on beyond a text's last block are left out (of the text they have its padding only), so that no text's value
    depends on the next one."""
    last = np.zeros(0, np.int64) if last is None else last
    n = (len(data) - SPAN) // BLOCK
    best = np.empty((n, FILTERS), np.float32)
    place = np.empty((n, FILTERS), np.int64) if where else None
    for a in range(0, n, PIECE):
        b = min(n, a + PIECE)
        x = net.embed[data[a * BLOCK : b * BLOCK + SPAN]].ravel()
        top = at = None
        for phase in range(0, SPAN, STRIDE):
            view = x[phase * WIDTH : phase * WIDTH + (b - a) * BLOCK * WIDTH].reshape(-1, SPAN * WIDTH)
            y = (view @ net.filters).reshape(b - a, BLOCK // SPAN, FILTERS)
            if phase:
                y[last[(last >= a) & (last < b)] - a, -1] = -np.inf
            if where:
                i = y.argmax(1)
                m, i = np.take_along_axis(y, i[:, None], 1)[:, 0], i * SPAN + phase
                at = i if top is None else np.where(m > top, i, at)
            else:
                m = y.max(1)
            top = m if top is None else np.maximum(top, m)
        best[a:b] = top
        if where:
            place[a:b] = at + np.arange(a, b)[:, None] * BLOCK
    return best, place


def _chunks(best: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk c is the larger of blocks c and c + 1 of its document (its last chunk: the block alone)."""
    after = np.vstack([best[1:], best[-1:]])
    after[np.concatenate([first[1:], [len(best)]]) - 1] = -np.inf
    second = after > best
    return np.where(second, after, best), second


def features(net: Net, chunks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    act = np.maximum(chunks + net.bias, 0)
    count = np.diff(np.concatenate([first, [len(chunks)]]))[:, None]
    return np.concatenate([np.maximum.reduceat(act, first), np.add.reduceat(act, first) / count], 1), act, count


def head(net: Net, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.maximum(f @ net.hidden + net.hidden_bias, 0)
    return 1 / (1 + np.exp(-np.clip((h @ net.out + net.out_bias)[:, 0], -30, 30))), h


def scores(net: Net | None, texts: list[bytes]) -> np.ndarray:
    if net is None or not texts:
        return np.full(len(texts), 0.5)
    data, first = laid_out(texts)
    chunks, _ = _chunks(block_max(net, data, last=last_blocks(first, data))[0], first)
    return head(net, features(net, chunks, first)[0])[0].astype(np.float64)


def gradients(net: Net, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy. A pooled value passes its gradient to the one window it came from."""
    data, first = laid_out(texts)
    best, place = block_max(net, data, True, last_blocks(first, data))
    chunks, second = _chunks(best, first)
    f, act, count = features(net, chunks, first)
    p, h = head(net, f)
    d = ((p - y) / len(y)).astype(np.float32)[:, None]
    dh = (d @ net.out.T) * (h > 0)
    df = dh @ net.hidden.T
    doc = np.repeat(np.arange(len(texts)), count[:, 0])
    top = act == f[doc, :FILTERS]
    top = top / np.maximum(np.add.reduceat(top, first, dtype=np.float32), 1)[doc]
    da = (df[doc, :FILTERS] * top + df[doc, FILTERS:] / count[doc]) * (act > 0)
    src = np.where(second, np.roll(place, -1, 0), place)
    row, col = np.nonzero(da)
    g, at = da[row, col].astype(np.float32), src[row, col]
    windows = data[at[:, None] + np.arange(SPAN)]
    x = net.embed[windows].reshape(len(at), -1) * g[:, None]
    order = np.argsort(col, kind="stable")
    filters = np.zeros_like(net.filters)
    if len(col):
        cols, begin = np.unique(col[order], return_index=True)
        filters[:, cols] = np.add.reduceat(x[order], begin).T
    embed = np.zeros_like(net.embed)
    np.add.at(embed, windows.ravel(), (net.filters.T[col] * g[:, None]).reshape(-1, WIDTH))
    return [embed, filters, da.sum(0), f.T @ dh, dh.sum(0), h.T @ d, d.sum(0)]


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Net | None:
    """Adam over shuffled batches; None without both classes."""
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return None
    net, rng = fresh(seed), np.random.default_rng(seed)
    m, v, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    total = epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            pick, step = order[a : a + BATCH], step + 1
            rate = RATE * (1 - step / (total + 1))
            for p, g, mi, vi in zip(net.parts(), gradients(net, [texts[i] for i in pick], y[pick]), m, v, strict=True):
                g = g.reshape(p.shape)
                mi += 0.1 * (g - mi)
                vi += 0.01 * (g * g - vi)
                p -= rate * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.99**step)) + 1e-7)
    return net


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 3 == HELD_OUT, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Net | None:
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality")).filter(~held_out(F.col("doc_id")))
    known = known.withColumn("h", F.xxhash64("doc_id"))
    half = [known.filter(F.col("quality") == q).orderBy("h", "doc_id").limit(max_rows // 2) for q in (0, 1)]
    sample = F.broadcast(half[0].unionByName(half[1]).select("doc_id", "quality", "h"))  # max_rows rows at most
    short = docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST)
    found = short.join(sample, "doc_id").groupBy("doc_id", "quality", "h").agg(F.max("text").alias("text"))
    so_far = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.partitionBy("quality").orderBy("h", "doc_id"))  # of max_rows rows
    rows = found.withColumn("bytes", so_far).filter(F.col("bytes") <= max_bytes // 2).orderBy("doc_id").collect()
    return fit([(r["text"] or "").encode() for r in rows], [r["quality"] for r in rows])


def scored(docs: DataFrame, net: Net | None) -> DataFrame:
    """docs with score and predicted; columns of those names are replaced."""
    cols = [c for c in docs.columns if c not in ("score", "predicted")]
    at = cols.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scores(net, common.raw(b.column(at)))
            yield pa.record_batch([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*cols, "score", "predicted"])

    slim = docs.select(*cols)
    kinds = ", ".join(f"`{c}` {t}" for c, t in slim.dtypes)
    return common.in_arrow(slim, work, f"{kinds}, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

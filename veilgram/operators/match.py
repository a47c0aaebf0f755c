"""Best match of each probe among base and own subset, and the outcome.

Probes: type, probe_id, words, n1. Candidates: type, cand_id, words, n1: the subsets' own records, and the base either once under
its own code (sides_once(), for clean() and the products) or once for each subset type (sides()). Filters are packed words; a
column pos of sorted positions serves as well.
Results: type, probe_id, best, ties, hit, outcome."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgram.config import BASE_TYPE
from veilgram.functions import similarity as sim
from veilgram.operators.encode import filter_of, n_words
from veilgram.operators.harden import counter_noise, word_matrix
from veilgram.plans.lineage import cut

#: Bytes of probes that a pass over the candidates holds in every task; more probes mean more passes. A probe has its words, and about
#: PROBE_BYTES for its id, its place and what was found.
MAX_PROBE_BYTES, PROBE_BYTES = 64 << 20, 400
#: Probes and candidates of a block of the product: small enough that blocks of unlike set-bit counts can be passed over.
PROBES, CANDS = 128, 1024


def sides_once(typed: DataFrame, bfs: DataFrame, base_type: str = BASE_TYPE) -> tuple[DataFrame, DataFrame]:
    """Probes and candidates from (type, rec_id) rows and encoded records; each base record is one row."""
    full = typed.join(bfs, "rec_id")
    return full.filter(F.col("type") != base_type).withColumnRenamed("rec_id", "probe_id"), full.withColumnRenamed("rec_id", "cand_id")


def sides(typed: DataFrame, bfs: DataFrame, base_type: str = BASE_TYPE) -> tuple[DataFrame, DataFrame]:
    """The same with the base once for each subset type, for noise that is computed row by row."""
    full = typed.join(bfs, "rec_id")
    own = full.filter(F.col("type") != base_type)
    spark = typed.sparkSession
    present = [r["type"] for r in typed.filter(F.col("type") != base_type).select("type").distinct().collect()]  # a closed list of codes
    kinds = F.broadcast(spark.createDataFrame([(t,) for t in present], "type string"))
    base = full.filter(F.col("type") == base_type).drop("type").crossJoin(kinds)
    cands = own.unionByName(base).withColumnRenamed("rec_id", "cand_id")
    return own.withColumnRenamed("rec_id", "probe_id"), cands


def outcome(ties: Column, hit: Column) -> Column:
    one, right = ties == 1, hit == 1
    return F.when(one & right, "1-1-correct").when(one, "1-1-wrong").when(right, "1-n-correct").otherwise("1-n-wrong")


def clean(probes: DataFrame, cands: DataFrame) -> DataFrame:
    """Without noise a probe's own filter is a candidate, so the best Dice is 1 and the tied records are
    those with equal filters: an equality join on pre-counted filters instead of a product."""
    key = "words" if "words" in cands.columns else "pos"  # packed, a key is n_words longs
    own = cands.groupBy("type", key).agg(F.count("*").alias("own"))
    base = cands.filter(F.col("type") == BASE_TYPE).groupBy(key).agg(F.count("*").alias("base"))
    out = probes.select("type", "probe_id", key).join(own, ["type", key]).join(base, key, "left")
    out = out.withColumn("ties", F.col("own") + F.coalesce("base", F.lit(0)))
    return out.select("type", "probe_id", F.lit(1.0).alias("best"), "ties", F.lit(1).alias("hit")).withColumn("outcome", outcome(F.col("ties"), F.col("hit")))


def _best(pairs: DataFrame) -> DataFrame:
    """Maximum, ties at it and own-id flag by partial aggregation: first the count for each similarity value
    within a probe, then the largest value's row."""
    per = pairs.groupBy("type", "probe_id", "sim").agg(F.count("*").alias("ties"), F.max((F.col("cand_id") == F.col("probe_id")).cast("int")).alias("hit"))
    top = per.groupBy("type", "probe_id").agg(F.max(F.struct("sim", "ties", "hit")).alias("m"))
    return top.select("type", "probe_id", F.col("m.sim").alias("best"), "m.ties", "m.hit").withColumn("outcome", outcome(F.col("ties"), F.col("hit")))


def pairs(probes: DataFrame, cands: DataFrame, bf_len: int) -> DataFrame:
    """Dice of every probe with every candidate of its type, by unrolled word counts in generated code."""
    n = n_words(bf_len)
    p = probes.select("type", "probe_id", filter_of(probes, bf_len).alias("pw"), F.col("n1").alias("pn"))
    c = cands.select("type", "cand_id", filter_of(cands, bf_len).alias("cw"), F.col("n1").alias("cn"))
    both = F.col("pn") + F.col("cn")
    s = F.when(both == 0, 0.0).otherwise(F.lit(2.0) * sim.bits_and(F.col("pw"), F.col("cw"), n) / F.when(both > 0, both))
    return c.join(p, "type").select("type", "probe_id", "cand_id", s.alias("sim"))


Noise = tuple[str, float, int]  # method, probability, seed


class Probes:
    """The probes of one type by number of set bits, as every task holds them."""

    def __init__(self, code: str, ids: np.ndarray, words: np.ndarray, bf_len: int):
        n1 = np.bitwise_count(words).sum(1, dtype=np.int64)
        order = np.argsort(n1, kind="stable")
        self.code, self.ids, self.n1, self.words, self.bf_len = code, ids[order], n1[order], words[order], bf_len

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "place"}  # this is made where it is used

    def ready(self) -> Probes:
        if "place" not in self.__dict__:
            self.place = {x: i for i, x in enumerate(self.ids.tolist())}
        return self


def unpacked(words: np.ndarray, bf_len: int) -> np.ndarray:
    """0/1 rows."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")[:, :bf_len].astype(np.float32)


class Best:
    """Maximum, ties at it and own-id flag of each probe so far; compared counts the pairs that were multiplied."""

    def __init__(self, probes: Probes, k: int):
        n = len(probes.ids)
        self.probes, self.top, self.ties, self.hit, self.compared = probes, np.full(n, -1.0), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def floor(self, a: int, b: int) -> float:
        """Blocks below this can't change the probes from a to b."""
        return self.top[a:b].min()

    def take(self, a: int, b: int, sims: np.ndarray, ids: np.ndarray) -> None:
        m = sims.max(1)
        at = sims == m[:, None]
        n, h = at.sum(1), np.zeros(b - a, np.int64)
        own = [(r - a, c) for c, x in enumerate(ids.tolist()) if a <= (r := self.probes.place.get(x, -1)) < b]
        if own:
            r, c = map(np.array, zip(*own, strict=True))
            np.maximum.at(h, r, at[r, c])
        top, ties, hit = self.top[a:b], self.ties[a:b], self.hit[a:b]
        more, same = m > top, m == top
        ties[:] = np.where(more, n, ties + same * n)
        hit[:] = np.where(more, h, np.where(same, np.maximum(hit, h), hit))
        np.maximum(top, m, out=top)
        self.compared[a:b] += len(ids)

    def batch(self) -> pa.RecordBatch:
        p = self.probes
        return pa.record_batch([pa.array([p.code] * len(p.ids)), pa.array(p.ids.tolist()), pa.array(self.top), pa.array(self.ties), pa.array(self.hit), pa.array(self.compared)], ["type", "probe_id", "best", "ties", "hit", "compared"])

    SCHEMA = "type string, probe_id {id}, best double, ties long, hit long, compared long"


class Top:
    """The k best candidates of each probe so far by (sim desc, cand_id)."""

    def __init__(self, probes: Probes, k: int):
        self.probes, self.k, self.least = probes, k, np.full(len(probes.ids), -1.0)
        self.rows = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object))

    def floor(self, a: int, b: int) -> float:
        return self.least[a:b].min()

    def take(self, a: int, b: int, sims: np.ndarray, ids: np.ndarray) -> None:
        if sims.shape[1] > self.k:  # no more than those that tie with the k-th
            enough = np.maximum(self.least[a:b], -np.partition(-sims, self.k - 1, axis=1)[:, self.k - 1])
        else:
            enough = self.least[a:b]
        r, c = np.nonzero(sims >= enough[:, None])
        row, sim, own = (np.concatenate(x) for x in zip(self.rows, (r + a, sims[r, c], ids[c]), strict=True))
        order = np.lexsort((own.astype(str) if own.dtype == object else own, -sim, row))
        row, sim, own = row[order], sim[order], own[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        self.rows = (row[place < self.k], sim[place < self.k], own[place < self.k])
        last = place == self.k - 1
        self.least[row[last]] = sim[last]

    def batch(self) -> pa.RecordBatch:
        row, sim, own = self.rows
        p = self.probes
        return pa.record_batch([pa.array([p.code] * len(row), pa.string()), pa.array(p.ids[row].tolist(), pa.array(p.ids.tolist()).type), pa.array(own.tolist(), pa.array(p.ids.tolist()).type), pa.array(sim)], ["type", "probe_id", "cand_id", "sim"])

    SCHEMA = "type string, probe_id {id}, cand_id {id}, sim double"


def bound(a: np.ndarray, b: np.ndarray) -> float:
    """The largest Dice of filters whose set-bit counts lie in the ranges of a and of b (both sorted)."""
    low, high = (a, b) if a[-1] < b[0] else (b, a)
    if low[-1] >= high[0] or not high[0]:
        return 1.0
    return 2.0 * low[-1] / (low[-1] + high[0])


def compare(found: Best | Top, bits: np.ndarray, n1: np.ndarray, ids: np.ndarray, n_probes: int, n_cands: int) -> None:
    """Candidates by set bits in blocks, visited for each block of probes by their bound, until it is below what the probes have.
    Exact: a bound is at least each quotient that it stands for, and equal ones are still visited."""
    order = np.argsort(n1, kind="stable")
    p = found.probes
    cuts = [order[c : c + n_cands] for c in range(0, len(order), n_cands)]
    for a in range(0, len(p.ids), n_probes):
        b = min(a + n_probes, len(p.ids))
        mine = unpacked(p.words[a:b], p.bf_len)  # of a block only: unpacked, a probe takes 32 times as much
        for most, c in sorted(((bound(p.n1[a:b], n1[at]), c) for c, at in enumerate(cuts)), reverse=True):
            if most < found.floor(a, b):
                break
            at = cuts[c]
            both = p.n1[a:b, None] + n1[at][None, :]
            found.take(a, b, 2.0 * (mine @ bits[at].T).astype(np.float64) / np.maximum(both, 1), ids[at])


def block_product(probes: DataFrame, cands: DataFrame, bf_len: int, noise: Noise | None = None) -> DataFrame:
    """0/1 matrix products of candidate batches with the probes of their type (base records: of every type), which every
    task gets, in passes of MAX_PROBE_BYTES of probes. Only a partial best for each probe and task is shuffled. noise
    (method, probability, seed): candidates are noised in the task by the counter-based generator, probes beforehand. compared: the
    candidates of a probe that were multiplied with it; the others' counts of set bits ruled them out."""
    part = _products(probes, cands, bf_len, noise, Best, 0)
    per = part.groupBy("type", "probe_id", "best").agg(F.sum("ties").alias("ties"), F.max("hit").cast("int").alias("hit"), F.sum("compared").alias("compared"))
    top = per.groupBy("type", "probe_id").agg(F.max(F.struct("best", "ties", "hit")).alias("m"), F.sum("compared").alias("compared"))
    return top.select("type", "probe_id", "m.best", "m.ties", "m.hit", outcome(F.col("m.ties"), F.col("m.hit")).alias("outcome"), "compared")


def top_product(probes: DataFrame, cands: DataFrame, bf_len: int, k: int = 5, noise: Noise | None = None) -> DataFrame:
    """type, probe_id, cand_id, sim, place: the k best candidates of each probe. A task sends k rows a probe, not one for each pair."""
    return top_matches(_products(probes, cands, bf_len, noise, Top, k), k)


def _products(probes: DataFrame, cands: DataFrame, bf_len: int, noise: Noise | None, kind: type, k: int) -> DataFrame:
    held = probes.count() * (PROBE_BYTES + 8 * n_words(bf_len))
    passes = -(-3 * held // (2 * MAX_PROBE_BYTES)) if held > MAX_PROBE_BYTES else 1  # dealt by hash, so with room
    cands = cands.select("type", "cand_id", filter_of(cands, bf_len).alias("words"))
    probes = probes.select("type", "probe_id", filter_of(probes, bf_len).alias("words"))
    if passes == 1:
        return _pass(probes, cands, bf_len, noise, kind, k)
    part = F.pmod(F.xxhash64("type", "probe_id"), F.lit(passes))
    return reduce(DataFrame.unionByName, [cut(_pass(probes.filter(part == i), cands, bf_len, noise, kind, k)) for i in range(passes)])


def _pass(probes: DataFrame, cands: DataFrame, bf_len: int, noise: Noise | None, kind: type, k: int) -> DataFrame:
    local = probes.toPandas()  # within MAX_PROBE_BYTES
    by_type = {}
    for code, rows in local.groupby("type"):
        words = np.stack(rows.words.to_list()).astype(np.int64).view(np.uint64)
        if noise:
            words = counter_noise(words, [f"{noise[2]}|{code}|p|{r}" for r in rows.probe_id], bf_len, *noise[:2])
        by_type[code] = Probes(code, rows.probe_id.to_numpy(), words, bf_len)
    sent, blocks = probes.sparkSession.sparkContext.broadcast(by_type), (PROBES, CANDS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Best | Top] = {}
        for batch in batches:
            kinds, ids, filters = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist()), word_matrix(batch.column(2)) if batch.num_rows else None
            if ids.dtype.kind == "U":
                ids = ids.astype(object)
            of = np.array(kinds, object)
            for key in dict.fromkeys(kinds):
                at = np.flatnonzero(of == key)
                for code in sent.value if key == BASE_TYPE else [key] if key in sent.value else []:
                    words = filters[at]
                    if noise:
                        words = counter_noise(words, [f"{noise[2]}|{code}|c|{r}" for r in ids[at]], bf_len, *noise[:2])
                    one = found.get(code) or found.setdefault(code, kind(sent.value[code].ready(), k))
                    compare(one, unpacked(words, bf_len), np.bitwise_count(words).sum(1, dtype=np.int64), ids[at], *blocks)
        for one in found.values():
            yield one.batch()

    return cands.mapInArrow(work, kind.SCHEMA.format(id=dict(probes.dtypes)["probe_id"]))


def top_matches(scored: DataFrame, k: int = 5) -> DataFrame:
    """The k best candidates of each probe by (sim desc, cand_id): a diagnostic on a few probes."""
    w = Window.partitionBy("type", "probe_id").orderBy(F.desc("sim"), "cand_id")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def tally(results: DataFrame, types: list[str], metrics: list[str], outcomes: tuple[str, ...]) -> DataFrame:
    """type, metric, outcome, n with zeros for outcomes that don't occur."""
    spark = results.sparkSession
    frame = spark.createDataFrame([(t, m, o) for t in types for m in metrics for o in outcomes], "type string, metric string, outcome string")
    n = results.groupBy("type", "metric", "outcome").agg(F.count("*").alias("n"))
    return frame.join(n, ["type", "metric", "outcome"], "left").select("type", "metric", "outcome", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def to_report(long: DataFrame) -> DataFrame:
    """One row a type, a column a metric, each cell a dict literal."""
    cell = F.concat(F.lit("{"), F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("outcome", "n"))), lambda x: F.concat(F.lit("'"), x["outcome"], F.lit("': "), x["n"].cast("string")))), F.lit("}"))
    return long.groupBy(F.col("type").alias("id")).pivot("metric", sorted({"og_bf_dice", "blip_bf_dice"}, reverse=True)).agg(cell)

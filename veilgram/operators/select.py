"""The vulnerability subsets, each a top-N by a sort key and file order; random and base samples."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgram.config import BASE_TYPE, SampleConfig
from veilgram.operators import stats
from veilgram.plans.lineage import cut

#: Leading hexadecimal digits of a hash that name its cell: 4,096 cells of about equal size.
CELL_DIGITS = 3


class TooFewRecords(ValueError):
    pass


def need(found: int, wanted: int, what: str) -> None:
    if found < wanted:
        raise TooFewRecords(f"{what}: {wanted} records are needed, {found} are there")


#: What each selector sorts by, smallest first, then by ord. q_r is made of three lists, see selected().
KEYS = {
    "l_s": lambda c, m: c["n_grams"],
    "l_h": lambda c, m: -c["n_grams"],
    "l_a": lambda c, m: np.abs(c["n_grams"] - m["mean_len"]),
    "f_h": lambda c, m: -c["score"],
    "f_l": lambda c, m: c["score"],
    "f_a": lambda c, m: np.abs(c["score"] - m["mean_score"]),
    "q_f": lambda c, m: c["rank"],
    "q_a": lambda c, m: c["absdiff"],
}
READ = ["rec_id", "ord", "n_grams", "score", "rank", "revrank", "revrank_rest", "absdiff"]


class Least:
    """The n smallest rows by (key, ord) that it was given."""

    def __init__(self, n: int):
        self.n, self.rows, self.last = n, None, np.inf

    def take(self, key: np.ndarray, order: np.ndarray, more: dict[str, np.ndarray], ok: np.ndarray | None = None) -> None:
        at = np.flatnonzero((key <= self.last) if ok is None else (key <= self.last) & ok)
        new = {"key": key[at], "ord": order[at]} | {k: v[at] for k, v in more.items()}
        rows = new if self.rows is None else {k: np.concatenate([self.rows[k], v]) for k, v in new.items()}
        first = np.lexsort((rows["ord"], rows["key"]))[: self.n]
        self.rows = {k: v[first] for k, v in rows.items()}
        if len(first) == self.n:
            self.last = self.rows["key"][-1]


def selected(prof: DataFrame, n: int) -> DataFrame:
    """rec_id, ord, type, key of all nine subsets: the first n by (key, ord) of each, from one scan. A task keeps n rows a list; the lists meet
    in a window of as many rows as there are tasks times n.

    Records taken for the most frequent gram lose their claim on the rarest one. Who is taken (the first n of rank 0 by ord)
    shows only when the lists meet, so a task sends, for q_r, n rows of other ranks, 2 n of rank 0 (of which n at most are
    taken), and the n that may be taken, with the key that they have then."""
    means = stats.means(prof).first().asDict()  # one row
    lists = dict.fromkeys(KEYS, n) | {"q_r": n, "q_r0": 2 * n, "taken": n}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {code: Least(size) for code, size in lists.items()}
        for b in batches:
            c = {name: b.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(READ)}
            c |= {k: c[k].astype(np.float64) for k in READ[2:]}
            ids, zero = {"rec_id": c["rec_id"], "rest": c["revrank_rest"]}, c["rank"] == 0
            for code, key in KEYS.items():
                held[code].take(key(c, means), c["ord"], ids)
            held["q_r"].take(c["revrank"], c["ord"], ids, ~zero)
            held["q_r0"].take(c["revrank"], c["ord"], ids, zero)
            held["taken"].take(np.zeros(len(zero)), c["ord"], ids, zero)
        for code, least in held.items():
            if least.rows is not None and len(least.rows["key"]):
                r = least.rows
                key = r["rest"] if code == "taken" else r["key"]
                yield pa.record_batch([pa.array(r["rec_id"].tolist()), pa.array(r["ord"]), pa.array([code] * len(key)), pa.array(key, from_pandas=True)], ["rec_id", "ord", "type", "key"])

    kinds = dict(prof.dtypes)
    found = cut(prof.select(*READ).mapInArrow(work, f"rec_id {kinds['rec_id']}, ord {kinds['ord']}, type string, key double"))
    taken = _first(found.filter("type = 'taken'"), n, "ord")
    rare = found.filter("type = 'q_r'").unionByName(found.filter("type = 'q_r0'").join(taken.select("rec_id"), "rec_id", "left_anti")).unionByName(taken.filter("key IS NOT NULL"))
    rest = found.filter(F.col("type").isin(*KEYS)).unionByName(rare.withColumn("type", F.lit("q_r")))
    return _first(rest, n, "key", "ord")


def _first(rows: DataFrame, n: int, *by: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("type").orderBy(*by))
    return rows.withColumn("place", place).filter(F.col("place") <= n).drop("place")


def subsets(prof: DataFrame, n: int, codes: tuple[str, ...] = (*KEYS, "q_r")) -> dict[str, DataFrame]:
    found = cut(selected(prof, n))
    return {c: found.filter(F.col("type") == c) for c in codes}


def by_length(prof: DataFrame, n: int) -> dict[str, DataFrame]:
    return subsets(prof, n, ("l_s", "l_h", "l_a"))


def by_frequency(prof: DataFrame, n: int) -> dict[str, DataFrame]:
    return subsets(prof, n, ("f_h", "f_l", "f_a", "q_f", "q_r", "q_a"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def overlaps(nine: DataFrame) -> DataFrame:
    """Ids in more than one subset, with the number of subsets."""
    return nine.groupBy("rec_id").agg(F.count("*").alias("n")).filter("n > 1")


def shuffled(recs: DataFrame, nine: DataFrame, cfg: SampleConfig) -> DataFrame:
    """Ids in no subset, the first 3 n_subset + n_base of them in a keyed hash order that no partitioning changes, with
    their 0-based position: the ids before a row's cell of the hash, and its place among those of the cell. Only the cells
    that begin within the wanted number are sorted."""
    wanted = 3 * cfg.n_subset + cfg.n_base
    h = F.md5(F.concat_ws("|", F.lit(str(cfg.seed)), F.lit("rnd"), F.col("rec_id").cast("string")))
    free = recs.join(nine.select("rec_id"), "rec_id", "left_anti").select("rec_id", "ord", h.alias("h"), F.substring(h, 1, CELL_DIGITS).alias("cell"))
    earlier = Window.partitionBy().orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # over the cells, not the ids
    cells = free.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rows = free.join(F.broadcast(cells.filter(F.col("before") < wanted)), "cell")  # 16 ** CELL_DIGITS rows at most
    pos = F.col("before") + F.row_number().over(Window.partitionBy("cell").orderBy("h", "ord")) - 1
    return rows.select("rec_id", "ord", pos.alias("pos")).filter(F.col("pos") < wanted)


def random_and_base(order: DataFrame, cfg: SampleConfig) -> DataFrame:
    """rec_id, ord, type in r1 r2 r3 b: the hash order cut in pieces, so all are disjoint."""
    n, pos = cfg.n_subset, F.col("pos")
    code = F.when(pos < n, "r1").when(pos < 2 * n, "r2").when(pos < 3 * n, "r3").otherwise(BASE_TYPE)
    return order.select("rec_id", "ord", code.alias("type"))

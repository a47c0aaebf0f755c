"""The stateless steps over a stream of person rows: normalise, tokenise, encode, harden."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgram.functions.hashing import HashFamily, IndexedDigest
from veilgram.operators import harden
from veilgram.sources import people


def encoded(stream: DataFrame, bf_len: int, k: int, q: int = 2, family: HashFamily | None = None) -> DataFrame:
    """rec_id, ord, qs, pos. Positions are taken from each gram in place, as a stream has no finished vocabulary."""
    fam = family or IndexedDigest()
    rows = people.qgram_rows(people.normalised(stream), q)
    pos = F.array_sort(F.array_distinct(F.flatten(F.transform("qs", lambda g: fam.positions(g, bf_len, k)))))
    return rows.withColumn("pos", pos)


def hardened(rows: DataFrame, bf_len: int, method: str, prob: float, seed: int, subset: str = "stream", side: str = "c") -> DataFrame:
    key = harden.noise_key(seed, F.lit(subset), F.lit(side), F.col("rec_id"))
    return rows.withColumn("pos", harden.digest_noise(F.col("pos"), key, bf_len, method, prob))

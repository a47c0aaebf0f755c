"""Typed sample -> Bloom filters -> noise -> best matches -> tally."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgram.config import METRICS, OUTCOMES, SUBSET_TYPES, LinkConfig, hash_count
from veilgram.functions.hashing import HashFamily
from veilgram.operators import encode, harden, match, stats
from veilgram.plans.lineage import cut


class Linkage:
    """sample: rec_id, ord, type, qs. noise: 'md5' (expressible in SQL) or 'philox' (for large data)."""

    def __init__(self, sample: DataFrame, cfg: LinkConfig, noise: str = "philox", family: HashFamily | None = None):
        if noise not in ("md5", "philox"):
            raise ValueError("noise must be 'md5' or 'philox'")
        self.sample, self.cfg, self.noise, self.family = sample, cfg, noise, family

    @cached_property
    def k(self) -> int:
        k_opt = stats.optimal_hash_count(self.sample, self.cfg.bf_len).first()["k_opt"]
        return hash_count(k_opt, self.cfg.k_ratio)

    @cached_property
    def bfs(self) -> DataFrame:
        return cut(encode.encode_packed(self.sample, self.cfg.bf_len, self.k, self.family))

    @cached_property
    def sides(self) -> tuple[DataFrame, DataFrame]:
        probes, cands = match.sides(self.sample.select("rec_id", "type"), self.bfs)
        return cut(probes), cut(cands)

    @cached_property
    def sides_once(self) -> tuple[DataFrame, DataFrame]:
        probes, cands = match.sides_once(self.sample.select("rec_id", "type"), self.bfs)
        # Rows are small and their noise and products costly: spread them, or adaptive execution packs them into one task.
        return cut(probes), cut(cands.repartition(cands.sparkSession.sparkContext.defaultParallelism, "type", "cand_id"))

    @property
    def hardened(self) -> DataFrame:
        """type, side, rec_id, words, pos, n1 under md5 noise."""
        c = self.cfg
        return harden.harden(self.both_sides, c.bf_len, c.flip_method, c.flip_prob, c.seed)

    @property
    def both_sides(self) -> DataFrame:
        probes, cands = self.sides
        return probes.select("type", F.lit("p").alias("side"), F.col("probe_id").alias("rec_id"), "words", "n1").unionByName(cands.select("type", F.lit("c").alias("side"), F.col("cand_id").alias("rec_id"), "words", "n1"))

    @property
    def hardened_by_word(self) -> DataFrame:
        """The same under md5 noise of 64 bits at a time."""
        c = self.cfg
        return harden.harden(self.both_sides, c.bf_len, c.flip_method, c.flip_prob, c.seed, by_word=True)

    @cached_property
    def clean(self) -> DataFrame:
        return match.clean(*self.sides_once)

    @cached_property
    def noisy(self) -> DataFrame:
        c = self.cfg
        if c.flip_prob == 0:  # nothing flips
            return self.clean
        if self.noise == "philox":
            return match.block_product(*self.sides_once, c.bf_len, (c.flip_method, c.flip_prob, c.seed)).drop("compared")
        h = cut(self.hardened.select("type", "side", "rec_id", "words", "n1"))  # read twice
        probes = h.filter("side = 'p'").select("type", F.col("rec_id").alias("probe_id"), "words", "n1")
        cands = h.filter("side = 'c'").select("type", F.col("rec_id").alias("cand_id"), "words", "n1")
        return match.block_product(probes, cands, c.bf_len).drop("compared")

    @cached_property
    def results(self) -> DataFrame:
        return self.clean.withColumn("metric", F.lit(METRICS[0])).unionByName(self.noisy.withColumn("metric", F.lit(METRICS[1])))

    @cached_property
    def tally(self) -> DataFrame:
        return match.tally(self.results, list(SUBSET_TYPES), list(METRICS), OUTCOMES)

    def diagnostics(self, n_probes: int = 25, k: int = 5) -> DataFrame:
        """Best k clean matches of the first n_probes records (by ord) of each type, with set and filter sizes, and the
        similarity under noise."""
        from pyspark.sql import Window

        probes, cands = self.sides_once
        first = self.sample.filter("type <> 'b'").withColumn("i", F.row_number().over(Window.partitionBy("type").orderBy("ord"))).filter(F.col("i") <= n_probes)
        few = probes.join(first.select("type", F.col("rec_id").alias("probe_id")), ["type", "probe_id"], "left_semi")
        best = match.top_product(few, cands, self.cfg.bf_len, k)
        sets = self.sample.select("rec_id", "qs").dropDuplicates(["rec_id"])
        p = sets.select(F.col("rec_id").alias("probe_id"), F.col("qs").alias("pq"))
        c = sets.select(F.col("rec_id").alias("cand_id"), F.col("qs").alias("cq"))
        filters = self.bfs.select("rec_id", "words", "n1")
        pf = filters.withColumnsRenamed({"rec_id": "probe_id", "words": "pw", "n1": "probe_bits"})
        cf = filters.withColumnsRenamed({"rec_id": "cand_id", "words": "cw", "n1": "cand_bits"})
        out = harden.noisy_dice(best.join(pf, "probe_id").join(cf, "cand_id"), self.cfg, self.noise).join(p, "probe_id").join(c, "cand_id")
        return out.select("type", "probe_id", "cand_id", "place", "sim", F.size("pq").alias("probe_grams"), F.size("cq").alias("cand_grams"), F.size(F.array_intersect("pq", "cq")).alias("common_grams"), "probe_bits", "cand_bits", "noisy_sim")

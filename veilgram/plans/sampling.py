"""Person rows -> q-gram sets -> distinct records -> typed subsets."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgram.config import SampleConfig
from veilgram.operators import dedupe, select, stats
from veilgram.plans.lineage import cut
from veilgram.sources import people


class Sampling:
    """Lazy steps of one sampling run; each attribute is a DataFrame. cfg None: sizes follow the number of
    records (a 38th part for a subset, 3 at least; half for the base)."""

    def __init__(self, source: DataFrame, cfg: SampleConfig | None = None):
        self.source, self._cfg = source, cfg

    @cached_property
    def normalised(self) -> DataFrame:
        return people.normalised(self.source, self._cfg.min_len if self._cfg else 2)

    @cached_property
    def qgrams(self) -> DataFrame:
        return people.qgram_rows(self.normalised, self._cfg.q if self._cfg else 2)

    @cached_property
    def records(self) -> DataFrame:
        return cut(dedupe.records(self.qgrams))

    @cached_property
    def cfg(self) -> SampleConfig:
        n = self.records.count()
        cfg = self._cfg or SampleConfig(n_subset=max(3, n // 38), n_base=n // 2)
        select.need(n, 12 * cfg.n_subset + cfg.n_base if self._cfg else cfg.n_subset, "sample")
        return cfg

    @cached_property
    def ranks(self) -> DataFrame:
        return cut(stats.ranked(stats.frequencies(self.records)))

    @cached_property
    def profile(self) -> DataFrame:
        return cut(stats.profile(self.records, self.ranks))

    @cached_property
    def subsets(self) -> dict[str, DataFrame]:
        return {c: self.nine.filter(F.col("type") == c) for c in (*select.KEYS, "q_r")}

    @cached_property
    def nine(self) -> DataFrame:
        """All nine subsets, from one scan of the profile."""
        return cut(select.selected(self.profile, self.cfg.n_subset).select("rec_id", "ord", "type"))

    @cached_property
    def order(self) -> DataFrame:
        return select.shuffled(self.records, self.nine, self.cfg)

    @cached_property
    def random_and_base(self) -> DataFrame:
        return select.random_and_base(self.order, self.cfg)

    @cached_property
    def typed(self) -> DataFrame:
        """rec_id, ord, type of all thirteen types."""
        return self.nine.unionByName(self.random_and_base)

    @cached_property
    def sample(self) -> DataFrame:
        """rec_id, ord, type, qs."""
        return cut(self.typed.join(self.records.select("rec_id", "qs"), "rec_id"))


def voters(spark, sf_dir: str) -> Sampling:
    return Sampling(people.voters(spark, sf_dir))


def lengths(s: Sampling) -> DataFrame:
    return s.records.select("rec_id", F.size("qs").alias("n_grams"))

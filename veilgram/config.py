"""Parameters of the sampling and linkage plans, checked when they are made."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: Type codes, outcomes and metrics of the interchange files and the report (fixed values).
SUBSET_TYPES = ("f_h", "f_l", "f_a", "q_f", "q_r", "q_a", "l_h", "l_s", "l_a", "r1", "r2", "r3")
BASE_TYPE = "b"
ALL_TYPES = (*SUBSET_TYPES, BASE_TYPE)
OUTCOMES = ("1-1-correct", "1-1-wrong", "1-n-correct", "1-n-wrong")
METRICS = ("og_bf_dice", "blip_bf_dice")


@dataclass(frozen=True)
class SampleConfig:
    """n_subset, n_base: records in each subset and in the base sample. min_len: shorter values count as missing."""

    n_subset: int = 1000
    n_base: int = 1_000_000
    q: int = 2
    min_len: int = 2
    seed: int = 42

    def __post_init__(self) -> None:
        if self.n_subset < 1 or self.n_base < 0 or self.q < 1 or self.min_len < 1:
            raise ValueError(f"sizes out of range: {self}")


@dataclass(frozen=True)
class LinkConfig:
    encoding: str = "bf"
    hardening: str = "blip"
    bf_len: int = 1000
    k_ratio: float = 1.0
    flip_method: str = "sch"
    flip_prob: float = 0.5
    seed: int = 42

    def __post_init__(self) -> None:
        if self.encoding != "bf":
            raise ValueError(f"encoding {self.encoding!r} is not implemented; only 'bf' is")
        if self.hardening != "blip":
            raise ValueError(f"hardening {self.hardening!r} is not implemented; only 'blip' is")
        if self.bf_len <= 1:
            raise ValueError("bf_len must be over 1")
        if self.k_ratio not in (0.5, 1.0, 2.0):
            raise ValueError("k_ratio must be 0.5, 1.0 or 2.0")
        if self.flip_method not in ("ala", "sch"):
            raise ValueError("flip_method must be 'ala' or 'sch'")
        if not 0 <= self.flip_prob <= 1:
            raise ValueError("flip_prob must be in 0..1")

    @property
    def epsilon(self) -> float:
        """Per-bit differential-privacy epsilon of the flipping."""
        p = self.flip_prob if self.flip_method == "ala" else self.flip_prob / 2
        return math.inf if p == 0 else math.log((1 - p) / p)


def hash_count(k_opt: int, ratio: float) -> int:
    """Number of hash functions: the optimal count scaled by ratio, truncated."""
    k = int(ratio * k_opt)
    if k < 1:
        raise ValueError(f"{ratio} x {k_opt} gives no hash function")
    return k

"""Checks and counts over the typed sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgram.config import ALL_TYPES, BASE_TYPE


def multi_type_counts(typed: DataFrame) -> DataFrame:
    """types, n: for the 2nd, 3rd ... row of an id (by ord), the sorted types it has had so far."""
    w = Window.partitionBy("rec_id").orderBy("ord")
    so_far = typed.select(F.row_number().over(w).alias("k"), F.concat_ws(",", F.array_sort(F.collect_list("type").over(w))).alias("types"))
    return so_far.filter("k > 1").groupBy("types").agg(F.count("*").alias("n"))


def type_counts(typed: DataFrame) -> DataFrame:
    return typed.groupBy("type").agg(F.count("*").alias("n"))


def validate(typed: DataFrame, n_subset: int, n_base: int) -> None:
    """Raises if a type is unknown or missing, a size is wrong, a (type, rec_id) repeats, or base meets a subset."""
    n = {r["type"]: r["n"] for r in type_counts(typed).collect()}  # one row a type code
    if extra := set(n) - set(ALL_TYPES):
        raise ValueError(f"unknown types: {sorted(extra)}")
    for code in ALL_TYPES:
        want = n_base if code == BASE_TYPE else n_subset
        if n.get(code, 0) != want:
            raise ValueError(f"type {code} has {n.get(code, 0)} records, not {want}")
    base = F.col("type") == BASE_TYPE
    per = typed.groupBy("rec_id").agg(F.count("*").alias("n"), F.countDistinct("type").alias("kinds"), F.max(base).alias("b"))
    bad = per.filter("n > kinds OR (b AND kinds > 1)").limit(1).collect()
    if bad:
        raise ValueError(f"record {bad[0]['rec_id']} repeats within a type or is in the base and a subset")

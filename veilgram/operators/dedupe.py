"""First record of each q-gram set; later sets of an id replace earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_sets(recs: DataFrame) -> DataFrame:
    """rec_id, ord, qs -> the same columns, first by ord for each set. A hash aggregate with partial
    minima, so a set that very many records share doesn't meet in one task row by row. Sets are compared as JSON text: exact, and a
    fifth of an array's bytes, so that neither digests nor a check of their collisions are needed."""
    return _read(_distinct(_written(recs)))


def upsert(recs: DataFrame) -> DataFrame:
    """One row an id: the last of its sets at the place of its first; n_replaced counts the others."""
    return _read(_upsert(_written(recs)))


def records(recs: DataFrame) -> DataFrame:
    return _read(_upsert(_distinct(_written(recs)))).drop("n_replaced")


def _written(recs: DataFrame) -> DataFrame:
    return recs.select("rec_id", "ord", F.to_json("qs").alias("qs"))


def _read(rows: DataFrame) -> DataFrame:
    return rows.withColumn("qs", F.from_json("qs", "array<string>"))


def _distinct(rows: DataFrame) -> DataFrame:
    return rows.groupBy("qs").agg(F.min(F.struct("ord", "rec_id")).alias("m")).select("m.rec_id", "m.ord", "qs")


def _upsert(rows: DataFrame) -> DataFrame:
    return rows.groupBy("rec_id").agg(F.min("ord").alias("ord"), F.max_by("qs", "ord").alias("qs"), (F.count("*") - 1).alias("n_replaced"))

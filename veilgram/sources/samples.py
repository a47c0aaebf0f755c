"""The typed sample: Parquet by type, or the text form whose sets are Python literals."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgram.config import ALL_TYPES

HEADER = ["rec_id", "q_gram_set", "type"]


@F.pandas_udf(T.ArrayType(T.StringType()))
def literal_set(s: pd.Series) -> pd.Series:
    """Sorted members of a literal such as {'ab', "o'"}; literals only are evaluated."""
    return s.map(lambda x: sorted(set(ast.literal_eval(x)) if x != "set()" else ()))


@F.pandas_udf(T.StringType())
def set_literal(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "{" + ", ".join(map(repr, x)) + "}" if len(x) else "set()")


def write(sample: DataFrame, path: str) -> None:
    sample.select("rec_id", "ord", "qs", "type").write.mode("errorifexists").partitionBy("type").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(sample: DataFrame, path: str) -> None:
    """UTF-8 text, types in their fixed order, records by ord within a type."""
    rank = F.array_position(F.array(*[F.lit(t) for t in ALL_TYPES]), F.col("type"))
    rows = sample.orderBy(rank, "ord").select("rec_id", set_literal(F.col("qs")).alias("q_gram_set"), "type")
    rows.write.csv(path, header=True, quote='"', escape='"', encoding="UTF-8")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """rec_id, ord, qs, type; raises on another header or an unknown type."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    if raw.columns != HEADER:
        raise ValueError(f"header is {raw.columns}, not {HEADER}")
    known = F.col("type").isin(*ALL_TYPES)
    code = F.when(known, F.col("type")).otherwise(F.raise_error(F.concat(F.lit("unknown type "), F.coalesce("type", F.lit("null")))))
    return raw.select("rec_id", F.monotonically_increasing_id().alias("ord"), literal_set(F.col("q_gram_set")).alias("qs"), code.alias("type"))

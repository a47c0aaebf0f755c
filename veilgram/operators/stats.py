"""q-gram frequencies and what they say of each record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frequencies(recs: DataFrame) -> DataFrame:
    """q, df: the number of records with q."""
    return recs.select(F.explode("qs").alias("q")).groupBy("q").agg(F.count("*").alias("df"))


def ranked(freq: DataFrame) -> DataFrame:
    """q, df, rank, revrank (0: most, least frequent; ties by q) and absdiff from the mean frequency.
    The one-partition window runs over the q-gram vocabulary, which the alphabet bounds, not over records."""
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mean = F.least(F.floor(F.sum("df").over(every) / F.count("*").over(every)), F.max("df").over(every)).cast("bigint")
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("df"), "q")).cast("bigint") - 1
    return freq.select("q", "df", rank.alias("rank"), mean.alias("mean"), F.count("*").over(every).alias("n")).select(
        "q", "df", "rank", (F.col("n") - 1 - F.col("rank")).alias("revrank"), F.abs(F.col("df") - F.col("mean")).alias("absdiff")
    )


def profile(recs: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row a record with all keys the selectors sort by; a single pass over the exploded sets.
    The join is left to Catalyst: it broadcasts the vocabulary when its measured size allows."""
    return (
        recs.select("rec_id", "ord", F.explode("qs").alias("q"))
        .join(ranks, "q")
        .groupBy("rec_id", "ord")
        .agg(
            F.count("*").alias("n_grams"),
            F.sum("df").alias("sum_df"),
            F.min("rank").alias("rank"),
            F.min("revrank").alias("revrank"),
            F.min(F.when(F.col("revrank") > 0, F.col("revrank"))).alias("revrank_rest"),
            F.min("absdiff").alias("absdiff"),
        )
        .withColumn("score", F.col("sum_df") / F.col("n_grams"))
    )


def means(prof: DataFrame) -> DataFrame:
    """One row: mean set length, and mean score from scaled integers, which no partitioning changes."""
    return prof.agg(
        F.avg("n_grams").alias("mean_len"),
        (F.sum(F.expr("(sum_df * 1000000) div n_grams")) / F.count("*") / F.lit(1e6)).alias("mean_score"),
    )


def optimal_hash_count(typed_sets: DataFrame, bf_len: int) -> DataFrame:
    """One row k_opt over (type, record) rows with qs: int(l / mean size * ln 2)."""
    k = F.floor(F.lit(float(bf_len)) / F.avg(F.size("qs")) * F.log(F.lit(2.0))).cast("int")
    return typed_sets.agg(k.alias("k_opt"))

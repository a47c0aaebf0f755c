"""All pairs of rows that share a key, in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgram.operators.encode import n_words
from veilgram.plans.lineage import cut

#: Rows of a block, and up to BLOCKS of a key; blocks of longer keys have more rows, LARGEST times as many at most.
BLOCK, BLOCKS, LARGEST = 1024, 64, 16
#: Rows of a block that the other's rows go through at a time.
TILE = 128
#: Pairs of a task, about; few enough for the ids of a file of pairs to fit in a Parquet dictionary.
PAIRS = 1 << 23


def laid_out(counts: Iterable[tuple[str, int, int]], least: int) -> tuple[list[tuple], list[tuple], int]:
    """Blocks of each (key, size), as (key, size, first block, blocks); cells (key, i, j, task, tiles of j), i up to j; the number
    of tasks, least or more. counts: rows of each key and size. A key's blocks have rows of one size, or of neighbouring ones if these are
    rare; a task has cells of one sum of sizes, if these have pairs enough."""
    kinds, cells = [], []
    for key, group in groupby(sorted(counts), lambda c: c[0]):
        sizes = [(size, m) for _, size, m in group]
        rows = sum(m for _, m in sizes)
        block = min(LARGEST * BLOCK, max(BLOCK, -(-rows // BLOCKS)))
        rare = rows if rows <= BLOCK // 4 else max(BLOCK // 16, rows // BLOCKS)
        blocks, some, held = [], [], 0
        for size, m in sizes:
            some.append((size, m))
            held += m
            if held >= rare or size == sizes[-1][0]:
                k = -(-held // block)
                kinds += [(key, s, len(blocks), k) for s, _ in some]
                blocks += [(sum(s * m for s, m in some) / held, held / k)] * k
                some, held = [], 0
        for i, (a, p) in enumerate(blocks):
            cells += [(round(a + b) if len(blocks) > 1 else -1, key, i, j, max(1, round(q / TILE)), p * q / (1 + (i == j))) for j, (b, q) in enumerate(blocks[i:], i)]
    total = sum(c[-1] for c in cells)
    share = total / max(least, round(total / PAIRS)) if total else 1.0
    dealt, n, passed = [], 0, 0.0
    for _, group in groupby(sorted(cells), lambda c: c[0]):
        of_sum = list(group)
        pairs = sum(c[-1] for c in of_sum)
        if pairs > share / 4 and passed:
            n, passed = n + 1, 0.0
        part = pairs / max(1, round(pairs / share))
        for _, key, i, j, tiles, p in of_sum:
            if passed and passed + p / 2 > part:
                n, passed = n + 1, max(0.0, passed - part)
            dealt.append((key, i, j, n, tiles))
            passed += p
    return kinds, dealt, max(least, n + 1)


def table(spark: SparkSession, rows: list[tuple], columns: dict[str, pa.DataType]) -> DataFrame:
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(columns, r, strict=True)) for r in rows], pa.schema(columns)))


def within(rows: DataFrame, key: str, value: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], size: str | None = None) -> DataFrame:
    """a_id, b_id, sim of each two rows (rec_id, ord and more) of one key, a the one before by ord; value gets the columns of both
    by name, in either order, so it must be symmetric. size: a column with few values of whose sum in a pair value depends.

    Each two blocks of a key are a cell: a frequent key's pairs are spread over many tasks. In a cell the rows of one block come one
    by one and the other block is tiles, each a row of members by ord; what is shuffled is rows and tiles, never a pair. A key has
    some 100 blocks at most until blocks are at their largest, so up to there the shuffle grows as the rows do. One id of the pairs
    stays the same while the other goes through a tile, again and again in the same order, and cells of one sum of sizes go to the
    same tasks: encoded as runs and by small dictionaries, files hold some six bits of a pair."""
    spark = rows.sparkSession
    names = ["ord", *[c for c in rows.columns if c not in (key, "ord")]]
    sized = rows.withColumn("_size", F.col(size).cast("long") if size else F.lit(0).cast("long")).filter(F.col(key).isNotNull() & F.col("ord").isNotNull())
    # Bounded by the keys and sizes that the alphabet permits.
    counts = [tuple(c) for c in sized.groupBy(key, "_size").count().collect()]
    # More tasks than cores even out what cells differ in.
    kinds, cells, n = laid_out(counts, 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    sized = sized.join(table(spark, kinds, {key: pa.string(), "_size": pa.int64(), "_first": pa.int32(), "_k": pa.int32()}), [key, "_size"])
    own = F.col("_first") + F.pmod(F.xxhash64("rec_id"), F.col("_k")).cast("int")
    blocks = cut(sized.groupBy(key, own.alias("_own")).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("_block")))
    dealt = table(spark, cells, {key: pa.string(), "_i": pa.int32(), "_j": pa.int32(), "_task": pa.int32(), "_tiles": pa.int32()})

    def side(own: str, *members: Column) -> DataFrame:
        found = blocks.withColumnRenamed("_own", own).join(dealt, [key, own]).select(key, "_i", "_j", "_task", "_tiles", *members)
        return found.repartitionById(n, "_task") if size else found.repartition(n, key, "_i", "_j")

    x = side("_i", F.inline("_block").alias(*[f"x_{c}" for c in names]))
    if size:
        x = x.withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))).drop("_tiles")
    # Parquet packs values by eight: whole eights repeat byte by byte.
    rows_of = (F.ceil(F.size("_block") / F.col("_tiles") / 8) * 8).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("_tiles") - 1), lambda t: F.slice("_block", t * rows_of + 1, rows_of))
    y = side("_j", F.col("_block")).select(key, "_i", "_j", "_task", F.posexplode(tiles).alias("_t", "_tile"))
    # The pairs of a row and a tile are made at a time. A merge join reads a row's columns once for them and holds one tile.
    met = x.join(y.hint("merge"), [key, "_i", "_j", *(["_task", "_t"] if size else [])])
    met = met.select("_i", "_j", *[f"x_{c}" for c in names], F.inline("_tile").alias(*[f"y_{c}" for c in names]))
    first = F.col("x_ord") < F.col("y_ord")
    one, two = (lambda c: F.col(f"x_{c}")), (lambda c: F.col(f"y_{c}"))
    met = met.filter("_i < _j OR x_ord < y_ord")
    return met.select(F.when(first, one("rec_id")).otherwise(two("rec_id")).alias("a_id"), F.when(first, two("rec_id")).otherwise(one("rec_id")).alias("b_id"), value(one, two).alias("sim"))


def spread(rows: DataFrame, array: str, n: int) -> tuple[DataFrame, Callable[[Callable[[str], Column]], list[Column]]]:
    """rows with a column for each of the array's n words, which a pair reads faster, and what finds them by a side of within().
    No word is null; columns that say so keep the code for a pair short enough to be compiled."""
    words = [f"{array}_{w}" for w in range(n)]
    return rows.withColumns({c: F.coalesce(F.col(array)[w], F.lit(0).cast("bigint")) for w, c in enumerate(words)}).drop(array), lambda side: [side(c) for c in words]


def gram_bits(recs: DataFrame, ranks: DataFrame, n_grams: int) -> DataFrame:
    """rec_id, bits: each set as packed words over the ranked vocabulary, which the alphabet bounds."""
    rank = F.col("rank").cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), rank % 64)
    rows = recs.select("rec_id", F.explode("qs").alias("q")).join(ranks.select("q", "rank"), "q")
    words = [F.coalesce(F.bit_or(F.when(F.floor(rank / 64) == w, one)), F.lit(0).cast("bigint")) for w in range(n_words(n_grams))]
    return rows.groupBy("rec_id").agg(F.array(*words).alias("bits"))

"""What the operators share: the checkpoint folder, Arrow batches, and splitting an ordered table."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id in orders: after all others.
LAST = (1 << 63) - 1
#: Rows without doc_id are ordered from here on.
UNNAMED = 1 << 62


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run in one process."""
    sc = spark.sparkContext
    place = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(place)
    return place


def fresh_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


#: Page sizes are looked at after each row: some rows are long, and a page is held (and compressed) as a whole.
PARQUET = {"compression": "zstd", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "100", "parquet.block.size": str(16 << 20), "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


#: Rows a file of a narrow table. Each file costs an executor about three processes (to set permissions) where Hadoop's native
#: library is missing, and a count of memory that falls into the start of one takes the executor's for twice as much.
FILE_ROWS = 1 << 20


class Scratch:
    """Tables of one run. put() writes a narrow one as Parquet to the shared folder, in few files: lineage is cut there, and any
    executor can read it again. hold() keeps a wide one on the executors' disks; what is lost with one is computed again from
    its lineage. A table of a name takes the place of the earlier one, which is deleted once the new one is there."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root, self.n, self.at, self.held = spark, fresh_folder(spark, what), 0, {}, {}

    def put(self, name: str, df: DataFrame, files: int | None = None) -> DataFrame:
        path, self.n = f"{self.root}/{name}-{self.n}", self.n + 1
        rows = df if files else df.persist(StorageLevel.DISK_ONLY)
        rows.coalesce(files or 1 + rows.count() // FILE_ROWS).write.options(**PARQUET).parquet(path)
        if not files:
            rows.unpersist()
        self.drop(name)
        self.at[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def store(self, name: str, df: DataFrame) -> DataFrame:
        """put() for a table that is written as it comes, a file a task."""
        path, self.n = f"{self.root}/{name}-{self.n}", self.n + 1
        df.write.options(compression="zstd", **{"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}).parquet(path)
        self.drop(name)
        self.at[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def hold(self, name: str, df: DataFrame) -> DataFrame:
        df = df.persist(StorageLevel.DISK_ONLY)
        df.count()
        self.drop(name)
        self.held[name] = df
        return df

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.at.pop(name, None):
                delete(self.spark, path)
            if held := self.held.pop(name, None):
                held.unpersist()


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ident(docs: DataFrame) -> Column:
    """A whole number for each row: its doc_id, else one after all usual ids by hash of the text, so that rows without doc_id
    neither count as one document (but equal texts do) nor meet in one range."""
    number = F.col("doc_id").cast("long")
    if "text" not in docs.columns:
        return F.coalesce(number, F.lit(LAST))
    return F.coalesce(number, F.lit(UNNAMED) + F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(UNNAMED - 1))


def unused(df: DataFrame, name: str) -> str:
    """A name like this one that is no column of df, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows and bytes of a batch sent to Python: some whole texts are long, and two workers share an executor's memory.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def in_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(f, schema)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def id_cuts(df: DataFrame, column: str, n: int) -> list[int]:
    """Up to n - 1 increasing cut points of a whole-number column into ranges of about equal row counts."""
    if n < 2:
        return []
    at = [i / n for i in range(1, n)]
    got = df.select(F.percentile_approx(column, at, 10 * n).alias("q")).first()["q"]
    return sorted(set(got or []))


def range_number(c: Column, cuts: list[int]) -> Column:
    """0-based range of c: the number of cut points at or below it. Null goes to the last range. The cuts are constant
    arrays in blocks, searched by block and then within it: the generated code doesn't grow with their number."""
    if not cuts:
        return F.lit(0)
    size, c = math.isqrt(len(cuts)) + 1, F.coalesce(c, F.lit(LAST))
    blocks = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    block = _at_most(longs([b[0] for b in blocks]), c)
    inside = _at_most(F.get(F.array(*map(longs, blocks)), block - 1), c)
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * size + inside)


def longs(xs: list[int]) -> Column:
    """A constant array."""
    return F.split(F.lit(",".join(map(str, xs))), ",").cast("array<long>")


def _at_most(xs: Column, c: Column) -> Column:
    return F.size(F.filter(xs, lambda x: x <= c))

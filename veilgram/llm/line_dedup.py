"""Line dedup against levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends and with A-Z lowered; keys of fewer than
MIN_POINTS code points are never dropped. Documents come in batches of ascending doc_id. Each batch's keys are
grouped to their smallest doc_id, merge-anti-joined with the runs of all levels, and what is new becomes a run of
level 0; FANOUT runs of a level are compacted into one sorted run of the next.

Runs are tables bucketed and sorted by key, a file a bucket. A batch's keys are dealt out once, by the same hash, to be grouped;
they then meet each run bucket by bucket, neither dealt out nor sorted again on the run's side, and are written as a
run as they stand. Compaction merges runs bucket by bucket and deletes them. A line that very many documents share is one
row in all this; the documents that lose it are found by a join that can split it over tasks.

Defined cases: null or empty text is one empty line; rows with the same doc_id are one document; rows without doc_id come
after all others, by hash of their text, and are one document if their texts are equal; repeated lines within the
owning document stay; an empty table gives an empty result; further columns of the input, of any name, are kept by
dedup_lines(), but for n_lines and n_dropped."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgram.llm import common

MIN_POINTS, FANOUT, BATCHES = 10, 2, 4
SPACE = b" \t\n\x0b\x0c\r"


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_key(line: bytes, least: int = MIN_POINTS) -> tuple[int, int] | None:
    """128-bit hash of the key as two signed words, or None for a short key."""
    key = line.strip(SPACE).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode()) < least:
        return None
    h = xxhash.xxh3_128_intdigest(key)
    return signed(h >> 64), signed(h & ((1 << 64) - 1))


#: Lets a scan of a bucketed table with one file a bucket keep the files' order.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class LineRuns:
    """The runs on disk, by level. State for adding further batches at any time."""

    def __init__(self, spark: SparkSession, root: str | None = None, fanout: int = FANOUT):
        self.spark, self.root, self.fanout = spark, root or common.fresh_folder(spark, "line-runs"), fanout
        self.buckets, self.name, self.written = common.partitions(spark), f"line_run_{uuid.uuid4().hex[:12]}", 0
        self.levels: list[list[str]] = []

    def path(self, run: str) -> str:
        return f"{self.root}/{run}"

    def _write(self, keys: DataFrame) -> str:
        run, self.written = f"{self.name}_{self.written}", self.written + 1
        kept = self.spark.conf.get(ORDERED)
        self.spark.conf.set(ORDERED, "true")
        try:
            keys.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.path(run)).saveAsTable(run)
        finally:
            self.spark.conf.set(ORDERED, kept)
        return run

    def _push(self, run: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._push(self._write(reduce(self._merged, map(self.spark.table, full))), level + 1)
            for old in full:
                self.spark.sql(f"DROP TABLE {old}")
                common.delete(self.spark, self.path(old))

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """Runs hold different keys, so that their full join is their merge."""
        b = b.withColumnRenamed("doc_id", "other").hint("merge")
        return a.join(b, ["h1", "h2"], "full").select("h1", "h2", F.coalesce("doc_id", "other").alias("doc_id"))

    def drop(self) -> None:
        """Takes the runs off the catalog and the disk."""
        for run in [r for level in self.levels for r in level]:
            self.spark.sql(f"DROP TABLE {run}")
            common.delete(self.spark, self.path(run))
        self.levels = []

    def fresh(self, batch: DataFrame) -> DataFrame:
        """h1, h2, doc_id of the keys of the batch that no run holds."""
        first = batch.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
        for k, run in enumerate(r for level in self.levels for r in level):
            x, y = first.alias("x"), self.spark.table(run).hint("merge").alias(f"y{k}")
            # The runs' ids are below the batch's, always; as doc_id is a condition, the keys are grouped before they are joined.
            same = [F.col(f"x.{c}") == F.col(f"y{k}.{c}") for c in ("h1", "h2")]
            first = x.join(y, [*same, F.col("x.doc_id") > F.col(f"y{k}.doc_id")], "left_anti")
        return first

    def add(self, batch: DataFrame, at: str) -> DataFrame:
        """batch: h1, h2, doc_id (not null), all ids above those of earlier batches. Returns its (h1, h2, doc_id) that
        are to be dropped."""
        run = self._write(self.fresh(batch))
        owners = self.spark.read.schema("h1 long, h2 long, doc_id long").parquet(self.path(run))
        batch.join(owners, ["h1", "h2", "doc_id"], "left_anti").write.parquet(f"{at}/drops")
        self._push(run, 0)
        return self.spark.read.schema("h1 long, h2 long, doc_id long").parquet(f"{at}/drops")


def key_rows(docs: DataFrame, least: int = MIN_POINTS) -> DataFrame:
    """doc_id, h1, h2: each document's different keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, h1, h2 = [], [], []
            for i, text in zip(b.column(0).to_pylist(), common.raw(b.column(1)), strict=True):
                found = {k for line in text.split(b"\n") if (k := line_key(line, least))}
                ids += [i] * len(found)
                h1 += [k[0] for k in found]
                h2 += [k[1] for k in found]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["doc_id", "h1", "h2"])

    return common.in_arrow(docs, work, "doc_id long, h1 long, h2 long")


def dedup_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, least: int = MIN_POINTS) -> DataFrame:
    """docs with text replaced by the kept lines, plus n_lines and n_dropped."""
    spark = docs.sparkSession
    root = common.fresh_folder(spark, "line-dedup")
    ident, own, drop = common.ident(docs), common.unused(docs, "_id"), common.unused(docs, "_drop")
    cuts = common.id_cuts(docs.select(ident.alias("doc_id")), "doc_id", batches)
    keys = key_rows(docs.select(ident.alias("doc_id"), "text"), least)
    keys.withColumn("batch", common.range_number(F.col("doc_id"), cuts)).write.partitionBy("batch").parquet(f"{root}/keys")
    schema = "doc_id long, h1 long, h2 long, batch int"
    all_keys = spark.read.schema(schema).parquet(f"{root}/keys")
    runs = LineRuns(spark, f"{root}/runs", fanout)
    drops = None
    for b in range(len(cuts) + 1):
        found = runs.add(all_keys.filter(F.col("batch") == b).select("h1", "h2", "doc_id"), f"{root}/batch-{b}")
        drops = found if drops is None else drops.unionByName(found)
    common.delete(spark, f"{root}/keys")
    runs.drop()  # the drops are written; a caller that goes on adding batches has LineRuns of its own
    # A document's keys are no more than its own lines.
    per_doc = drops.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias(drop)).withColumnRenamed("doc_id", own)
    joined = docs.withColumn(own, ident).join(per_doc, own, "left").drop(own)
    where = {c: i for i, c in enumerate(joined.columns)}
    out_cols = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            dropped = b.column(where[drop])
            for text, found in zip(common.raw(b.column(where["text"])), dropped.to_pylist(), strict=True):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if found:
                    gone = {(x["h1"], x["h2"]) for x in found}
                    lines = [x for x in lines if line_key(x, least) not in gone]
                texts.append(b"\n".join(lines))
                n_dropped.append(n_lines[-1] - len(lines))
            new = pa.array(texts, pa.binary()).cast(pa.string())
            cols = [new if c == "text" else b.column(where[c]) for c in out_cols]
            yield pa.record_batch([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*out_cols, "n_lines", "n_dropped"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*out_cols).dtypes)
    return common.in_arrow(joined, work, f"{kinds}, n_lines long, n_dropped long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
keyed AS (SELECT doc_id, i, line, length(bare) AS n, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
owners AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE n >= 10 GROUP BY k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (n >= 10 AND owner < doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT (n >= 10 AND owner < doc_id)), '')) AS kept_sha256
FROM keyed LEFT JOIN owners USING (k) GROUP BY doc_id
"""

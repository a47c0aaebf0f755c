"""Person files: CSV or gzipped CSV, all columns text, addressed by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgram.functions import text
from veilgram.plans.lineage import cut

BAD = "_corrupt_record"
QUOTES = {"quote": '"', "escape": '"'}


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings plus ord (whole numbers without gaps: files by path, records as in the file) and _corrupt_record (set
    on short and long rows). Undecodable bytes are dropped. A file is one task, gzipped or not; scan_split() has a task a range."""
    header, schema = _header(spark, path)
    raw = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD, multiLine=True, **QUOTES)
    # A file's records lie in one partition side by side, so their numbers follow each other; files are counted up by path.
    raw = raw.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.monotonically_increasing_id()})
    files = raw.groupBy("_file").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    return _ordered(raw, files, ["_file"], F.col("_row") - F.col("_first"), header)


def scan_split(spark: SparkSession, path: str) -> DataFrame:
    """The same of files that are not gzipped, with a task for each range of a file, though records may hold line breaks in quotes.

    Lines are read by range. A line whose file has an even number of quotes before it begins a record: quotes are counted by
    range, the counts added up over the ranges before, and within a range over the lines before. The records that
    begin in each range are numbered after those of the ranges before, so lines of a record that a border cuts come to one
    number, and are put together; fields are read from each record. Lines end with \\n, or \\r\\n; a quote that nothing closes
    makes one record of the rest of its file, as in scan() (there with the last line's end)."""
    header, schema = _header(spark, path)
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_range"), F.monotonically_increasing_id().alias("_line"), "value"
    )
    blank = F.col("value").isin("", "\r")
    lines = lines.withColumn("_quotes", (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("long"))
    in_file, in_range = Window.partitionBy("_file").orderBy("_range"), Window.partitionBy("_file", "_range").orderBy("_line")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = lines.groupBy("_file", "_range").agg(F.sum("_quotes").alias("_n"))  # a row a range
    ranges = ranges.select("_file", "_range", before("_n", in_file).alias("_quotes_before"))
    outside = (F.col("_quotes_before") + before("_quotes", in_range)) % 2 == 0
    lines = lines.join(ranges, ["_file", "_range"]).withColumn("_outside", outside).filter(~(F.col("_outside") & blank))
    lines = cut(lines.select("_file", "_range", "_line", "value", F.col("_outside").cast("long").alias("_begins")))  # read twice
    starts = lines.groupBy("_file", "_range").agg(F.sum("_begins").alias("_n"))
    files = starts.groupBy("_file").agg((F.sum("_n") - 1).alias("_n"))  # less the header
    starts = starts.select("_file", "_range", before("_n", in_file).alias("_begun"))
    number = F.col("_begun") + F.sum("_begins").over(in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lines = lines.join(starts, ["_file", "_range"]).withColumn("_record", number)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_range", "_line", "value"))), lambda x: x["value"]), "\n")
    records = lines.groupBy("_file", "_record").agg(F.regexp_replace(text, "\r$", "").alias("_text")).filter("_record > 1")
    ddl = ", ".join(f"`{f.name}` string" for f in schema)
    fields = F.from_csv("_text", ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "multiLine": "true", **QUOTES})
    return _ordered(records.withColumn("_fields", fields).select("_file", "_record", "_fields.*"), files, ["_file"], F.col("_record") - 2, header)


def _header(spark: SparkSession, path: str) -> tuple[list[str], T.StructType]:
    header = spark.read.csv(path, header=True, multiLine=True, **QUOTES).columns
    return header, T.StructType([T.StructField(c, T.StringType()) for c in [*header, BAD]])


def _ordered(raw: DataFrame, files: DataFrame, key: list[str], place: F.Column, header: list[str]) -> DataFrame:
    """raw with ord: the records of the files before by path, and a record's place in its own."""
    before = Window.partitionBy().orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)  # over the files, not their records
    files = files.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    clean = [F.regexp_replace(F.col(f"`{c}`"), "\ufffd", "").alias(c) for c in header]
    return raw.join(files, key).select((F.col("_before") + place).alias("ord"), *clean, BAD)


def people(raw: DataFrame, id_col: int, status_col: int, attrs: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """(rec_id, ord, status_code, attr1..) of whole rows, and the quarantined rows."""
    cols = [c for c in raw.columns if c not in ("ord", BAD)]
    if cols[status_col] != "status_code":
        raise ValueError(f"column {status_col} is {cols[status_col]!r}, not 'status_code'")
    at = lambda i: F.col(f"`{cols[i]}`")
    good = raw.filter(F.col(BAD).isNull()).select(at(id_col).alias("rec_id"), "ord", at(status_col).alias("status_code"), *[at(i).alias(f"attr{k + 1}") for k, i in enumerate(attrs)])
    # The reader refuses to read the corrupt-record column alone, as a bare count would; nothing sorts before "".
    read = F.coalesce(at(id_col), F.lit("")) < ""
    return good, raw.filter(F.col(BAD).isNotNull() | read)


def normalised(src: DataFrame, min_len: int = 2) -> DataFrame:
    """Active rows with normalised id and attributes; complete tells whether no attribute is missing."""
    attrs = [c for c in src.columns if c.startswith("attr")]
    out = src.filter(text.is_active(F.col("status_code"))).select(text.normal_id(F.col("rec_id")).alias("rec_id"), "ord", *[text.normal_attr(F.col(a)).alias(a) for a in attrs])
    return out.withColumn("complete", text.is_complete([F.col(a) for a in attrs], min_len))


def qgram_rows(norm: DataFrame, q: int = 2) -> DataFrame:
    """rec_id, ord, qs of the complete rows; a complete row whose values are all shorter than q raises."""
    attrs = [F.col(c) for c in norm.columns if c.startswith("attr")]
    rows = norm.filter("complete").select("rec_id", "ord", text.qgram_set(attrs, q).alias("qs"))
    none = F.raise_error(F.concat(F.lit("no q-gram in record "), F.col("rec_id"))).cast("array<string>")
    return rows.withColumn("qs", F.when(F.size("qs") > 0, F.col("qs")).otherwise(none)) if q > 2 else rows


def missing(norm: DataFrame) -> DataFrame:
    """n_missing, n_active."""
    return norm.agg(F.count_if(~F.col("complete")).alias("n_missing"), F.count("*").alias("n_active"))


def voters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person view of the documents table: its first three words as attributes; English rows are active."""
    first = "^[^a-z]*([a-z]+)" + 2 * "(?:[^a-z]+([a-z]+))?"  # reads no further than the third word
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    word = lambda i: F.regexp_extract("w", first, i).alias(f"attr{i}")
    base = docs.select(F.col("doc_id").alias("rec_id"), F.col("doc_id").alias("ord"), F.when(F.col("lang") == "en", "a").otherwise("i").alias("status_code"), F.lower(F.coalesce("text", F.lit(""))).alias("w"))
    return base.select("rec_id", "ord", "status_code", word(1), word(2), word(3))


__all__ = ["BAD", "missing", "normalised", "people", "qgram_rows", "scan", "voters"]

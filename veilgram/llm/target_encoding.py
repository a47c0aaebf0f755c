"""Time-ordered target encoding: the share of returned lines among earlier lines of other folds that share a value.

A line's history is all lines of other folds sold more than gap microseconds before it. Its values are a chain: of all
history lines; of those that share the value's class (an item's kind, a vendor's nation, a client's segment); of those that share
the value itself. Each rate is smoothed towards the one before: floor((SCALE * s + WEIGHT * p) / (n + WEIGHT)) of n lines, s of
them returned, and p itself where there is none. FIRST is the p of the first.

Plan. Lines are added up by (sale, item, vendor) first, sales by their lines, so that no hot sale meets in one task. Then each
key's rows are added up by (key, fold, microsecond), and a RANGE window ending at -(gap + 1) sums each fold: the sum of all
folds less the own fold's is the history. Keys with a large share of the rows, classes and the whole are dealt by (key,
time bucket): the windows run inside buckets, and what lies before a bucket comes from a second level of windows over bucket totals,
which has further levels while a key has over FAN buckets. Buckets are as wide as hold BUCKET sales if those are spread
evenly; rows of one microsecond are one row a fold, so a rush fills a bucket with its different microseconds only.
Which keys are hot is collected: those with over one in HOT of the rows, so HOT keys at most. Nothing else goes to the driver
but three numbers (first and last time, number of sales), and no table is broadcast but those hot keys (with their classes).
With a gap, bucketed rows look from gap microseconds earlier (a row of no weight is put there), as the window's end may lie in
another bucket.

Defined cases: lines without a sale, and sales without a time, are dropped; a null item or client is the id -1, an ordinary one; a
null vendor is a value of its own; null and unknown classes are one shared class; rows may repeat and count each
time; a class table that repeats an id gives it its smallest class; a sale_id that repeats in sales counts with each of its rows;
empty tables give no rows; other columns are not read."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgram.llm import common

FOLDS, SCALE, WEIGHT, FIRST, NULL_ID = 5, 1_000_000, 50, 500_000, -1
#: Sales a time bucket, buckets a key before a further level, and the largest number of hot keys.
BUCKET, FAN, HOT = 4096, 1024, 16384
#: Stands for a null vendor in keys.
NO_KEY = -(1 << 63)


def divided(a: Column, b: Column) -> Column:
    """Whole-number quotient; of longs, without doubles."""
    return F.call_function("div", a, b)


def rate(n: Column, s: Column, prior: Column) -> Column:
    return F.when(n < 1, prior).otherwise(divided(F.lit(SCALE) * s + F.lit(WEIGHT) * prior, n + F.lit(WEIGHT)))


def bucket_widths(sales: DataFrame, bucket: int = BUCKET, fan: int = FAN) -> list[int]:
    """Microseconds of a bucket of the first level, then the buckets that one of each further level holds."""
    r = sales.agg(F.min("us").alias("a"), F.max("us").alias("b"), F.count("us").alias("n")).first()
    n = max(1, math.ceil(r["n"] / bucket))
    widths = [max(1, math.ceil(((r["b"] or 0) - (r["a"] or 0) + 1) / n))]
    while n > fan:
        widths.append(fan)
        n = math.ceil(n / fan)
    return widths


def bucket(at: Column, width: int) -> Column:
    """Number of the bucket, before 1970 as well."""
    return divided(at - F.pmod(at, F.lit(width)), F.lit(width))


def before(totals: DataFrame, key: list[str], at: str, widths: list[int]) -> DataFrame:
    """totals (key, at, n0.., s0..) with each column's sum over smaller at of the key in its place: windows inside buckets of
    at, and the same of the buckets' totals."""
    cols = [c for c in totals.columns if c not in (*key, at)]
    part, up = key, f"{at}_"
    if widths:
        totals = totals.withColumn(up, bucket(F.col(at), widths[0]))
        part = [*key, up]
    w = Window.partitionBy(*part).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    out = totals.withColumns({c: F.coalesce(F.sum(c).over(w), F.lit(0)) for c in cols})
    if not widths:
        return out
    sums = totals.groupBy(*part).agg(*[F.sum(c).alias(c) for c in cols])
    above = before(sums, key, up, widths[1:]).withColumnsRenamed({c: f"{c}_" for c in cols})
    return out.join(above, part).select(*key, at, *[(F.col(c) + F.col(f"{c}_")).alias(c) for c in cols])


def by_fold(folds: int) -> list[tuple[str, str, int]]:
    return [(f"{c}{i}", c, i) for c in "ns" for i in range(folds)]


def windows(rows: DataFrame, part: list[str], gap: int, folds: int, real: Column) -> DataFrame:
    """rows with n0.., s0..: each fold's sums over the rows more than gap before. One window serves all folds, in one sort."""
    w = Window.partitionBy(*part).orderBy("at").rangeBetween(Window.unboundedPreceding, -(gap + 1))
    return rows.withColumns({x: F.coalesce(F.sum(F.when((F.col("fold") == i) & real, F.col(c))).over(w), F.lit(0)) for x, c, i in by_fold(folds)})


def others(c: str, folds: int) -> Column:
    """The sum of all folds less that of the own fold."""
    sums = [F.col(f"{c}{i}") for i in range(folds)]
    return reduce(lambda x, y: x + y, sums) - F.get(F.array(*sums), F.col("fold"))


def added_up(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key, "fold", "us").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("prior").alias("prior"))


def bucketed(rows: DataFrame, key: list[str], widths: list[int], gap: int = 0, folds: int = FOLDS) -> DataFrame:
    """rows (key, fold, us, n, s, prior), added up by key, fold and time, with hn, hs: for keys of any share of the rows."""
    at = bucket(F.col("us"), widths[0]).alias("b")
    of_fold = [F.sum(F.when(F.col("fold") == i, F.col(c)).otherwise(F.lit(0))).alias(x) for x, c, i in by_fold(folds)]
    totals = rows.select(*key, "fold", at, "n", "s")
    if gap:
        look = bucket(F.col("us") - F.lit(gap), widths[0]).alias("b")
        totals = totals.unionByName(rows.select(*key, "fold", look, F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s")))
    offsets = before(totals.groupBy(*key, "b").agg(*of_fold), key, "b", widths[1:]).withColumnsRenamed({x: f"{x}_" for x, _, _ in by_fold(folds)})
    summed = added_up(rows, key).withColumns({"at": F.col("us"), "real": F.lit(True)})
    if gap:
        summed = summed.unionByName(summed.withColumns({"at": F.col("us") - F.lit(gap), "real": F.lit(False)}))
    inside = windows(summed.withColumn("b", bucket(F.col("at"), widths[0])), ["b", *key], 0, folds, F.col("real")).filter(~F.col("real") if gap else F.lit(True))
    out = inside.join(offsets.hint("shuffle_hash"), ["b", *key]).withColumns({x: F.col(x) + F.col(f"{x}_") for x, _, _ in by_fold(folds)})
    return out.select(*key, "fold", "us", "n", "s", "prior", others("n", folds).alias("hn"), others("s", folds).alias("hs"))


def hot_keys(rows: DataFrame, key: str, total: int, least: int = BUCKET, most: int = HOT) -> DataFrame:
    """Keys with over one in `most` of the rows, and over `least`: fewer than `most` of them."""
    found = rows.groupBy(key).count().filter(F.col("count") > max(least, total // most)).select(key).collect()
    return rows.sparkSession.createDataFrame([(r[0],) for r in found], f"{key} long")


def rates(rows: DataFrame, key: str, classes: DataFrame, widths: list[int], scratch: common.Scratch, gap: int = 0, folds: int = FOLDS, least: int = BUCKET) -> DataFrame:
    """(key, fold, us, n, rate) of rows (key, fold, us, n, s, prior). classes (key, class): a row an id. rows are read several times:
    give a written table."""
    hot = F.broadcast(hot_keys(rows, key, rows.count(), least))
    classes = classes.select(key, F.concat(F.lit("="), F.col("class").cast("string")).alias("class")).groupBy(key).agg(F.min("class").alias("class"))
    # No key of these has many rows, so one exchange by key serves adding up, class join and windows.
    cold = added_up(rows.join(hot, key, "left_anti").repartition(key), [key]).join(classes.hint("shuffle_hash"), key, "left")
    cold = windows(cold.withColumn("at", F.col("us")), [key], gap, folds, F.lit(True)).withColumns({"hn": others("n", folds), "hs": others("s", folds)})
    busy = bucketed(rows.join(hot, key, "left_semi"), [key], widths, gap, folds).join(F.broadcast(classes.join(hot, key, "left_semi")), key, "left")
    names = [key, "fold", "us", "n", "s", "prior", "hn", "hs"]
    own = scratch.store(key, cold.select(*names, "class").unionByName(busy.select(*names, "class")).withColumn("class", F.coalesce("class", F.lit(""))))
    above = bucketed(own.drop("hn", "hs", key), ["class"], widths, gap, folds)
    above = above.select("class", "fold", "us", rate(F.col("hn"), F.col("hs"), F.col("prior")).alias("p"))
    both = own.join(above.hint("merge"), ["us", "fold", "class"])
    return both.select(key, "fold", "us", F.col("hn").alias("n"), rate(F.col("hn"), F.col("hs"), F.col("p")).alias("rate"))


def encoded(sales: DataFrame, lines: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, gap: int = 0, folds: int = FOLDS, bucket_rows: int = BUCKET, fan: int = FAN) -> DataFrame:
    """sale_id, item_id, vendor_id, n_lines, n_returned, and the history's n and rate of item, vendor and client; gap in microseconds."""
    scratch = common.Scratch(sales.sparkSession, "target-encoding")
    back = F.coalesce((F.col("flag") == "returned").cast("long"), F.lit(0))
    lines = lines.filter("sale_id IS NOT NULL").select(F.col("sale_id").cast("long").alias("sale_id"), F.coalesce(F.col("item_id").cast("long"), F.lit(NULL_ID)).alias("item_id"), F.col("vendor_id").cast("long").alias("vendor_id"), back.alias("s"))
    sums = (F.count("*").alias("n"), F.sum("s").alias("s"))
    fold = F.pmod(F.crc32(F.col("sale_id").cast("string").cast("binary")), F.lit(folds)).cast("int")
    sold = sales.filter("sale_id IS NOT NULL AND sold_at IS NOT NULL").select(F.col("sale_id").cast("long").alias("sale_id"), F.coalesce(F.col("client_id").cast("long"), F.lit(NULL_ID)).alias("client_id"), F.unix_micros(F.col("sold_at").cast("timestamp")).alias("us"), fold.alias("fold"))
    widths = bucket_widths(sold, bucket_rows, fan)
    sold = scratch.store("sales", lines.groupBy("sale_id").agg(*sums).join(sold.hint("merge"), "sale_id"))
    whole = bucketed(sold.select("fold", "us", "n", "s", F.lit(FIRST).cast("long").alias("prior")), [], widths, gap, folds)
    whole = whole.select("fold", "us", rate(F.col("hn"), F.col("hs"), F.col("prior")).alias("prior"))
    sold = scratch.store("sales", sold.join(whole.hint("merge"), ["us", "fold"]))
    of_client = rates(sold, "client_id", clients.select(F.col("client_id").cast("long").alias("client_id"), F.col("segment").alias("class")), widths, scratch, gap, folds, bucket_rows)
    sold = sold.join(of_client.select("client_id", "fold", "us", F.col("n").alias("client_n"), F.col("rate").alias("client_rate")).hint("merge"), ["us", "fold", "client_id"])
    rows = lines.groupBy("sale_id", "item_id", "vendor_id").agg(*sums).join(sold.drop("client_id", "n", "s").hint("merge"), "sale_id")
    rows = scratch.store("rows", rows.withColumn("vendor_key", F.coalesce("vendor_id", F.lit(NO_KEY))))
    out = rows.drop("prior")
    for key, name, classes in (
        ("item_id", "item", items.select(F.col("item_id").cast("long").alias("item_id"), F.col("kind").alias("class"))),
        ("vendor_key", "vendor", vendors.select(F.col("vendor_id").cast("long").alias("vendor_key"), F.col("nation_id").alias("class"))),
    ):
        found = rates(rows.select(key, "fold", "us", "n", "s", "prior"), key, classes, widths, scratch, gap, folds, bucket_rows)
        out = out.join(found.select(key, "fold", "us", F.col("n").alias(f"{name}_n"), F.col("rate").alias(f"{name}_rate")).hint("merge"), ["us", "fold", key])
    return out.select("sale_id", "item_id", "vendor_id", F.col("n").alias("n_lines"), F.col("s").alias("n_returned"), "item_n", "item_rate", "vendor_n", "vendor_rate", "client_n", "client_rate")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return encoded(*map(table, ("sales", "sale_lines", "items", "vendors", "clients")))


def _sql() -> str:
    """The same over rows as they are: one pair of windows for each column."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    bits = reduce(lambda x, _: f"(SELECT {step} AS c FROM {x})", range(8), "(SELECT i::BIGINT AS c)")
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(d)::BIGINT FOR d IN string_split(sale_id::VARCHAR, '')]), lambda c, x: xor(c >> 8, table_of[(xor(c, x) & 255) + 1])), 4294967295)"
    past = lambda c, k: f"coalesce(sum({c}) OVER (PARTITION BY {k} ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    hist = ", ".join(f"{past(c, k)} - {past(c, f'{k}, fold')} AS {c}_{name}" for name, k in (("all", "1"), ("kind", "kind"), ("nation", "nation"), ("segment", "segment"), ("item", "item_id"), ("vendor", "vendor_id"), ("client", "client_id")) for c in ("one", "ret"))
    smooth = lambda name, p: f"CASE WHEN one_{name} < 1 THEN {p} ELSE ({SCALE} * ret_{name} + {WEIGHT} * {p}) // (one_{name} + {WEIGHT}) END"
    return f"""
WITH crc AS MATERIALIZED (SELECT list((SELECT c FROM {bits}) ORDER BY i) AS table_of FROM (SELECT unnest(range(256)) AS i)),
l AS (SELECT s.sale_id, coalesce(l.item_id, -1) AS item_id, l.vendor_id, coalesce(s.client_id, -1) AS client_id, epoch_us(s.sold_at) AS us, 1::HUGEINT AS one, CASE WHEN l.flag = 'returned' THEN 1 ELSE 0 END::HUGEINT AS ret
  FROM sale_lines l JOIN sales s ON s.sale_id = l.sale_id WHERE s.sold_at IS NOT NULL),
f AS (SELECT sale_id, {crc} % {FOLDS} AS fold FROM (SELECT DISTINCT sale_id FROM l), crc),
r AS MATERIALIZED (SELECT l.*, f.fold, i.kind, v.nation_id AS nation, c.segment FROM l JOIN f USING (sale_id) LEFT JOIN items i ON i.item_id = l.item_id LEFT JOIN vendors v ON v.vendor_id = l.vendor_id LEFT JOIN clients c ON c.client_id = l.client_id),
h AS (SELECT *, {hist} FROM r),
a AS (SELECT *, {smooth("all", FIRST)} AS p FROM h),
b AS (SELECT *, {smooth("kind", "p")} AS pk, {smooth("nation", "p")} AS pn, {smooth("segment", "p")} AS ps FROM a),
e AS (SELECT *, {smooth("item", "pk")} AS ri, {smooth("vendor", "pn")} AS rv, {smooth("client", "ps")} AS rc FROM b)
SELECT sale_id, item_id, vendor_id, count(*) AS n_lines, sum(ret)::BIGINT AS n_returned, any_value(one_item)::BIGINT AS item_n, any_value(ri)::BIGINT AS item_rate,
  any_value(one_vendor)::BIGINT AS vendor_n, any_value(rv)::BIGINT AS vendor_rate, any_value(one_client)::BIGINT AS client_n, any_value(rc)::BIGINT AS client_rate
FROM e GROUP BY sale_id, item_id, vendor_id"""


SQL = _sql()

"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..n-1 in order of (doc_id, hash of all columns); number i goes to place p(i), a keyed permutation of
0..n-1, and place p is slot p div shards of shard p mod shards. Shard and slot can thus be computed from the
number, the key and n alone, shard sizes differ by one row at most, and slots have no gaps: the law 'rows'.

The permutation works on pairs (x, y) with x < a, y < b and a * b >= n as tight as a square allows: each round adds a
keyed function of one half to the other, modulo its range. Results of n or above walk on along their cycle; less
than a of the a * b values lie there, so a walk ends within a steps.

Plan: one shuffle sorts the rows by range, a table keeps them with their place in their range, and the ranges' sizes (a
row each) make these places numbers. Ranges are cut in (doc_id, hash), so rows of one doc_id or none don't meet in one.

Defined cases: rows without doc_id come after all usual ids, in order of their text's hash; null text is of no bytes; equal
rows are told apart by number only, so the outcome is the same for any order or partitioning of the input (columns of maps
take no part in the hash); empty tables give no rows; more shards than rows leave shards empty; input columns of any
name are kept, but for shard and slot. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgram.llm import common

SHARDS, SEED, ROUNDS, WALK = 40, 2024, 6, 256
#: Prime modulus of the round function; products of two residues fit 64 bits.
PRIME = 2147483647


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """(factor, addend) of each round from a linear congruence of the seed."""
    keys, s = [], seed % PRIME
    for _ in range(2 * rounds):
        s = (s * 48271 + 11) % PRIME
        keys.append(s)
    return [(max(1, a), b) for a, b in zip(keys[::2], keys[1::2], strict=True)]


def sides(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def permute(i: int, n: int, seed: int) -> int:
    """The permutation in plain arithmetic, to compute a row's place anywhere."""
    a, b = sides(n)
    while True:
        x, y = i % a, i // a
        for r, (f, g) in enumerate(round_keys(seed)):
            v = ((y if r % 2 == 0 else x) % PRIME * f + g) % PRIME
            v = v * v % PRIME
            x, y = ((x + v) % a, y) if r % 2 == 0 else (x, (y + v) % b)
        i = y * a + x
        if i < n:
            return i


def place(number: Column, n: int, seed: int) -> Column:
    """Place of a row number, as columns. One pass suits nearly all; the walk is a bounded fold that raises rather
    than return a wrong place (for large n a walk of WALK steps has a chance of n^(-WALK / 2))."""
    steps = min(WALK, sides(n)[0])
    rounds = F.aggregate(
        F.array_repeat(F.lit(0), steps),
        F.struct(number.alias("v"), F.lit(False).alias("done")),
        lambda s, _: F.when(s["done"], s).otherwise(_step(s["v"], n, seed)),
    )
    return F.when(rounds["done"], rounds["v"]).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def _turn(r: int, f: int, g: int, a: int, b: int):
    def turn(s: Column) -> Column:
        w = ((s["y"] if r % 2 == 0 else s["x"]) % PRIME * F.lit(f).cast("long") + g) % PRIME
        w2 = F.transform(F.array(w), lambda z: z * z % PRIME)[0]
        if r % 2 == 0:
            return F.struct(((s["x"] + w2) % a).alias("x"), s["y"].alias("y"))
        return F.struct(s["x"].alias("x"), ((s["y"] + w2) % b).alias("y"))

    return turn


def _step(v: Column, n: int, seed: int) -> Column:
    """Each round's halves become struct fields through one-element arrays, so that they are computed once."""
    a, b = sides(n)
    # (u - u % a) / a is exact in double below 2^53 rows.
    state = F.transform(F.array(v), lambda u: F.struct((u % a).alias("x"), ((u - u % a) / F.lit(a)).cast("long").alias("y")))
    for r, (f, g) in enumerate(round_keys(seed)):
        state = F.transform(state, _turn(r, f, g, a, b))
    return F.transform(F.transform(state, lambda s: s["y"] * a + s["x"]), lambda p: F.struct(p.alias("v"), (p < n).alias("done")))[0]


def numbered(docs: DataFrame, column: str, order: Column) -> tuple[DataFrame, int]:
    """docs with global row numbers in order of (order, hash of all columns), and the row count."""
    spark = docs.sparkSession
    first, tie, at = (common.unused(docs, c) for c in ("_order", "_tie", "_at"))
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = docs.withColumns({first: order, tie: F.xxhash64(*[F.col(f"`{c}`") for c in hashed])})
    ranges = common.partitions(spark)
    rows = rows.repartitionByRange(ranges, first, tie).sortWithinPartitions(first, tie)
    table = common.Scratch(spark, "numbered").put("rows", rows.drop(first, tie).withColumn(at, F.monotonically_increasing_id()), files=1 << 20)  # as many as there are ranges
    part = F.shiftrightunsigned(at, 33).cast("int")
    sizes = {r["p"]: r["n"] for r in table.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row a range
    starts, n = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(n)
        n += sizes.get(p, 0)
    number = F.get(common.longs(starts), part) + F.col(at).bitwiseAND((1 << 33) - 1) if starts else F.lit(0).cast("long")
    return table.withColumn(column, number).drop(at), n


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, order: Column | None = None) -> DataFrame:
    """docs with shard (int) and slot (long); columns of those names are replaced. order: a whole number, else the doc_id."""
    docs = docs.drop("shard", "slot")
    number, at = common.unused(docs, "_number"), common.unused(docs, "_place")
    rows, n = numbered(docs, number, common.ident(docs) if order is None else order)
    rows = rows.withColumn(at, place(F.col(number), n, seed)).drop(number)
    return rows.withColumns({"shard": (F.col(at) % shards).cast("int"), "slot": F.floor(F.col(at) / F.lit(shards)).cast("long")}).drop(at)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = assign_shards(slim)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sql(shards: int = SHARDS, seed: int = SEED) -> str:
    """The same in SQL: the walk is a recursion, and CRC-32 a fold over the bytes with the table of its polynomial."""
    mix = lambda z, f, g: f"(({z} % {PRIME} * {f} + {g}) % {PRIME}) * (({z} % {PRIME} * {f} + {g}) % {PRIME}) % {PRIME}"
    step = "(SELECT i, n, a, b, v % a AS x, v // a AS y FROM walk WHERE v >= n OR NOT begun)"
    for r, (f, g) in enumerate(round_keys(seed)):
        new = f"(x + {mix('y', f, g)}) % a AS x" if r % 2 == 0 else f"(y + {mix('x', f, g)}) % b AS y"
        step = f"(SELECT * REPLACE ({new}) FROM {step})"
    bits = "list_reduce(list_prepend(CAST(c AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]), lambda z, _: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END)"
    return f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
sides AS (SELECT *, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM (SELECT DISTINCT n FROM t)),
walk AS (SELECT i, t.n, a, (t.n + a - 1) // a AS b, i AS v, false AS begun FROM t JOIN sides USING (n)
  UNION ALL SELECT i, n, a, b, y * a + x AS v, true AS begun FROM {step}),
crc AS MATERIALIZED (SELECT list({bits} ORDER BY c) AS table_of FROM (SELECT unnest(range(256)) AS c)),
bytes AS (SELECT i, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bs FROM t)
SELECT doc_id, strlen(text) + 16 AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda c, x: xor(c >> 8, table_of[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32,
  'rows' AS law, CAST(v % {shards} AS INTEGER) AS shard, v // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM walk JOIN t USING (i) JOIN bytes USING (i) CROSS JOIN crc WHERE begun AND v < walk.n"""


SQL = sql()

"""Mixing sources to target weights: iterative proportional fitting over (source, lang, topic) cells, then
sampling by calibrated probabilities. DataFrame functions only.

A document weighs its words, one at least. Cells sum the weights; each round rakes the cell weights to the source,
language and topic targets in turn, until all margins are within TOLERANCE of their targets (or ROUNDS rounds are done:
margins that no weights can meet together never get there; then topic holds exactly and margin_error() tells how far the
others are). A cell's probability is its raked weight over its own, scaled so that the largest is 1: kept tokens then
follow the targets in expectation. A document is kept if a hash of (seed, doc_id) as a number in 0..1 is below it.

Topics are learned from all documents: the TOPICS most widespread words of LENGTH or more characters among those that at
most one document in RARE holds; a document's topic is the one of these it repeats most (ties: the more widespread), or
'(none)'. A column of the input can be named instead.

Targets default to TEMPERATURE: the margins that the cells would have if each weighed the square root of its tokens, so that
weights exist which meet all of them. A table (key, share) for a margin replaces that; keys it lacks get share 0, keys the
data lacks are left out, the rest is normalised.

Plan: one scan counts the documents of each word, one sums the cells, and the last drops what no topic of its source and
language would keep before it looks at the words of the rest. Cells up to CELLS are raked in one task, without a
shuffle; more are raked by shuffles.

Defined cases: null source, lang or topic is the key '(null)'; null or empty text weighs 1; rows without doc_id draw by
hash of their text; equal rows share one fate; an empty table gives no rows; columns topic, tokens and prob in the
input are replaced, all others are returned as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgram.llm import common

ROUNDS, BLOCK, TOLERANCE, SEED, TEMPERATURE, MARGINS = 160, 8, 1e-10, 7, 0.5, ("source", "lang", "topic")
TOPICS, RARE, LENGTH = 12, 20, 4
WORD = r"[^\x20\x09-\x0D]+"
#: Rounds that one query rakes: windows in each other cost the driver memory by their depth.
STEP = 2
#: Cells that one task rakes, at most.
CELLS = 100_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def learned_topics(docs: DataFrame) -> list[str]:
    """TOPICS words, the most widespread first."""
    n = docs.count()
    by_word = docs.select(F.explode(F.array_distinct(words(F.col("text")))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    some = by_word.filter((F.col("df") * RARE <= n) & (F.length("w") >= LENGTH))
    return [r["w"] for r in some.orderBy(F.desc("df"), "w").limit(TOPICS).collect()]  # TOPICS rows


def topic_of(hits: Column, topics: list[str]) -> Column:
    """hits: the document's words that are topics."""
    if not topics:
        return F.lit("(none)")

    def counted(k: int, t: str) -> Column:
        return F.struct(F.size(F.filter(hits, lambda w: w == t)).alias("n"), F.lit(-k).alias("k"), F.lit(t).alias("t"))

    top = F.array_max(F.array(*[counted(k, t) for k, t in enumerate(topics)]))
    # Never null, or a filter for that would be put before the words are split, and split them anew for each topic.
    return F.coalesce(F.when(top["n"] > 0, top["t"]), F.lit("(none)"))


class Keys:
    """The cells' keys as columns of docs, under names that docs doesn't use."""

    def __init__(self, docs: DataFrame, topic: str | None = None):
        self.topic = topic
        self.names = {m: common.unused(docs, f"_{m}") for m in MARGINS}
        self.words, self.hits = common.unused(docs, "_words"), common.unused(docs, "_hits")
        self.topics = None if topic else learned_topics(docs)

    def known(self, docs: DataFrame) -> DataFrame:
        """With the keys that need no text."""
        given = {"source": "source", "lang": "lang"} | ({"topic": self.topic} if self.topic else {})
        return docs.withColumns({self.names[m]: F.coalesce(F.col(c).cast("string"), F.lit("(null)")) for m, c in given.items()})

    def marked(self, docs: DataFrame) -> DataFrame:
        """With all keys and tokens. Words are split once: what is used twice stays a column of its own."""
        rows = self.known(docs).drop("tokens").withColumn(self.words, words(F.col("text")))
        tokens = F.greatest(F.size(self.words), F.lit(1)).cast("long")
        if self.topic:
            return rows.withColumn("tokens", tokens).drop(self.words)
        hits = F.filter(F.col(self.words), lambda w: w.isin(self.topics) if self.topics else F.lit(False))
        rows = rows.withColumns({"tokens": tokens, self.hits: hits}).drop(self.words)
        return rows.withColumn(self.names["topic"], topic_of(F.col(self.hits), self.topics)).drop(self.hits)

    def cells(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*[F.col(self.names[m]).alias(m) for m in MARGINS]).agg(F.sum("tokens").alias("tokens"))


def shares(cell: DataFrame, margin: str, given: DataFrame | None) -> DataFrame:
    """margin key, share: shares of keys that occur, summing to 1."""
    part = cell.groupBy(margin).agg(F.sum(F.pow(F.col("tokens").cast("double"), F.lit(TEMPERATURE))).alias("s"))
    if given is not None:
        part = part.select(margin).join(given.select(F.col("key").alias(margin), F.col("share").alias("s")), margin, "left").select(margin, F.coalesce("s", F.lit(0.0)).alias("s"))
    return part.crossJoin(part.agg(F.sum("s").alias("all"))).select(margin, (F.col("s") / F.col("all")).alias("share"))  # one row


def margin_sum(margin: str) -> Column:
    return F.sum("w").over(Window.partitionBy(margin))


def margin_error(rows: DataFrame) -> float:
    """The largest difference of a margin's sum from its share."""
    off = rows.select(F.greatest(*[F.abs(margin_sum(m) - F.col(f"share_{m}")) for m in MARGINS]).alias("off"))
    return off.agg(F.coalesce(F.max("off"), F.lit(0.0)).alias("off")).first()["off"]


def raked(cell: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """source, lang, topic, tokens, share of each margin, w: w sums to 1. Each STEP rounds (BLOCK, by shuffles) are one job
    whose cells are written, and each BLOCK rounds the margins are looked at; one partition needs no shuffle for its margins' sums."""
    scratch = common.Scratch(cell.sparkSession, "raking")
    cell = scratch.put("cells", cell)
    rows = cell.withColumn("w", F.col("tokens").cast("double"))
    for m in MARGINS:
        rows = rows.join(shares(cell, m, (targets or {}).get(m)).withColumnRenamed("share", f"share_{m}"), m)
    few = cell.count() <= CELLS
    rows = scratch.put("rows", rows, 1 if few else None)
    size = STEP if few else BLOCK
    for done in range(0, rounds, BLOCK):
        for at in range(done, min(done + BLOCK, rounds), size):
            step, rest = "{rows}", "source, lang, topic, tokens, " + ", ".join(f"share_{m}" for m in MARGINS)
            for _ in range(min(size, done + BLOCK - at, rounds - at)):
                for m in MARGINS:
                    step = f"(SELECT {rest}, coalesce(w * share_{m} / nullif(sum(w) OVER (PARTITION BY {m}), 0), 0) AS w FROM {step})"
            rows = scratch.put("rows", cell.sparkSession.sql(f"SELECT * FROM {step}", rows=rows.coalesce(1) if few else rows), 1 if few else None)
        if margin_error(rows.coalesce(1) if few else rows) <= tolerance:
            break
    scratch.drop("cells")
    return rows


def probabilities(cell: DataFrame) -> DataFrame:
    ratio = cell.withColumn("_r", F.col("w") / F.col("tokens"))
    top = ratio.agg(F.max("_r").alias("_top"))  # one row
    return ratio.crossJoin(top).select(*MARGINS, (F.col("_r") / F.col("_top")).alias("prob"))


def lot(ident: Column, seed: int = SEED) -> Column:
    text = F.concat(F.lit(f"{seed}|"), ident.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, seed: int = SEED, topic: str | None = None) -> DataFrame:
    """The kept rows of docs with tokens, topic and prob. topic: a column of docs, else topics are learned."""
    keys = Keys(docs, topic)
    scratch = common.Scratch(docs.sparkSession, "mixing")
    own, most = common.unused(docs, "_lot"), common.unused(docs, "_most")
    prob = scratch.put("prob", probabilities(raked(keys.cells(keys.marked(docs)), targets, rounds)).withColumnsRenamed(keys.names))
    known = [keys.names[m] for m in (MARGINS if topic else MARGINS[:2])]
    bound = prob.groupBy(*known).agg(F.max("prob").alias(most))
    rows = keys.known(docs).withColumn(own, lot(common.ident(docs), seed)).join(bound, known).filter(F.col(own) < F.col(most))
    rows = keys.marked(rows.drop("prob", most)).join(prob, list(keys.names.values())).filter(F.col(own) < F.col("prob"))
    rest = [c for c in docs.columns if c not in ("topic", "tokens", "prob")]
    return rows.select(*rest, "tokens", F.col(keys.names["topic"]).alias("topic"), "prob")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs).select("doc_id", "source", "lang", "topic", "tokens", F.round(F.col("prob") * 1e6).cast("long").alias("prob_ppm"))


def sql(rounds: int = ROUNDS) -> str:
    word = WORD
    want = ", ".join(f"want_{k} AS MATERIALIZED (SELECT {k}, p / sum(p) OVER () AS share_{k} FROM (SELECT {k}, sum(pow(tokens, {TEMPERATURE})) AS p FROM c GROUP BY {k}))" for k in ("s", "l", "topic"))
    step = "r"
    for k in ("s", "l", "topic"):
        step = f"(SELECT * REPLACE (w * share_{k} / sum(w) OVER (PARTITION BY {k}) AS w) FROM {step})"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, lang, coalesce(source, '(null)') AS s, coalesce(lang, '(null)') AS l, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents),
df AS (SELECT w, count(*) AS n FROM (SELECT unnest(list_distinct(ws)) AS w FROM d) GROUP BY w),
names AS MATERIALIZED (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS k FROM df WHERE n * {RARE} <= (SELECT count(*) FROM d) AND length(w) >= {LENGTH} ORDER BY k LIMIT {TOPICS}),
held AS (SELECT doc_id, w, k, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) JOIN names USING (w) GROUP BY ALL),
best AS (SELECT doc_id, w FROM held QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k) = 1),
m AS MATERIALIZED (SELECT doc_id, source, lang, s, l, greatest(len(ws), 1) AS tokens, coalesce(w, '(none)') AS topic FROM d LEFT JOIN best USING (doc_id)),
c AS MATERIALIZED (SELECT s, l, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM m GROUP BY ALL),
{want},
r AS (SELECT 0 AS i, s, l, topic, tokens, share_s, share_l, share_topic, tokens AS w FROM c JOIN want_s USING (s) JOIN want_l USING (l) JOIN want_topic USING (topic)
  UNION ALL SELECT i + 1, s, l, topic, tokens, share_s, share_l, share_topic, w FROM {step} WHERE i < {rounds}),
p AS (SELECT s, l, topic, (w / tokens) / max(w / tokens) OVER () AS prob FROM r WHERE i = {rounds})
SELECT doc_id, source, lang, topic, tokens, CAST(round(prob * 1e6) AS BIGINT) AS prob_ppm FROM m JOIN p USING (s, l, topic)
WHERE ('0x' || substr(md5('{SEED}|' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE < prob"""


SQL = sql()

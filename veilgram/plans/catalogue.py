"""The registered queries over the voters view; oracles.py has the SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgram.config import LinkConfig
from veilgram.functions import similarity as sim
from veilgram.functions.hashing import IndexedDigest, SeededTwister
from veilgram.operators import dedupe, encode, evaluate, match, pairs, select, stats
from veilgram.plans import lineage
from veilgram.plans.lineage import fresh_folder
from veilgram.plans.linkage import Linkage
from veilgram.plans.sampling import Sampling, voters
from veilgram.sources import people, samples

BF_LEN, PROB, METHOD, SEED, SALT = 256, 0.1, "ala", 42, "pepper"


def joined(c: str = "qs") -> F.Column:
    return F.array_join(F.col(c).cast("array<string>"), "|")


def linkage(spark: SparkSession, d: str, method: str = METHOD, noise: str = "md5", ratio: float = 1.0, made: Sampling | None = None) -> Linkage:
    return Linkage((made or voters(spark, d)).sample, LinkConfig(bf_len=BF_LEN, k_ratio=ratio, flip_method=method, flip_prob=PROB, seed=SEED), noise)


def trigrams(s: SparkSession, d: str) -> DataFrame:
    """Sets for q = 3; values that are shorter count as missing, so that no record is without grams."""
    norm = people.normalised(people.voters(s, d), min_len=3)
    return people.qgram_rows(norm, 3).select("rec_id", joined().alias("qs"))


def rec_upsert(s: SparkSession, d: str) -> DataFrame:
    """Ids are folded onto fewer, so that sets of an id do replace each other."""
    rows = voters(s, d).qgrams.withColumn("rec_id", (F.col("ord") % 101).cast("string"))
    return dedupe.upsert(dedupe.distinct_sets(rows)).select("rec_id", "ord", joined().alias("qs"), "n_replaced")


def subset(code: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: voters(s, d).subsets[code].select("rec_id", "ord", "type")


def people_file(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Whole and quarantined rows of the voters written as CSV text and scanned; every seventh row lacks its last two fields."""
    path = fresh_folder(s, "people")
    rows = people.voters(s, d)
    fields = [F.col(c).cast("string") for c in ("rec_id", "attr1", "attr2", "attr3", "status_code")]
    line = F.when(F.col("ord") % 7 == 0, F.concat_ws(",", *fields[:3])).otherwise(F.concat_ws(",", *fields))
    # The first row of each partition (its number in the low 33 bits is 0) brings its file's header.
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    header = F.lit("id,first,second,third,status_code\n")
    rows.select(F.concat(F.when(first, header).otherwise(""), line)).write.text(path)
    return people.people(people.scan(s, path), 0, 4, [1, 2, 3])


def people_csv(s: SparkSession, d: str) -> DataFrame:
    return people.normalised(people_file(s, d)[0]).select("rec_id", "attr1", "attr2", "attr3", "complete")


def people_quarantined(s: SparkSession, d: str) -> DataFrame:
    return people_file(s, d)[1].select(F.trim(F.regexp_replace(people.BAD, "[\r\n]", "")).alias("line"))


def people_ordered(scan: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """Numbers of records in several files, of which the first by path is the smallest; second words hold a line break and quotes."""

    def run(s: SparkSession, d: str) -> DataFrame:
        path = fresh_folder(s, "people")
        rows = people.voters(s, d).select(F.col("rec_id").alias("id"), F.concat("attr1", F.lit('\n"'), "attr2").alias("words"), "status_code", (F.col("ord") % 10 != 0).cast("int").alias("k"), "ord")
        rows = rows.repartitionByRange("ord").sortWithinPartitions("k", "ord").drop("ord")
        # Unless told otherwise the writer trims values: a break before an empty first word would go.
        rows.write.partitionBy("k").csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **people.QUOTES)
        found = scan(s, f"{path}/*")
        return found.select(F.col("id").alias("rec_id"), "ord", F.replace("words", F.lit("\n"), F.lit("/")).alias("words"), "status_code")

    return run


def sample_file(write: Callable, read: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """The typed sample written, read back and checked for its sizes."""

    def run(s: SparkSession, d: str) -> DataFrame:
        made, path = voters(s, d), fresh_folder(s, "sample")
        write(made.sample, path)
        rows = read(s, path)
        evaluate.validate(rows, made.cfg.n_subset, made.cfg.n_base)
        return rows.select("rec_id", "type", joined().alias("qs"))

    return run


def match_no_noise(s: SparkSession, d: str) -> DataFrame:
    cfg = LinkConfig(bf_len=BF_LEN, flip_method=METHOD, flip_prob=0.0, seed=SEED)
    return result(Linkage(voters(s, d).sample, cfg).noisy)


def set_similarity(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """f of the shared grams and both sizes, for record pairs that share their first gram."""

    def run(s: SparkSession, d: str) -> DataFrame:
        made = voters(s, d)
        n = made.ranks.count()
        rows = made.records.select("rec_id", "ord", F.col("qs")[0].alias("k"), F.size("qs").alias("n")).join(pairs.gram_bits(made.records, made.ranks, n), "rec_id")
        rows, words = pairs.spread(rows, "bits", encode.n_words(n))
        return pairs.within(lineage.cut(rows), "k", lambda a, b: f(sim.bits_and(words(a), words(b), encode.n_words(n)), a("n"), b("n")), size="n")

    return run


def bf_similarity(what: str) -> Callable[[SparkSession, str], DataFrame]:
    """Record pairs that share their first gram, both of them encoded: filters go with the records, not to their pairs."""

    def run(s: SparkSession, d: str) -> DataFrame:
        made, n = voters(s, d), encode.n_words(BF_LEN)
        rows = made.records.select("rec_id", "ord", F.col("qs")[0].alias("k")).join(linkage(s, d, made=made).bfs.select("rec_id", "words", "n1"), "rec_id")
        rows, words = pairs.spread(rows, "words", n)
        value = {
            "dice": lambda a, b: sim.dice(sim.bits_and(words(a), words(b), n), a("n1"), b("n1")),
            "hamming": lambda a, b: sim.hamming(sim.bits_xor(words(a), words(b), n), BF_LEN),
            "jaccard": lambda a, b: sim.clamped_jaccard(sim.bits_xor(words(a), words(b), n), BF_LEN),
        }[what]
        return pairs.within(lineage.cut(rows), "k", value, size="n1")

    return run


def blip(method: str, by_word: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        link = linkage(s, d, method)
        h = link.hardened_by_word if by_word else link.hardened
        total = F.aggregate("pos", F.lit(0).cast("bigint"), lambda a, p: a + p)
        return h.select("type", "side", "rec_id", F.col("n1").alias("n_set"), total.alias("pos_sum"))

    return run


def result(found: DataFrame) -> DataFrame:
    return found.select("type", "probe_id", "best", F.col("ties").cast("bigint").alias("ties"), F.col("hit").cast("int").alias("hit"), "outcome")


def means(s: SparkSession, d: str) -> DataFrame:
    return stats.means(voters(s, d).profile)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "voters_normalised": lambda s, d: voters(s, d).normalised.select("rec_id", "attr1", "attr2", "attr3", "complete"),
    "missing_values": lambda s, d: people.missing(voters(s, d).normalised),
    "qgram_sets": lambda s, d: voters(s, d).qgrams.select("rec_id", joined().alias("qs"), F.size("qs").alias("n_grams")),
    "qgram_dedupe": lambda s, d: dedupe.distinct_sets(voters(s, d).qgrams).select("rec_id", "ord", joined().alias("qs")),
    "rec_upsert": rec_upsert,
    "qgram_df": lambda s, d: stats.frequencies(voters(s, d).records),
    "qgram_rank": lambda s, d: voters(s, d).ranks,
    "record_scores": lambda s, d: voters(s, d).profile.select("rec_id", "sum_df", "n_grams", "score"),
    "mean_profile": means,
    **{f"subset_{c}": subset(c) for c in ("l_s", "l_h", "l_a", "f_h", "f_l", "f_a", "q_f", "q_r", "q_a")},
    "subset_overlap": lambda s, d: select.overlaps(voters(s, d).nine),
    "random_subsets": lambda s, d: voters(s, d).random_and_base.filter("type <> 'b'"),
    "base_sample": lambda s, d: voters(s, d).random_and_base.filter("type = 'b'"),
    "all_subsets": lambda s, d: evaluate.type_counts(voters(s, d).typed),
    "multi_type_counts": lambda s, d: evaluate.multi_type_counts(voters(s, d).nine.withColumn("ord", F.col("type"))),
    "k_opt": lambda s, d: stats.optimal_hash_count(voters(s, d).sample, BF_LEN),
    "bf_positions": lambda s, d: linkage(s, d).bfs.select("rec_id", F.array_join(encode.positions(F.col("words"), BF_LEN).cast("array<string>"), "|").alias("pos")),
    **{f"bf_popcount_{name}": lambda s, d, r=ratio: linkage(s, d, ratio=r).bfs.select("rec_id", F.col("n1").alias("n_set")) for name, ratio in (("half", 0.5), ("double", 2.0))},
    **{f"match_clean_{name}": lambda s, d, r=ratio: result(linkage(s, d, ratio=r).clean) for name, ratio in (("half", 0.5), ("double", 2.0))},
    "bf_popcount": lambda s, d: linkage(s, d).bfs.select("rec_id", sim.popcount(F.col("words"), encode.n_words(BF_LEN)).cast("int").alias("n_set")),
    "bf_position_table": lambda s, d: encode.vocabulary(voters(s, d).records, BF_LEN, 10).select("q", joined("pos").alias("pos")),
    "bf_salted_table": lambda s, d: encode.vocabulary(voters(s, d).records, BF_LEN, 10, IndexedDigest(SALT)).select("q", joined("pos").alias("pos")),
    "bf_mt19937": lambda s, d: encode.vocabulary(voters(s, d).records, BF_LEN, 10, SeededTwister()).select("q", joined("pos").alias("pos")),
    "bf_mt19937_sha1": lambda s, d: encode.vocabulary(voters(s, d).records, BF_LEN, 10, SeededTwister("sha1", SALT)).select("q", joined("pos").alias("pos")),
    "trigram_sets": trigrams,
    "qgram_dice": set_similarity(sim.dice),
    "qgram_jaccard": set_similarity(sim.set_jaccard),
    "qgram_hamming": set_similarity(sim.set_hamming),
    "bf_dice": bf_similarity("dice"),
    "bf_hamming": bf_similarity("hamming"),
    "bf_jaccard": bf_similarity("jaccard"),
    "blip_ala": blip("ala"),
    "blip_sch": blip("sch"),
    "blip_words_ala": blip("ala", by_word=True),
    "blip_words_sch": blip("sch", by_word=True),
    "match_clean": lambda s, d: result(linkage(s, d).clean),
    "match_noisy": lambda s, d: result(linkage(s, d).noisy),
    "match_noisy_philox": lambda s, d: result(linkage(s, d, noise="philox").noisy),
    "match_pruned": lambda s, d: result(match.block_product(*linkage(s, d).sides_once, BF_LEN)),
    "match_top5": lambda s, d: linkage(s, d).diagnostics(),
    "match_no_noise": match_no_noise,
    "people_csv": people_csv,
    "people_quarantined": people_quarantined,
    "people_ordered": people_ordered(people.scan),
    "people_ordered_split": people_ordered(people.scan_split),
    "sample_csv": sample_file(samples.write_csv, samples.read_csv),
    "sample_parquet": sample_file(samples.write, samples.read),
    "linkage_report": lambda s, d: linkage(s, d).tally,
    "linkage_report_text": lambda s, d: match.to_report(linkage(s, d, noise="philox").tally),
}


"""DuckDB SQL for the registered queries, written from the definitions (loops and brute force where they are)."""

from __future__ import annotations

from itertools import product
from string import ascii_lowercase

from veilgram.config import OUTCOMES, SUBSET_TYPES
from veilgram.functions import random_words
from veilgram.functions.hashing import SeededTwister
from veilgram.plans.catalogue import BF_LEN, PROB, SALT, SEED

STEPS = {
    "words": "SELECT doc_id AS ord, lang, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM documents",
    "voters": "SELECT CAST(ord AS VARCHAR) AS rec_id, ord, CASE WHEN lang = 'en' THEN 'a' ELSE 'i' END AS status_code, coalesce(w[1], '') AS attr1, coalesce(w[2], '') AS attr2, coalesce(w[3], '') AS attr3 FROM words",
    "norm": "SELECT rec_id, ord, attr1, attr2, attr3, length(attr1) >= 2 AND length(attr2) >= 2 AND length(attr3) >= 2 AS complete FROM voters WHERE status_code = 'a'",
    "grams": "SELECT DISTINCT rec_id, ord, v[i:i+1] AS q FROM (SELECT rec_id, ord, v, unnest(range(1, length(v))) AS i FROM (SELECT rec_id, ord, unnest([attr1, attr2, attr3]) AS v FROM norm WHERE complete))",
    "sets": "SELECT rec_id, ord, list_sort(list(q)) AS qs FROM grams GROUP BY ALL",
    "recs": "SELECT rec_id, ord, qs FROM sets QUALIFY row_number() OVER (PARTITION BY qs ORDER BY ord) = 1",
    "rq": "SELECT rec_id, ord, unnest(qs) AS q FROM recs",
    "freq": "SELECT q, count(*) AS df FROM rq GROUP BY q",
    "ranks": "SELECT q, df, row_number() OVER (ORDER BY df DESC, q) - 1 AS rank, count(*) OVER () - row_number() OVER (ORDER BY df DESC, q) AS revrank, abs(df - CAST(sum(df) OVER () // count(*) OVER () AS BIGINT)) AS absdiff FROM freq",
    "prof": "SELECT rec_id, ord, count(*) AS n_grams, CAST(sum(df) AS BIGINT) AS sum_df, min(rank) AS rank, min(revrank) AS revrank, min(revrank) FILTER (revrank > 0) AS rest, min(absdiff) AS absdiff, CAST(sum(df) AS DOUBLE) / count(*) AS score FROM rq JOIN ranks USING (q) GROUP BY ALL",
    "mean": "SELECT avg(n_grams) AS mean_len, CAST(sum((sum_df * 1000000) // n_grams) AS DOUBLE) / count(*) / 1e6::DOUBLE AS mean_score FROM prof",
    "n": "SELECT greatest(3, count(*) // 38) AS s, count(*) // 2 AS b FROM recs",
}
KEYS = {
    "f_h": "-score", "f_l": "score", "f_a": "abs(score - mean_score)", "q_f": "rank", "q_a": "absdiff",
    "l_s": "n_grams", "l_h": "-n_grams", "l_a": "abs(n_grams - mean_len)",
}
for code, key in KEYS.items():
    STEPS[code] = f"SELECT rec_id, ord, '{code}' AS type FROM prof, mean ORDER BY {key}, ord LIMIT (SELECT s FROM n)"
STEPS["taken"] = "SELECT rec_id FROM prof WHERE rank = 0 ORDER BY ord LIMIT (SELECT s FROM n)"
STEPS["q_r"] = "SELECT rec_id, ord, 'q_r' AS type FROM (SELECT rec_id, ord, CASE WHEN rec_id IN (SELECT rec_id FROM taken) THEN rest ELSE revrank END AS k FROM prof) WHERE k IS NOT NULL ORDER BY k, ord LIMIT (SELECT s FROM n)"
STEPS["nine"] = " UNION ALL ".join(f"SELECT * FROM {c}" for c in (*KEYS, "q_r"))
STEPS["shuffled"] = f"SELECT rec_id, ord, row_number() OVER (ORDER BY md5('{SEED}|rnd|' || rec_id), ord) - 1 AS pos FROM recs WHERE rec_id NOT IN (SELECT rec_id FROM nine)"
STEPS["rnd"] = "SELECT rec_id, ord, CASE WHEN pos < s THEN 'r1' WHEN pos < 2 * s THEN 'r2' WHEN pos < 3 * s THEN 'r3' ELSE 'b' END AS type FROM shuffled, n WHERE pos < 3 * s + b"
STEPS["typed"] = "SELECT rec_id, ord, type FROM nine UNION ALL SELECT rec_id, ord, type FROM rnd"
STEPS["k"] = f"SELECT CAST(floor({BF_LEN}::DOUBLE / avg(len(qs)) * ln(2.0::DOUBLE)) AS INTEGER) AS k_opt FROM typed JOIN recs USING (rec_id)"


def vocab(k: str, source: str = "(SELECT DISTINCT q FROM rq)", salt: str = "") -> str:
    return f"SELECT q, list_sort(list(DISTINCT p)) AS pos FROM (SELECT q, CAST(('0x' || substr(md5(q || '{salt}|' || CAST(i AS VARCHAR)), 1, 8))::BIGINT % {BF_LEN} AS INTEGER) AS p FROM {source}, (SELECT unnest(range(0, {k})) AS i)) GROUP BY q"


STEPS["sampled"] = "SELECT DISTINCT rec_id FROM typed"
for name, ratio in (("", 1.0), ("_half", 0.5), ("_double", 2.0)):
    STEPS[f"voc{name}"] = vocab(f"(SELECT CAST(floor({ratio} * k_opt) AS INTEGER) FROM k)")
    STEPS[f"bfs{name}"] = f"SELECT rec_id, list_sort(list(DISTINCT p)) AS pos FROM (SELECT rec_id, unnest(pos) AS p FROM rq JOIN sampled USING (rec_id) JOIN voc{name} USING (q)) GROUP BY rec_id"
STEPS["codes"] = "SELECT unnest([" + ", ".join(f"'{t}'" for t in SUBSET_TYPES) + "]) AS type"
for name in ("", "_half", "_double"):
    STEPS[f"side{name}"] = (
        f"SELECT type, 'p' AS side, rec_id, pos FROM typed JOIN bfs{name} USING (rec_id) WHERE type <> 'b' UNION ALL SELECT type, 'c', rec_id, pos FROM typed JOIN bfs{name} USING (rec_id) WHERE type <> 'b' "
        f"UNION ALL SELECT codes.type, 'c', rec_id, pos FROM typed JOIN bfs{name} USING (rec_id), codes WHERE typed.type = 'b'"
    )
STEPS["pairs"] = "SELECT a.rec_id AS a_id, b.rec_id AS b_id, a.qs AS aq, b.qs AS bq FROM recs a JOIN recs b ON a.qs[1] = b.qs[1] AND a.ord < b.ord"
SIM = "len(list_intersect(aq, bq))"
UNION = f"(len(aq) + len(bq) - {SIM})"


def unit(what: str) -> str:
    return f"CAST(('0x' || substr(md5('{SEED}|' || type || '|' || side || '|' || rec_id || '|' || CAST(i AS VARCHAR) || '|{what}'), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0::DOUBLE"


def noised(method: str) -> str:
    hit, here = f"{unit('u')} <= {PROB}::DOUBLE", "list_contains(pos, i)"
    on = f"{here} <> ({hit})" if method == "ala" else f"CASE WHEN {hit} THEN {unit('c')} >= 0.5 ELSE {here} END"
    return f"SELECT type, side, rec_id, coalesce(list_sort(list(i) FILTER ({on})), []) AS pos FROM side, (SELECT CAST(unnest(range(0, {BF_LEN})) AS INTEGER) AS i) GROUP BY type, side, rec_id"


def dice(a: str, b: str) -> str:
    return f"2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b}))"


def matched(source: str) -> str:
    pairs = f"SELECT p.type, p.rec_id AS probe_id, c.rec_id AS cand_id, {dice('p.pos', 'c.pos')} AS sim FROM {source} p JOIN {source} c ON p.type = c.type AND p.side = 'p' AND c.side = 'c'"
    best = f"SELECT type, probe_id, sim AS best, count(*) AS ties, max(CASE WHEN cand_id = probe_id THEN 1 ELSE 0 END) AS hit FROM ({pairs} QUALIFY rank() OVER (PARTITION BY p.type, probe_id ORDER BY sim DESC) = 1) GROUP BY ALL"
    return f"SELECT type, probe_id, best, ties, hit, CASE WHEN ties = 1 AND hit = 1 THEN '1-1-correct' WHEN ties = 1 THEN '1-1-wrong' WHEN hit = 1 THEN '1-n-correct' ELSE '1-n-wrong' END AS outcome FROM ({best})"


STEPS["noised_ala"], STEPS["noised_sch"] = noised("ala"), noised("sch")
ALL = (1 << 64) - 1
FULL = -(-BF_LEN // 64)
STEPS["side_words"] = (
    f"SELECT type, side, rec_id, w, coalesce((SELECT bit_or(1::UBIGINT << (p % 64)) FROM (SELECT unnest(pos) AS p) WHERE p // 64 = w), 0::UBIGINT) AS x FROM side, (SELECT CAST(unnest(range(0, {FULL})) AS INTEGER) AS w)"
)


def flipped(method: str, hit: str, coin: str) -> str:
    """A word x after noise."""
    return f"xor(x, {hit})" if method == "ala" else f"(x & xor({hit}, {ALL}::UBIGINT)) | ({coin} & {hit})"


def biased(drawn) -> str:
    """A word of bits that are 1 with probability PROB, from random words drawn(digit): ORs and ANDs by PROB's binary digits."""
    hit = "0::UBIGINT"
    for i, one in reversed(list(enumerate(random_words.digits(PROB)))):
        hit = f"({hit} {'|' if one else '&'} {drawn(i)})"
    return hit


def bits_of(source: str, columns: str) -> str:
    """Sorted positions of the set bits of noised words."""
    return f"SELECT {columns}, list_sort(flatten(list([CAST(64 * w + b AS INTEGER) FOR b IN range(64) IF (noised >> b) & 1 = 1]))) AS pos FROM ({source}) GROUP BY ALL"


def by_digest(method: str) -> str:
    drawn = lambda what: f"CAST('0x' || substr(md5('{SEED}|' || type || '|' || side || '|' || rec_id || '|' || CAST(w AS VARCHAR) || '|{what}'), 1, 16) AS UBIGINT)"
    return bits_of(f"SELECT type, side, rec_id, w, {flipped(method, biased(drawn), drawn('c'))} AS noised FROM side_words", "type, side, rec_id")


def by_philox(method: str) -> str:
    """Blocks of four words for each digit and four words of a filter, the rounds one after the other."""
    wide, low = "::UHUGEINT", f"{ALL}::UHUGEINT"
    start = "SELECT type, side, rec_id, lane, digit, g, digit::UBIGINT AS a, g::UBIGINT AS b, lane::UBIGINT AS c, 0::UBIGINT AS d, k0, k1 FROM keys, draws"
    rows = start
    for r in range(random_words.ROUNDS):
        key = [f"(((k{i}{wide} + {step * r % (1 << 64)}{wide}) & {low})::UBIGINT)" for i, step in enumerate(random_words.STEPS)]
        p, q = (f"({x}{wide} * {m}{wide})" for x, m in zip("ac", random_words.MULTIPLIERS, strict=True))
        top, bottom = (lambda x: f"(({x} >> 64)::UBIGINT)"), (lambda x: f"(({x} & {low})::UBIGINT)")
        rows = f"SELECT * REPLACE (xor(xor({top(q)}, b), {key[0]}) AS a, {bottom(q)} AS b, xor(xor({top(p)}, d), {key[1]}) AS c, {bottom(p)} AS d) FROM ({rows})"
    n = len(random_words.digits(PROB))
    words = f"SELECT type, side, rec_id, lane, digit, CAST(4 * g + t AS INTEGER) AS w, [a, b, c, d][t + 1] AS r FROM ({rows}), (SELECT unnest(range(4)) AS t) WHERE 4 * g + t < {FULL}"
    listed = f"SELECT type, side, rec_id, w, list(r ORDER BY digit) FILTER (lane = 0) AS hits, any_value(r) FILTER (lane = 1) AS coin FROM ({words}) GROUP BY ALL"
    noised = f"SELECT type, side, rec_id, w, {flipped(method, biased(lambda i: f'hits[{i + 1}]'), 'coin')} AS noised FROM ({listed}) JOIN side_words USING (type, side, rec_id, w)"
    return (
        f"WITH keys AS (SELECT type, side, rec_id, CAST('0x' || substr(h, 1, 16) AS UBIGINT) AS k0, CAST('0x' || substr(h, 17, 16) AS UBIGINT) AS k1 FROM (SELECT type, side, rec_id, md5('{SEED}|' || type || '|' || side || '|' || rec_id) AS h FROM side)), "
        f"draws AS (SELECT lane, digit, g FROM (SELECT 0 AS lane, unnest(range({n})) AS digit UNION ALL SELECT 1, 0), (SELECT unnest(range({-(-FULL // 4)})) AS g)) " + bits_of(noised, "type, side, rec_id")
    )


STEPS["words_ala"], STEPS["words_sch"], STEPS["philox_ala"] = by_digest("ala"), by_digest("sch"), by_philox("ala")
STEPS["philox_m"] = matched("philox_ala")
STEPS["clean_half"], STEPS["clean_double"] = matched("side_half"), matched("side_double")
STEPS["clean_m"], STEPS["noisy_m"] = matched("side"), matched("noised_ala")
BF_PAIRS = "SELECT a_id, b_id, x.pos AS aq, y.pos AS bq FROM pairs JOIN bfs x ON x.rec_id = a_id JOIN bfs y ON y.rec_id = b_id"
def twister_table(family: SeededTwister) -> str:
    """Positions of all pairs of letters by the standard library's generator."""
    rows = (f"('{q}', {sorted(set(family.draws(q, BF_LEN, 10)))})" for q in map("".join, product(ascii_lowercase, repeat=2)))
    return f"SELECT q, array_to_string(pos, '|') AS pos FROM (SELECT DISTINCT q FROM rq) JOIN (VALUES {', '.join(rows)}) m(q, pos) USING (q)"


TEXT = "array_to_string(pos, '|') AS pos"
def report_text() -> str:
    metrics = ("og_bf_dice", "blip_bf_dice")
    cell = lambda m: f"'{{' || string_agg(chr(39) || outcome || chr(39) || ': ' || n, ', ' ORDER BY outcome) FILTER (metric = '{m}') || '}}' AS {m}"
    every = "SELECT type, metric, outcome FROM codes, (SELECT unnest(['og_bf_dice', 'blip_bf_dice']) AS metric), (SELECT unnest([" + ", ".join(f"'{o}'" for o in OUTCOMES) + "]) AS outcome)"
    found = "SELECT type, metric, outcome, count(*) AS n FROM (SELECT *, 'og_bf_dice' AS metric FROM clean_m UNION ALL SELECT *, 'blip_bf_dice' FROM philox_m) GROUP BY ALL"
    return f"SELECT type AS id, {', '.join(map(cell, metrics))} FROM (SELECT type, metric, outcome, coalesce(n, 0) AS n FROM ({every}) LEFT JOIN ({found}) USING (type, metric, outcome)) GROUP BY type"


FINAL = {
    "voters_normalised": "SELECT rec_id, attr1, attr2, attr3, complete FROM norm",
    "missing_values": "SELECT count(*) FILTER (NOT complete) AS n_missing, count(*) AS n_active FROM norm",
    "qgram_sets": "SELECT rec_id, array_to_string(qs, '|') AS qs, CAST(len(qs) AS INTEGER) AS n_grams FROM sets",
    "qgram_dedupe": "SELECT rec_id, ord, array_to_string(qs, '|') AS qs FROM recs",
    "rec_upsert": "SELECT CAST(ord % 101 AS VARCHAR) AS rec_id, min(ord) AS ord, array_to_string(max_by(qs, ord), '|') AS qs, count(*) - 1 AS n_replaced FROM recs GROUP BY 1",
    "qgram_df": "SELECT q, df FROM freq",
    "qgram_rank": "SELECT q, df, rank, revrank, absdiff FROM ranks",
    "record_scores": "SELECT rec_id, sum_df, n_grams, score FROM prof",
    "mean_profile": "SELECT mean_len, mean_score FROM mean",
    **{f"subset_{c}": f"SELECT rec_id, ord, type FROM {c}" for c in (*KEYS, "q_r")},
    "subset_overlap": "SELECT rec_id, count(*) AS n FROM nine GROUP BY rec_id HAVING count(*) > 1",
    "random_subsets": "SELECT rec_id, ord, type FROM rnd WHERE type <> 'b'",
    "base_sample": "SELECT rec_id, ord, type FROM rnd WHERE type = 'b'",
    "all_subsets": "SELECT type, count(*) AS n FROM typed GROUP BY type",
    "multi_type_counts": "SELECT types, count(*) AS n FROM (SELECT array_to_string(list_sort(list(type) OVER (PARTITION BY rec_id ORDER BY type)), ',') AS types, row_number() OVER (PARTITION BY rec_id ORDER BY type) AS i FROM nine) WHERE i > 1 GROUP BY types",
    "k_opt": "SELECT k_opt FROM k",
    "bf_positions": f"SELECT rec_id, {TEXT} FROM bfs",
    "bf_popcount": "SELECT rec_id, CAST(len(pos) AS INTEGER) AS n_set FROM bfs",
    "bf_position_table": f"SELECT q, {TEXT} FROM ({vocab('10')})",
    "bf_salted_table": f"SELECT q, {TEXT} FROM ({vocab('10', salt=SALT)})",
    "qgram_dice": f"SELECT a_id, b_id, {dice('aq', 'bq')} AS sim FROM pairs",
    "qgram_jaccard": f"SELECT a_id, b_id, {SIM}::DOUBLE / {UNION} AS sim FROM pairs",
    "qgram_hamming": f"SELECT a_id, b_id, 1.0::DOUBLE - ({UNION} - {SIM})::DOUBLE / {UNION} AS sim FROM pairs",
    "bf_dice": f"SELECT a_id, b_id, {dice('aq', 'bq')} AS sim FROM ({BF_PAIRS})",
    "bf_hamming": f"SELECT a_id, b_id, 1.0::DOUBLE - (len(aq) + len(bq) - 2 * {SIM})::DOUBLE / {BF_LEN} AS sim FROM ({BF_PAIRS})",
    "bf_jaccard": f"SELECT a_id, b_id, greatest(0.0::DOUBLE, 1.0::DOUBLE - 2.0::DOUBLE * (len(aq) + len(bq) - 2 * {SIM}) / {BF_LEN}) AS sim FROM ({BF_PAIRS})",
    **{f"blip_{m}": f"SELECT type, side, rec_id, CAST(len(pos) AS INTEGER) AS n_set, CAST(coalesce(list_sum(pos), 0) AS BIGINT) AS pos_sum FROM noised_{m}" for m in ("ala", "sch")},
    **{f"blip_words_{m}": f"SELECT type, side, rec_id, CAST(len(pos) AS INTEGER) AS n_set, CAST(coalesce(list_sum(pos), 0) AS BIGINT) AS pos_sum FROM words_{m}" for m in ("ala", "sch")},
    **dict.fromkeys(("people_ordered", "people_ordered_split"), "SELECT rec_id, row_number() OVER (ORDER BY ord % 10 <> 0, ord) - 1 AS ord, attr1 || '/\"' || attr2 AS words, status_code FROM voters"),
    "bf_mt19937": twister_table(SeededTwister()),
    "bf_mt19937_sha1": twister_table(SeededTwister("sha1", SALT)),
    **{f"bf_popcount_{name}": f"SELECT rec_id, CAST(len(pos) AS INTEGER) AS n_set FROM bfs_{name}" for name in ("half", "double")},
    **{f"match_clean_{name}": f"SELECT type, probe_id, best, ties, hit, outcome FROM clean_{name}" for name in ("half", "double")},
    "trigram_sets": "SELECT rec_id, array_to_string(list_sort(list(DISTINCT v[i:i+2])), '|') AS qs FROM (SELECT rec_id, v, unnest(range(1, length(v) - 1)) AS i FROM (SELECT rec_id, unnest([attr1, attr2, attr3]) AS v FROM norm WHERE length(attr1) >= 3 AND length(attr2) >= 3 AND length(attr3) >= 3)) GROUP BY rec_id",
    "linkage_report_text": report_text(),
    "match_noisy_philox": "SELECT type, probe_id, best, ties, hit, outcome FROM philox_m",
    "match_pruned": "SELECT type, probe_id, best, ties, hit, outcome FROM clean_m",
    "match_clean": "SELECT type, probe_id, best, ties, hit, outcome FROM clean_m",
    "match_no_noise": "SELECT type, probe_id, best, ties, hit, outcome FROM clean_m",
    "people_csv": "SELECT rec_id, attr1, attr2, attr3, complete FROM norm WHERE ord % 7 <> 0",
    "people_quarantined": "SELECT rec_id || ',' || attr1 || ',' || attr2 AS line FROM voters WHERE ord % 7 = 0",
    **dict.fromkeys(("sample_csv", "sample_parquet"), "SELECT rec_id, type, array_to_string(qs, '|') AS qs FROM typed JOIN recs USING (rec_id)"),
    "match_noisy": "SELECT type, probe_id, best, ties, hit, outcome FROM noisy_m",
    "match_top5": f"""SELECT type, probe_id, cand_id, CAST(place AS INTEGER) AS place, sim, CAST(len(a.qs) AS INTEGER) AS probe_grams, CAST(len(b.qs) AS INTEGER) AS cand_grams, CAST(len(list_intersect(a.qs, b.qs)) AS INTEGER) AS common_grams,
        CAST(len(x.pos) AS INTEGER) AS probe_bits, CAST(len(y.pos) AS INTEGER) AS cand_bits, {dice('u.pos', 'v.pos')} AS noisy_sim
      FROM (SELECT *, row_number() OVER (PARTITION BY type, probe_id ORDER BY sim DESC, cand_id) AS place
        FROM (SELECT p.type, p.rec_id AS probe_id, c.rec_id AS cand_id, {dice('p.pos', 'c.pos')} AS sim FROM side p JOIN side c ON p.type = c.type AND p.side = 'p' AND c.side = 'c'
          WHERE (p.type, p.rec_id) IN (SELECT (type, rec_id) FROM (SELECT type, rec_id, row_number() OVER (PARTITION BY type ORDER BY ord) AS i FROM typed WHERE type <> 'b') WHERE i <= 25)))
      JOIN recs a ON a.rec_id = probe_id JOIN recs b ON b.rec_id = cand_id JOIN bfs x ON x.rec_id = probe_id JOIN bfs y ON y.rec_id = cand_id
      JOIN noised_ala u USING (type) JOIN noised_ala v USING (type) WHERE place <= 5 AND u.side = 'p' AND u.rec_id = probe_id AND v.side = 'c' AND v.rec_id = cand_id""",
    "linkage_report": "SELECT type, metric, outcome, coalesce(n, 0) AS n FROM (SELECT type, metric, outcome FROM codes, (SELECT unnest(['og_bf_dice', 'blip_bf_dice']) AS metric), (SELECT unnest(["
    + ", ".join(f"'{o}'" for o in OUTCOMES)
    + "]) AS outcome)) LEFT JOIN (SELECT type, metric, outcome, count(*) AS n FROM (SELECT *, 'og_bf_dice' AS metric FROM clean_m UNION ALL SELECT *, 'blip_bf_dice' FROM noisy_m) GROUP BY ALL) USING (type, metric, outcome)",
}


def oracle(name: str) -> str:
    return "WITH " + ", ".join(f"{k} AS MATERIALIZED ({v})" for k, v in needed(FINAL[name])) + " " + FINAL[name]


def needed(sql: str) -> list[tuple[str, str]]:
    """The steps that sql uses, in order."""
    import re

    found: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN|,)\s+(\w+)", text):
            if name in STEPS and name not in found:
                found.add(name)
                visit(STEPS[name])

    visit(sql)
    return [(k, v) for k, v in STEPS.items() if k in found]


ORACLES = {name: oracle(name) for name in FINAL}

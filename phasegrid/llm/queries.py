"""The contract queries: each reads its whole table, applies one operator and derives digest columns."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phasegrid.llm import block_dedup, bpe_codec, decontaminate, filter_audit, media_audio, quality, secret_scan, simhash, suffix_dedup, token_files, toxicity, vector_codes, warc
from phasegrid.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op1(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op2(table(spark, sf_dir, "documents"))


def op3_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_audio.op3(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op4(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.op6(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op8(table(spark, sf_dir, "documents"))


def op9_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_dedup.op9(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op10(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.op11(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.op12(table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op13(table(spark, sf_dir, "pages")).drop("error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_media_audio": op3_media_audio,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality_rules": op5_quality_rules,
    "op6_bpe_codec": op6_bpe_codec,
    "op7_toxicity": op7_toxicity,
    "op8_token_files": op8_token_files,
    "op9_block_dedup": op9_block_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_filter_audit": op11_filter_audit,
    "op12_vector_codes": op12_vector_codes,
    "op13_warc": op13_warc,
}



def _lloyd_sql() -> str:
    """Six rounds written out: a_r are assignments of round r, b_r codebooks before it."""
    nearest = "SELECT x.n, x.part, x.s, MIN(list_sum(list_transform(list_zip(x.s, b.s), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 16 + b.entry) AS found FROM x JOIN b{0} b ON b.part = x.part GROUP BY ALL"
    steps = []
    for r in range(7):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(r)})")
        if r < 6:
            steps.append(f"u{r} AS MATERIALIZED (SELECT part, entry, list(c ORDER BY j) AS s FROM (SELECT part, found % 16 AS entry, j, CAST(FLOOR(SUM(s[j]) / COUNT(*)) AS BIGINT) AS c FROM (SELECT part, found, s, unnest(range(1, len(s) + 1)) AS j FROM a{r}) GROUP BY ALL) GROUP BY ALL)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, COALESCE(u.s, b.s) AS s FROM b{r} b LEFT JOIN u{r} u USING (part, entry))")
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, list_transform(embedding, lambda x: CAST(FLOOR(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT n, part, v[part * (len(v) // 8) + 1:(part + 1) * (len(v) // 8)] AS s FROM (SELECT n, v, unnest(range(8)) AS part FROM k)),
b0 AS MATERIALIZED (SELECT part, n - 1 AS entry, s FROM x WHERE n <= 16),
{", ".join(steps)},
said AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b6),
done AS (SELECT n, string_agg(printf('%02x', found % 16), '' ORDER BY part) AS code, CAST(SUM(found // 16) AS BIGINT) AS error FROM a6 GROUP BY n)
SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM done JOIN k USING (n), said"""


#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op4_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, w, LEAST(10, len(w)) AS n, unnest(range(1, len(w) - LEAST(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bw),
lengths AS (SELECT DISTINCT n FROM phrases),
dw AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n),
hits AS (SELECT dw.r, dw.i, dw.n, item FROM dw JOIN phrases ON phrases.n = dw.n AND phrases.s = array_to_string(dw.w[dw.i:dw.i + dw.n - 1], ' ')),
places AS (SELECT r, COUNT(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)""",
    "op9_block_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT s, MIN(doc_id) AS first_id FROM windows GROUP BY s),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (s) WHERE first_id < doc_id)),
words AS (SELECT r, p, w[p] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT words.r, COUNT(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL) AS kept FROM words LEFT JOIN gone ON gone.r = words.r AND gone.p = words.p GROUP BY words.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_removed, 0) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS t FROM documents),
firsts AS (SELECT t, MIN(doc_id) AS first_id FROM d GROUP BY t),
w AS (SELECT d.*, first_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d JOIN firsts USING (t)),
m AS (SELECT part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
 + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first_id < doc_id THEN 16 ELSE 0 END AS fails,
 COALESCE(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), FALSE) AS good, COALESCE(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), FALSE) AS toxic FROM w),
cells AS (SELECT part, fails, COUNT(*) AS n, COUNT(*) FILTER (good) AS good, COUNT(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
l(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step, bits[step] AS bit, COALESCE(list_sum(bits[1:step - 1]), 0)::BIGINT AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)),
found AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, bit, SUM(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END) AS kept, SUM(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN n ELSE 0 END) AS removed, SUM(CASE WHEN fails & bit <> 0 AND fails & before <> 0 THEN n ELSE 0 END) AS redundant,
 SUM(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails, SUM(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN good ELSE 0 END) AS good_lost, SUM(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM steps, cells GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(SUM(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM found""",
    "op12_vector_codes": _lloyd_sql(),
    "op13_warc": """
WITH p AS (SELECT page_id, COALESCE(html, '') AS p FROM pages),
f AS (SELECT page_id, p, CASE WHEN strlen(p) >= 100 THEN MIN(page_id) OVER (PARTITION BY p) END AS first_id FROM p)
SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes, sha256(p) AS payload_digest, CASE WHEN first_id < COALESCE(page_id, 9223372036854775807) THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id < COALESCE(page_id, 9223372036854775807) THEN first_id END AS refers_to FROM f""",
}

"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, lines, mixing, pii, quality, scoring, sharding, simhash, substrings, tokens
from .shared import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle_words=3, radius=3)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), alpha=0.5)


def op5_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is the documents that are labelled as good."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    out = scoring.cross_entropy_difference(table(spark, sf_dir, "documents").select("doc_id", "text"), good)
    return out.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "score")))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=50).drop("kept")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


OP4_SQL = """
WITH RECURSIVE docs AS (SELECT *, coalesce(source, '') AS mix_source FROM documents),
counts AS (SELECT mix_source, count(*) AS n_rows FROM docs GROUP BY 1),
rates AS (
    SELECT mix_source, (SELECT count(*) FROM docs)::DOUBLE * pow(n_rows::DOUBLE, 0.5) / (SELECT sum(pow(n_rows::DOUBLE, 0.5)) FROM counts) / n_rows AS rate
    FROM counts
),
steps AS (
    SELECT mix_source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM rates
    UNION ALL
    SELECT mix_source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM steps WHERE k < rate + 12 * sqrt(rate) + 24
),
drawn AS (
    SELECT d.*, (SELECT count(*) FROM steps s WHERE s.mix_source = d.mix_source
        AND s.cdf <= ('0x' || substr(md5('42:' || coalesce(d.doc_id::VARCHAR, '') || ':1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)::INTEGER AS n_copies
    FROM docs d
),
copies AS (SELECT * EXCLUDE (mix_source), unnest(range(n_copies))::INTEGER AS copy FROM drawn WHERE n_copies > 0)
SELECT *, ('0x' || substr(md5('43:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS shuffle_key
FROM copies
"""


OP5_SQL = r"""
WITH docs AS (
    SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS target,
           list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
    FROM documents
),
pairs AS (SELECT doc_id, target, unnest(list_concat(['<s> '], words)) AS a, unnest(list_concat(words, ['</s> '])) AS b FROM docs),
firsts AS (SELECT a, count(*) FILTER (WHERE target)::DOUBLE AS ft, count(*)::DOUBLE AS fa FROM pairs GROUP BY a),
twos AS (SELECT a, b, count(*) FILTER (WHERE target)::DOUBLE AS pt, count(*)::DOUBLE AS pa FROM pairs GROUP BY a, b),
sizes AS (SELECT count(*)::DOUBLE AS v, sum(ft) / sum(fa) AS scale FROM firsts),
losses AS (
    SELECT a, b, -ln((pt + 0.1::DOUBLE) / (ft + 0.1::DOUBLE * v)) AS lt, -ln((pa * scale + 0.1::DOUBLE) / (fa * scale + 0.1::DOUBLE * v)) AS lb
    FROM twos JOIN firsts USING (a), sizes
)
SELECT doc_id, count(*) AS n_tokens, round(avg(lt), 6) AS loss_target, round(avg(lb), 6) AS loss_background, round(avg(lt) - avg(lb), 6) AS score
FROM pairs JOIN losses USING (a, b) GROUP BY doc_id
"""

OP6_SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
grams AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 49)) AS p FROM docs)),
firsts AS (SELECT g, min(doc_id) AS least FROM grams GROUP BY g),
lost AS (SELECT DISTINCT doc_id, p FROM grams JOIN firsts USING (g) WHERE doc_id > least),
marked AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM lost),
runs AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
spans AS (SELECT doc_id, run, min(p) AS s, max(p) + 50 AS e FROM runs GROUP BY 1, 2),
gaps AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM spans),
parts AS (
    SELECT doc_id, string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) AS front, max(e) AS last, sum(e - s) AS n_removed, count(*) AS n_spans
    FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs d LEFT JOIN parts USING (doc_id)
"""

OP8_SQL = r"""
WITH docs AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
    FROM documents
),
items AS (
    SELECT item_id, words FROM (
        SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
        FROM benchmark
    ) WHERE len(words) > 0
),
cut AS (SELECT item_id, words, unnest(range(greatest(len(words) - 12, 1))) AS i0 FROM items),
windows AS (SELECT DISTINCT item_id, least(len(words), 13) AS size, array_to_string(words[i0 + 1 : i0 + 13], ' ') AS phrase FROM cut),
sizes AS (SELECT DISTINCT size FROM windows),
starts AS (SELECT doc_id, size, words, unnest(range(len(words) - size + 1)) AS i0 FROM docs, sizes WHERE len(words) >= size),
grams AS (SELECT doc_id, size, i0, array_to_string(words[i0 + 1 : i0 + size], ' ') AS phrase FROM starts),
found AS (SELECT doc_id, i0, g.size, item_id FROM grams g JOIN windows w ON g.size = w.size AND g.phrase = w.phrase),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i0, i0 + size)) AS pos FROM found) GROUP BY 1),
own AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM found GROUP BY 1)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_quality": op2_quality,
        "op3_sharding": op3_sharding,
        "op4_mixing": op4_mixing,
        "op5_scoring": op5_scoring,
        "op6_substrings": op6_substrings,
        "op7_lines": op7_lines,
        "op8_contamination": op8_contamination,
        "op9_tokens": op9_tokens,
        "op10_pii": op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4_SQL, "op5_scoring": OP5_SQL, "op6_substrings": OP6_SQL, "op8_contamination": OP8_SQL}

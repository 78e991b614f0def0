"""Registered queries, each with the SQL that DuckDB answers it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import checksums, geometry, labels, similarity
from ..functions import text as t
from ..operators import detect, edits, grouping, ner, replace, report
from ..schema import ENTITY_TYPES, MASKS
from ..sources import views
from ..sources.views import read_table
from .corpus import anonymise, corpus_patterns, occurrences

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


# ---- SQL that several queries share

PAGES = """
pages AS (
    SELECT doc_id, (i - 1)::INTEGER AS page_index, text
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
),
words AS (
    SELECT doc_id, page_index, (i - 1)::INTEGER AS word_index, w AS text,
           coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id, page_index ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start,
           coalesce(sum(6 * length(w) + 10) OVER (PARTITION BY doc_id, page_index ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + 10 AS x
    FROM (SELECT doc_id, page_index, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM pages)
)"""

# The expressions that find something in the corpus, in the order of the pattern table.
RE2 = (
    (0, "dni-ar", "DNI", r"\b\d{1,2}\.?\d{3}\.?\d{3}\b", "replace(value, '.', '')", "true", MASKS["DNI"]),
    (4, "email", "EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "lower(value)", "true", MASKS["EMAIL"]),
    (6, "credit-card", "CREDIT_CARD", r"\b(?:\d[ -]*?){13,19}\b", "regexp_replace(value, '[^0-9]', '', 'g')", "luhn", MASKS["CREDIT_CARD"]),
    (15, "ipv4", "CUSTOM", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "value", "true", "XXX.XXX.XXX.XXX"),
    (16, "phone-us", "PHONE", r"\+1 \(\d{3}\) \d{3}-\d{4}", "regexp_replace(value, '[^0-9]', '', 'g')", "true", "+X (XXX) XXX-XXXX"),
    (17, "token", "CUSTOM", r"\b[0-9a-f]{40}\b", "value", "true", MASKS["CUSTOM"]),
)


def luhn_sql(digits: str) -> str:
    """The digits from the last on; every second one counts double."""
    each = f"list_transform(range(length({digits})), lambda k: (substr({digits}, length({digits}) - k::INTEGER, 1)::INTEGER) * (1 + k % 2) - CASE WHEN k % 2 = 1 AND (substr({digits}, length({digits}) - k::INTEGER, 1)::INTEGER) > 4 THEN 9 ELSE 0 END)"
    return f"(length({digits}) BETWEEN 13 AND 19 AND list_sum({each}) % 10 = 0)"


def _scan(index: int, name: str, kind: str, regex: str, normal: str, check: str, mask: str) -> str:
    ok = luhn_sql("normalized_value") if check == "luhn" else check
    return f"""SELECT * FROM (SELECT doc_id, page_index, text, (ends - length(value))::INTEGER AS start, ends::INTEGER AS "end", {index} AS pattern, '{name}' AS pattern_id, '{kind}' AS entity_type, value, {normal} AS normalized_value, '{mask}' AS mask_format
    FROM (SELECT doc_id, page_index, text, value, sum(length(gap) + length(value)) OVER (PARTITION BY doc_id, page_index ORDER BY i) AS ends
          FROM (SELECT doc_id, page_index, text, unnest(regexp_extract_all(text, '(?s)(.*?)({regex})', 1)) AS gap, unnest(regexp_extract_all(text, '(?s)(.*?)({regex})', 2)) AS value,
                       generate_subscripts(regexp_extract_all(text, '{regex}'), 1) AS i FROM pages WHERE regexp_matches(text, '{regex}')))) WHERE {ok}"""


FOUND = (
    PAGES
    + ",\nscans AS ("
    + "\nUNION ALL\n".join(_scan(*r) for r in RE2)
    + r"""),
guarded AS (
    SELECT * FROM scans WHERE regexp_matches(value, '\p{L}') OR NOT regexp_matches(
        regexp_extract(substr(text, 1, start), '((?:[\p{L}\p{N}]+(?:[-./][\p{L}\p{N}]+)*[-./]?)?)$', 1) || regexp_extract(substr(text, "end" + 1), '^((?:[-./]?[\p{L}\p{N}]+)*)', 1), '\p{L}')
),
found AS MATERIALIZED (
    SELECT a.* FROM guarded a WHERE NOT EXISTS (
        SELECT 1 FROM guarded b WHERE a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.start < b."end" AND b.start < a."end"
          AND (b."end" - b.start, -b.start, -b.pattern) > (a."end" - a.start, -a.start, -a.pattern))
),
hit_words AS MATERIALIZED (
    SELECT doc_id, page_index, (i - 1)::INTEGER AS word_index, w AS text,
           coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id, page_index ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start,
           coalesce(sum(6 * length(w) + 10) OVER (PARTITION BY doc_id, page_index ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + 10 AS x
    FROM (SELECT doc_id, page_index, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM (SELECT DISTINCT doc_id, page_index, text FROM found))
),
placed AS MATERIALIZED (
    SELECT f.*, w0.word_index AS first_word, w1.word_index AS last_word, w0.x AS x, w1.x + 6 * length(w1.text) - w0.x AS width
    FROM found f
    JOIN hit_words w0 ON f.doc_id = w0.doc_id AND f.page_index = w0.page_index AND w0.start <= f.start AND f.start < w0.start + length(w0.text) + 1
    JOIN hit_words w1 ON f.doc_id = w1.doc_id AND f.page_index = w1.page_index AND w1.start < f."end" AND f."end" <= w1.start + length(w1.text) + 1
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, start) AS seq FROM placed),
occ AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type, page_index, normalized_value, x, width ORDER BY seq) AS n FROM numbered) WHERE n = 1
)"""
)

GROUPS = (
    FOUND
    + """,
spell AS (SELECT doc_id, entity_type, normalized_value, value, count(*) AS freq, min(seq) AS first_seq FROM occ GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type, normalized_value ORDER BY freq DESC, length(value) DESC, first_seq) AS n FROM spell),
tops AS (SELECT doc_id, entity_type, normalized_value, freq AS f, length(value) AS l, value AS canonical_value FROM best WHERE n = 1),
ties AS (SELECT doc_id, entity_type, normalized_value, canonical_value, count(DISTINCT lower(s.value)) >= 2 AS ambiguous
         FROM tops t JOIN spell s USING (doc_id, entity_type, normalized_value) WHERE s.freq = f AND length(s.value) = l GROUP BY ALL),
masks AS (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type, normalized_value ORDER BY c DESC, p, x) AS n
          FROM (SELECT doc_id, entity_type, normalized_value, mask_format, count(*) AS c, min((page_index, x)) AS px, min(page_index) AS p, min_by(x, (page_index, x)) AS x FROM occ GROUP BY doc_id, entity_type, normalized_value, mask_format)),
firsts AS (SELECT doc_id, entity_type, normalized_value, count(*) AS n_members, min(page_index * 10000000.0 + x) AS place, min(width) AS narrowest FROM occ GROUP BY ALL),
groups AS (
    SELECT f.doc_id, f.entity_type, f.normalized_value, t.canonical_value, t.ambiguous, f.n_members, m.mask_format, f.narrowest,
           (row_number() OVER (PARTITION BY f.doc_id, f.entity_type ORDER BY place, f.normalized_value))::INTEGER AS index_in_type
    FROM firsts f JOIN ties t USING (doc_id, entity_type, normalized_value) JOIN masks m USING (doc_id, entity_type, normalized_value) WHERE m.n = 1
)"""
)


def _case(values: dict[str, str], on: str) -> str:
    return f"CASE {on} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def _token_sql(level: int, kind: str = "entity_type", index: str = "index_in_type") -> str:
    from ..schema import LABELS

    name = _case({k: v[level] for k, v in LABELS.items()}, kind)
    sep = "-" if level == 2 else " "
    return f"'[' || {name} || '{sep}' || CASE WHEN {index} < 10 THEN '0' ELSE '' END || {index} || ']'"


def _fits(level: int) -> str:
    return f"length({_token_sql(level)}) * (12 * 0.64::DOUBLE) * 0.6::DOUBLE <= narrowest"


VALUED = GROUPS + f""",
valued AS (SELECT *, CASE WHEN {_fits(0)} THEN {_token_sql(0)} WHEN {_fits(1)} THEN {_token_sql(1)} ELSE {_token_sql(2)} END AS replacement_value FROM groups)"""


# ---- pages, words, detections


@query(f"WITH {PAGES} SELECT doc_id, page_index, count(*) AS n_words, sum(start)::BIGINT AS sum_start, max(start + length(text))::INTEGER AS last_end, sum(x)::DOUBLE AS sum_x, sum(greatest(6.0 * length(text), 1))::DOUBLE AS sum_width FROM words GROUP BY 1, 2")
def words_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word view's offsets and boxes, summed per page."""
    w = views.words(views.pages(docs(spark, sf_dir)))
    return w.groupBy("doc_id", "page_index").agg(F.count("*").alias("n_words"), F.sum("start").alias("sum_start"), F.max("end").alias("last_end"), F.sum("bbox.x").alias("sum_x"), F.sum("bbox.width").alias("sum_width"))


@query(f"""WITH {FOUND} SELECT doc_id, page_index, start, "end", pattern_id, entity_type, value, normalized_value, mask_format, first_word AS word_start, last_word + 1 AS word_end, x, width::DOUBLE AS width FROM placed""")
def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pattern on every page."""
    d = detect.detect(views.pages(docs(spark, sf_dir)), corpus_patterns(), F.col("doc_id") % 5 == 0)
    return d.select("doc_id", "page_index", "start", "end", "pattern_id", "entity_type", "value", "normalized_value", "mask_format", F.col("word_span.start_index").alias("word_start"), F.col("word_span.end_index_exclusive").alias("word_end"), F.col("bbox.x").alias("x"), F.col("bbox.width").alias("width"))


@query(f"""WITH {FOUND},
cut AS (
    SELECT doc_id, page_index, start, "end", text, length(text) AS n, greatest(0, start - 40) AS f0, least(length(text), "end" + 40) AS t0 FROM placed
),
edge AS (
    SELECT *, CASE WHEN f0 = 0 THEN 0 WHEN strpos(substr(text, f0 + 1), ' ') = 0 THEN f0 ELSE f0 + strpos(substr(text, f0 + 1), ' ') END AS f1,
           CASE WHEN t0 >= n THEN n WHEN strpos(reverse(substr(text, 1, t0 + 1)), ' ') = 0 THEN t0 ELSE t0 + 1 - strpos(reverse(substr(text, 1, t0 + 1)), ' ') END AS t1 FROM cut
)
SELECT doc_id, page_index, start, ltrim(CASE WHEN f1 < start THEN substr(text, f1 + 1, start - f1) ELSE '' END) AS before, rtrim(CASE WHEN t1 > "end" THEN substr(text, "end" + 1, t1 - "end") ELSE '' END) AS after FROM edge""")
def detection_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text around each detection."""
    d = detect.detect(views.pages(docs(spark, sf_dir)), corpus_patterns())
    return d.select("doc_id", "page_index", "start", F.coalesce("context.before", F.lit("")).alias("before"), F.coalesce("context.after", F.lit("")).alias("after"))


@query(f"""WITH {FOUND} SELECT doc_id, page_index, start, "end", first_word AS start_index, last_word + 1 AS end_index_exclusive, x, width::DOUBLE AS width, 100.0::DOUBLE AS y FROM placed""")
def detection_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, J3, A7, A8, W3 by the interval join, whose hulls must equal those computed from offsets."""
    page = views.pages(docs(spark, sf_dir))
    d = detect.detect(page, corpus_patterns()).select("doc_id", "page_index", "start", "end")
    hit = page.join(d.select("doc_id", "page_index").distinct(), ["doc_id", "page_index"], "left_semi")
    return detect.words_of_spans(d, views.words(hit)).select("doc_id", "page_index", "start", "end", "word_span.*", F.col("bbox.x").alias("x"), F.col("bbox.width").alias("width"), F.col("bbox.y").alias("y"))


# ---- entities


@query(f"WITH {GROUPS} SELECT * EXCLUDE (narrowest) FROM groups")
def entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 to A6, J4, J8, W1 on exact keys."""
    g = grouping.exact_groups(occurrences(docs(spark, sf_dir)))
    return g.select("doc_id", "entity_type", "normalized_value", "canonical_value", "ambiguous", "n_members", "mask_format", "index_in_type")


@query(f"WITH {GROUPS} SELECT doc_id, entity_type, index_in_type, canonical_value, n_members FROM groups")
def folded_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 by the sequential rules (M1 to M7, M15): where nothing overlaps, the same entities as by exact keys."""
    g = grouping.fold_groups(occurrences(docs(spark, sf_dir)))
    return g.select("doc_id", "entity_type", "index_in_type", "canonical_value", "n_members")


@query(f"WITH {VALUED} SELECT doc_id, entity_type, index_in_type, replacement_value, mask_format FROM valued")
def placeholder_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token of each entity that fits all its boxes."""
    a = anonymise(docs(spark, sf_dir))
    return a.groups.select("doc_id", "entity_type", "index_in_type", "replacement_value", "mask_format")


@query(f"""WITH {VALUED},
cuts AS (SELECT o.doc_id, o.page_index, o.start, o."end", replacement_value, coalesce(lag(o."end") OVER (PARTITION BY o.doc_id, o.page_index ORDER BY o.start), 0) AS back, o.text
         FROM occ o JOIN valued v USING (doc_id, entity_type, normalized_value)),
marked AS (SELECT doc_id, page_index, string_agg(substr(text, back + 1, start - back) || replacement_value, '' ORDER BY start) || substr(any_value(text), max("end") + 1) AS text FROM cuts GROUP BY 1, 2)
SELECT p.doc_id, md5(string_agg(coalesce(m.text, p.text), chr(10) ORDER BY p.page_index)) AS text_md5, count(m.text) AS n_pages_changed
FROM pages p LEFT JOIN marked m USING (doc_id, page_index) GROUP BY 1""")
def anonymised_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its entities replaced, as the hash of the new text and the changed pages."""
    a = anonymise(docs(spark, sf_dir))
    changed = a.replacements.select("doc_id", "page_index").distinct().groupBy("doc_id").agg(F.count("*").alias("n"))
    return a.texts.join(changed, "doc_id", "left").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.coalesce("n", F.lit(0)).cast("long").alias("n_pages_changed"))


@query(f"""WITH {VALUED}, prefixed AS (SELECT *, regexp_extract(replacement_value, '^\\[(.+)[\\s-]\\d+\\]$', 1) AS prefix FROM valued)
SELECT doc_id, entity_type, array_to_string(list_sort(list(DISTINCT prefix)), ', ') AS prefixes, {_case(replace.TYPE_NAMES, 'entity_type')} AS type_name, sum(n_members)::BIGINT AS n_markers,
       sum(n_members)::BIGINT || CASE WHEN sum(n_members) = 1 THEN ' marcador' ELSE ' marcadores' END AS count_label FROM prefixed GROUP BY doc_id, entity_type""")
def marker_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 to K6, A9, F46."""
    return replace.legend(anonymise(docs(spark, sf_dir)).groups)


@query(f"WITH {GROUPS} SELECT doc_id, count(*) AS n_groups, count(*) FILTER (WHERE n_members < 2) AS n_enabled, count(DISTINCT entity_type) AS n_types FROM groups GROUP BY 1")
def panel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that occur once count as enabled here."""
    g = grouping.exact_groups(occurrences(docs(spark, sf_dir))).withColumn("enabled", F.col("n_members") < 2)
    return report.summary(g)


@query(f"WITH {GROUPS} SELECT doc_id, entity_type, count(*) AS n_groups, CASE WHEN count(*) FILTER (WHERE n_members < 2) = 0 THEN 'none' WHEN count(*) FILTER (WHERE n_members < 2) = count(*) THEN 'all' ELSE 'indeterminate' END AS state FROM groups GROUP BY 1, 2")
def panel_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return report.cascade(grouping.exact_groups(occurrences(docs(spark, sf_dir))).withColumn("enabled", F.col("n_members") < 2))


@query(f"WITH {GROUPS} SELECT doc_id, entity_type, index_in_type, row_number() OVER (PARTITION BY doc_id ORDER BY list_position({list(ENTITY_TYPES)}, entity_type), index_in_type) AS panel_rank FROM groups")
def panel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1, O2, O4."""
    g = report.panel_order(grouping.exact_groups(occurrences(docs(spark, sf_dir))))
    return g.select("doc_id", "entity_type", "index_in_type", F.col("panel_rank").cast("long").alias("panel_rank"))


@query(f"WITH {GROUPS} SELECT doc_id, entity_type, canonical_value FROM groups WHERE contains(lower(canonical_value), '55')")
def panel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13, Q9."""
    g = grouping.exact_groups(occurrences(docs(spark, sf_dir))).withColumn("aliases", F.array("canonical_value"))
    return report.group_filter(g, "55").select("doc_id", "entity_type", "canonical_value")


@query("SELECT * FROM (VALUES ('hull', 0::BIGINT), ('numbering', 0), ('overlap', 0), ('word_start', 0)) v(rule, n)")
def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12: nothing may violate the four properties."""
    a = anonymise(docs(spark, sf_dir))
    return report.violations(a.groups, a.members)


@query(f"WITH {FOUND} SELECT entity_type, count(*) AS n_occurrences, count(DISTINCT doc_id) AS n_documents, count(DISTINCT normalized_value) AS n_values FROM occ GROUP BY 1")
def occurrence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4, A1 over the corpus."""
    o = occurrences(docs(spark, sf_dir))
    return o.groupBy("entity_type").agg(F.count("*").alias("n_occurrences"), F.count_distinct("doc_id").alias("n_documents"), F.count_distinct("normalized_value").alias("n_values"))


@query(f"WITH {FOUND} SELECT doc_id, seq::BIGINT AS seq, entity_type FROM occ WHERE normalized_value NOT IN (SELECT normalized_value FROM occ GROUP BY 1 HAVING count(DISTINCT doc_id) > 1)")
def without_shared_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that stand in several documents are suppressed everywhere."""
    o = occurrences(docs(spark, sf_dir))
    shared = o.groupBy("normalized_value").agg(F.count_distinct("doc_id").alias("n")).filter("n > 1")
    removed = o.join(shared, "normalized_value", "left_semi").select("doc_id", "normalized_value").distinct()
    return grouping.without_removed(o, removed).select("doc_id", "seq", "entity_type")


@query(f"""WITH {FOUND} SELECT doc_id, page_index, start, lead(start) OVER (PARTITION BY doc_id, page_index ORDER BY start) AS next_start, lead(x) OVER (PARTITION BY doc_id, page_index ORDER BY start) - (x + width) AS room FROM occ""")
def next_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest replacement to the right on the line, and the room to it."""
    o = occurrences(docs(spark, sf_dir))
    w = Window.partitionBy("doc_id", "page_index").orderBy("start")
    return o.select("doc_id", "page_index", "start", F.lead("start").over(w).alias("next_start"), (F.lead("bbox.x").over(w) - (F.col("bbox.x") + F.col("bbox.width"))).alias("room"))


# ---- search

SUB = "string_split(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' +', ' ', 'g')), ' ')"
SEARCH = f"""{PAGES},
sub AS (SELECT doc_id, page_index, word_index, unnest({SUB}) AS token, generate_subscripts({SUB}, 1) AS part FROM words),
rows AS (SELECT *, lead(token) OVER p AS token2, lead(word_index) OVER p AS word2 FROM sub WHERE token <> '' WINDOW p AS (PARTITION BY doc_id, page_index ORDER BY word_index, part))"""


@query(f"WITH {SEARCH} SELECT doc_id, page_index, word_index AS start_index, word2 + 1 AS end_index_exclusive FROM rows WHERE token = 'the' AND token2 LIKE 'an%'")
def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1, Q3, W7, F14: "the an", the last token only begun."""
    return detect.find_text(views.words(views.pages(docs(spark, sf_dir))), "The an").select("doc_id", "page_index", "start_index", "end_index_exclusive")


@query(f"WITH {SEARCH} SELECT doc_id, page_index, word_index AS start_index, word2 + 1 AS end_index_exclusive FROM rows WHERE token = 'de' AND token2 = 'la'")
def search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: "de la", whole tokens."""
    return detect.find_text(views.words(views.pages(docs(spark, sf_dir))), "DE LA", prefix=False).select("doc_id", "page_index", "start_index", "end_index_exclusive")


@query(f"""WITH {SEARCH}, w AS (SELECT doc_id, page_index, string_split(text, ' ') AS ws FROM pages)
SELECT doc_id, page_index, word_index AS start_index, array_to_string(ws[greatest(word_index - 5, 1) : word_index], ' ') AS words_before, array_to_string(ws[word2 + 2 : word2 + 7], ' ') AS words_after
FROM rows JOIN w USING (doc_id, page_index) WHERE token = 'is' AND token2 = 'the'""")
def search_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six words around each place of "is the"."""
    page = views.pages(docs(spark, sf_dir))
    found = detect.find_text(views.words(page), "is the", prefix=False)
    return report.context_words(page, found).select("doc_id", "page_index", "start_index", "words_before", "words_after")


# ---- scalar functions over generated identifiers


@query("""SELECT o_orderkey, v, cuit_ok FROM (SELECT o_orderkey, v, (CASE WHEN length(v) = 11 THEN (list_sum(list_transform(range(10), lambda k: substr(v, k::INTEGER + 1, 1)::INTEGER * [5,4,3,2,7,6,5,4,3,2][k + 1])) + substr(v, 11, 1)::INTEGER) % 11 = 0 ELSE false END) AS cuit_ok
FROM (SELECT o_orderkey, '20' || lpad((o_orderkey * 7919 % 100000000)::VARCHAR, 8, '0') || (o_custkey % 10) AS v FROM orders))""")
def cuit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 over a number per order."""
    o = read_table(spark, sf_dir, "orders")
    v = F.concat(F.lit("20"), F.lpad((F.col("o_orderkey") * 7919 % 100000000).cast("string"), 8, "0"), (F.col("o_custkey") % 10).cast("string"))
    return o.select("o_orderkey", v.alias("v")).withColumn("cuit_ok", checksums.cuit_ok(F.col("v")))


@query(f"SELECT o_orderkey, v, {luhn_sql('v')} AS luhn_ok FROM (SELECT o_orderkey, '4' || lpad((o_orderkey * 104729 % 100000000000)::VARCHAR, 11 + (o_custkey % 6)::INTEGER, '0') AS v FROM orders)")
def luhn_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6 over a number per order, some too short."""
    o = read_table(spark, sf_dir, "orders")
    v = F.concat(F.lit("4"), F.expr("lpad(cast(o_orderkey * 104729 % 100000000000 as string), cast(11 + o_custkey % 6 as int), '0')"))
    return o.select("o_orderkey", v.alias("v")).withColumn("luhn_ok", checksums.luhn_ok(F.col("v")))


@query("""SELECT o_orderkey, v, (substr(v, 5) || '1314' || substr(v, 3, 2))::HUGEINT % 97 = 1 AS iban_ok FROM (SELECT o_orderkey, 'DE' || lpad((o_custkey % 100)::VARCHAR, 2, '0') || lpad((o_orderkey * 15485863 % 1000000000000)::VARCHAR, 18, '0') AS v FROM orders)""")
def iban_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7 over a number per order."""
    o = read_table(spark, sf_dir, "orders")
    v = F.concat(F.lit("DE"), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"), F.lpad((F.col("o_orderkey") * 15485863 % 1000000000000).cast("string"), 18, "0"))
    return o.select("o_orderkey", v.alias("v")).withColumn("iban_ok", checksums.iban_ok(F.col("v")))


@query("""SELECT o_orderkey, lpad(day(o_orderdate)::VARCHAR, 2, '0') || '/' || lpad((month(o_orderdate) + o_orderkey % 3)::VARCHAR, 2, '0') || '/' || CASE WHEN year(o_orderdate) % 100 <= 49 THEN '20' ELSE '19' END || lpad((year(o_orderdate) % 100)::VARCHAR, 2, '0') AS normal,
       month(o_orderdate) + o_orderkey % 3 <= 12 AS date_ok FROM orders""")
def date_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written d/m/yy, some with months beyond the year's end."""
    o = read_table(spark, sf_dir, "orders")
    v = F.concat_ws("/", F.day("o_orderdate"), (F.month("o_orderdate") + F.col("o_orderkey") % 3), F.lpad((F.year("o_orderdate") % 100).cast("string"), 2, "0"))
    n = t.numeric_date(v)
    return o.select("o_orderkey", n.alias("normal"), checksums.date_in_range(n).alias("date_ok"))


@query("SELECT c_custkey, trim(regexp_replace(strip_accents(lower(c_name || ' ' || c_mktsegment)), '\\s+', ' ', 'g')) AS comparable, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits FROM customer")
def comparable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F3."""
    c = read_table(spark, sf_dir, "customer")
    return c.select("c_custkey", t.comparable(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("comparable"), t.digits_only(F.col("c_name")).alias("digits"))


@query(f"WITH {PAGES} SELECT doc_id, md5(string_agg(trim(regexp_replace(strip_accents(lower(text)), ' +', ' ', 'g')), '|' ORDER BY page_index)) AS h FROM pages GROUP BY 1")
def comparable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 over all texts of the corpus."""
    p = views.pages(docs(spark, sf_dir)).withColumn("c", t.comparable(F.col("text")))
    return p.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "c"))), lambda x: x["c"]), "|").cast("binary")).alias("h"))


@query(f"""SELECT n, entity_type, {_token_sql(0, index='n')} AS level0, {_token_sql(1, index='n')} AS level1, {_token_sql(2, index='n')} AS level2, {_case(MASKS, 'entity_type')} AS mask
FROM (SELECT n::INTEGER AS n, unnest({list(ENTITY_TYPES)}) AS entity_type FROM range(1, 121) r(n))""")
def placeholder_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F22, F24, F25 for every type and number."""
    n = spark.range(1, 121).select(F.col("id").cast("int").alias("n"), F.explode(F.array(*map(F.lit, ENTITY_TYPES))).alias("entity_type"))
    none = F.lit(None).cast("string")
    return n.select("n", "entity_type", *(labels.token(F.col("entity_type"), none, F.col("n"), k).alias(f"level{k}") for k in range(3)), labels.mask_of(F.col("entity_type")).alias("mask"))


NAMES = "SELECT DISTINCT lower(w) AS v FROM (SELECT unnest(string_split(text, ' ')) AS w FROM conversations) WHERE regexp_matches(w, '^[A-Za-z]{9,}$')"


@query(f"WITH names AS ({NAMES}) SELECT a.v AS a, b.v AS b FROM names a JOIN names b ON a.v < b.v AND abs(length(a.v) - length(b.v)) <= 3 AND levenshtein(a.v, b.v) <= 3 WHERE 1.0::DOUBLE - levenshtein(a.v, b.v) / greatest(length(a.v), length(b.v))::DOUBLE >= 0.88::DOUBLE")
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of long words of the conversations at 0.88 or more."""
    w = read_table(spark, sf_dir, "conversations").select(F.explode(F.split("text", " ")).alias("w")).filter(F.col("w").rlike("^[A-Za-z]{9,}$"))
    return grouping.similar_pairs(w.select(F.lower("w").alias("value"))).select("a", "b")


@query("""SELECT p_partkey, other, d, CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1.0::DOUBLE - d / greatest(length(a), length(b))::DOUBLE END AS similarity,
       1.0::DOUBLE - d / greatest(length(a), length(b))::DOUBLE >= 0.5::DOUBLE AS close FROM (
    SELECT p.p_partkey, q.p_partkey AS other, lower(p.p_name) AS a, lower(q.p_name) AS b, levenshtein(lower(p.p_name), lower(q.p_name)) AS d FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1)""")
def edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16 to F18 over neighbouring parts."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("a"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("other"), F.col("a").alias("b"))
    return p.join(q, "p_partkey").select("p_partkey", "other", F.levenshtein("a", "b").cast("long").alias("d"), similarity.similarity(F.col("a"), F.col("b")).alias("similarity"), similarity.at_least("a", "b", 0.5).alias("close"))


# ---- geometry on boxes made of line items

BOXES = """boxes AS (SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS seq, l_returnflag AS entity_type, l_linestatus AS source, (l_partkey % 60)::DOUBLE AS x, (l_suppkey % 3 * 9)::DOUBLE AS y, l_quantity::DOUBLE AS width, 12.0::DOUBLE AS height FROM lineitem)"""
SHARE = "greatest(0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y))"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read_table(spark, sf_dir, "lineitem")
    box = geometry.box(F.col("l_partkey") % 60, F.col("l_suppkey") % 3 * 9, F.col("l_quantity"), F.lit(12))
    return line.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.col("l_linenumber").cast("long").alias("seq"), F.col("l_returnflag").alias("entity_type"), F.col("l_linestatus").alias("source"), box.alias("bbox"), F.lit(None).cast("array<struct<x:double,y:double,width:double,height:double,rotation:int>>").alias("fragments"))


@query(f"""WITH {BOXES}, met AS (
    SELECT a.doc_id, a.seq, b.seq AS other_seq, CASE WHEN a.source <> b.source THEN 'disagree' ELSE 'overlap' END AS reason
    FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND b.seq < a.seq AND a.entity_type <> b.entity_type
    WHERE {SHARE} / least(a.width * a.height, b.width * b.height) > 0.5::DOUBLE)
SELECT doc_id, seq, other_seq, reason FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, seq ORDER BY other_seq, reason) AS n FROM met) WHERE n = 1""")
def overlap_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first earlier box of another type that covers over half."""
    return grouping.overlap_conflicts(_boxes(spark, sf_dir))


@query(f"""WITH {BOXES} SELECT doc_id, seq FROM boxes a WHERE NOT EXISTS (
    SELECT 1 FROM boxes b WHERE a.doc_id = b.doc_id AND a.entity_type = b.entity_type AND b.seq < a.seq AND NOT (a.x = b.x AND a.y = b.y AND a.width = b.width)
      AND a.x >= b.x - 0.01 AND a.y >= b.y - 0.01 AND a.x + a.width <= b.x + b.width + 0.01 AND a.y + a.height <= b.y + b.height + 0.01)""")
def uncontained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that no earlier one of their type holds."""
    return grouping.contained(_boxes(spark, sf_dir)).select("doc_id", "seq")


@query(f"""WITH {BOXES} SELECT doc_id, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height, count(*) FILTER (WHERE width < 11) AS n_narrow FROM boxes GROUP BY 1""")
def union_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, A24."""
    rows = _boxes(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("bbox").alias("b"))
    u = geometry.union_box(F.col("b"))
    return rows.select("doc_id", u["x"].alias("x"), u["y"].alias("y"), u["width"].alias("width"), u["height"].alias("height"), F.size(F.filter("b", lambda b: b["width"] < 11)).cast("long").alias("n_narrow"))


@query(f"""WITH {BOXES} SELECT doc_id, seq, 10 * (height * 0.64::DOUBLE) * 0.6::DOUBLE AS needed, CASE WHEN 10 * (height * 0.64::DOUBLE) * 0.6::DOUBLE <= 0.9::DOUBLE * width THEN 'fits' WHEN 10 * (height * 0.64::DOUBLE) * 0.6::DOUBLE <= width THEN 'tight' ELSE 'overflows' END AS fit FROM boxes""")
def replacement_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F21, F43, P21 for a token of ten characters."""
    token = F.lit("[DNI 0001]")
    b = _boxes(spark, sf_dir)
    return b.select("doc_id", "seq", geometry.token_width(F.length(token), F.col("bbox.height")).alias("needed"), geometry.fit_label(token, F.col("bbox")).alias("fit"))


# ---- rules, edits, conflicts

RULES = [("r1", "type", None, "BUILDING", "mask", 5, True), ("r2", "type", None, "BUILDING", "redact", 9, True), ("r3", "type", None, "MACHINERY", "synthetic", 1, False), ("r4", "global", None, None, "mask", 1, True), ("r5", "group", "7", None, "redact", 2, True), ("r6", "group", "7", None, "mask", 2, True)]


@query("SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey = 7 THEN 'redact' WHEN c_mktsegment = 'BUILDING' THEN 'redact' ELSE 'mask' END AS mode FROM customer")
def rule_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as groups of one document, their segments as types."""
    groups = read_table(spark, sf_dir, "customer").select(F.lit(1).cast("long").alias("doc_id"), F.col("c_custkey").cast("string").alias("group_id"), F.col("c_mktsegment").alias("entity_type"), "c_custkey")
    rules = spark.createDataFrame([(r[0], 1, *r[1:]) for r in RULES], "rule_id string, doc_id long, scope string, target_group_id string, target_type string, mode string, priority int, enabled boolean")
    out = replace.resolve_modes(groups, rules)
    return out.select("c_custkey", F.col("entity_type").alias("c_mktsegment"), "mode")


@query("""SELECT o_orderkey, 'updated' AS op, 'o_orderstatus' AS changed FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderstatus <> 'X'
UNION ALL SELECT o_orderkey, 'removed', NULL FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 13 <> 0
UNION ALL SELECT o_orderkey, 'created', NULL FROM orders WHERE o_orderkey % 13 = 0 AND o_orderkey % 11 <> 0""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of a table, rows gone, new and changed."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    before = o.filter("o_orderkey % 13 <> 0")
    after = o.filter("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return edits.diff(before, after, "o_orderkey").select("o_orderkey", "op", F.array_join("changed", ",").alias("changed"))


@query(f"""WITH {GROUPS}, firsts2 AS (SELECT doc_id, entity_type, min(index_in_type) AS index_in_type, sum(n_members)::BIGINT AS n_members FROM groups GROUP BY 1, 2) SELECT * FROM firsts2""")
def merged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities of a type merged into the first."""
    o = occurrences(docs(spark, sf_dir))
    g = grouping.exact_groups(o)
    first = g.filter("index_in_type = 1").select("doc_id", "entity_type", F.col("group_id").alias("survivor"))
    plan = g.join(first, ["doc_id", "entity_type"]).select("survivor", F.col("group_id").alias("absorbed"))
    merged, _ = edits.merge(g, grouping.members(o, g), plan)
    return merged.select("doc_id", "entity_type", F.col("index_in_type").cast("int").alias("index_in_type"), "n_members")


@query(f"WITH {FOUND} SELECT doc_id, seq::BIGINT AS seq FROM occ WHERE NOT (page_index = 0)")
def dropped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the occurrences of each document's first page."""
    o = occurrences(docs(spark, sf_dir))
    first = o.select("doc_id").distinct().withColumn("page_index", F.lit(0))
    return edits.drop_occurrences(o, "regex", first).select("doc_id", "seq")


@query("""SELECT user_id AS conflict_id, CASE WHEN max(value) FILTER (WHERE event_type = (SELECT min(event_type) FROM events)) >= coalesce(max(value) FILTER (WHERE event_type <> (SELECT min(event_type) FROM events)), -1) THEN 'regex' ELSE 'other' END AS winner FROM events GROUP BY 1""")
def default_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most confident candidate, on ties the pattern's; events as candidates, the first kind as the pattern."""
    ev = read_table(spark, sf_dir, "events")
    first = ev.agg(F.min("event_type").alias("first"))
    own = F.when(F.col("event_type") == F.col("first"), "regex").otherwise("other")
    top = ev.crossJoin(F.broadcast(first)).groupBy("user_id", own.alias("source")).agg(F.max("value").alias("confidence"))
    c = top.groupBy(F.col("user_id").alias("conflict_id")).agg(F.collect_list(F.struct("source", F.col("source").alias("entity_type"), "confidence", F.col("source").alias("value"))).alias("candidates"))
    return edits.default_candidate(c).select("conflict_id", F.col("default_type").alias("winner"))


# ---- word-level rules


@query(f"""WITH {PAGES}, up AS (SELECT *, regexp_matches(text, '\\p{{Lu}}') AND NOT regexp_matches(text, '\\p{{Ll}}') AND NOT regexp_matches(text, '\\.\\p{{L}}') AND length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= 2 AS up FROM words),
near AS (SELECT *, up AND (coalesce(lag(up) OVER p, false) OR coalesce(lead(up) OVER p, false)) AS near FROM up WINDOW p AS (PARTITION BY doc_id, page_index ORDER BY word_index))
SELECT doc_id, page_index, word_index, substr(text, 1, k) || lower(substr(text, k + 1)) AS text FROM (SELECT *, length(regexp_extract(text, '^([^\\p{{L}}]*)', 1)) + 1 AS k FROM near WHERE near)""")
def title_cased_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that runs of capitals change."""
    w = views.words(views.pages(docs(spark, sf_dir)))
    key = ["doc_id", "page_index", "word_index"]
    win = Window.partitionBy("doc_id", "page_index").orderBy("word_index")
    up = w.withColumn("was", F.col("text")).withColumn("u", ner.upper_run(F.col("text")))
    up = up.withColumn("n", F.col("u") & (F.coalesce(F.lag("u").over(win), F.lit(False)) | F.coalesce(F.lead("u").over(win), F.lit(False))))
    return ner.title_runs(up).filter("n").select(*key, "text")


@query(f"WITH {PAGES} SELECT doc_id, page_index, (word_index // 256)::INTEGER AS chunk, count(*) AS n_words FROM words GROUP BY 1, 2, 3")
def inference_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W15."""
    return ner.chunks(views.words(views.pages(docs(spark, sf_dir)))).groupBy("doc_id", "page_index", "chunk").agg(F.count("*").alias("n_words"))


@query(f"WITH {PAGES} SELECT doc_id, sum(32 + 2 * length(text) + 2 * 3 + 48)::BIGINT AS bytes FROM words GROUP BY 1")
def word_cache_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources have names of three letters."""
    return report.cache_bytes(views.words(views.pages(docs(spark, sf_dir))))


@query(f"WITH {PAGES} SELECT doc_id, list_sort(list(length(text)))[count(*) // 2 + 1]::INTEGER AS median_length FROM pages GROUP BY 1")
def upper_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median of a document's line lengths."""
    p = views.pages(docs(spark, sf_dir)).groupBy("doc_id").agg(F.collect_list(F.length("text")).alias("n"))
    return p.select("doc_id", report.upper_median(F.col("n")).alias("median_length"))


@query(f"WITH {PAGES} SELECT doc_id, page_index, coalesce(sum(length(text) + 16.0) OVER (PARTITION BY doc_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS top FROM pages")
def page_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as high as their text is long."""
    p = views.pages(docs(spark, sf_dir)).select("doc_id", "page_index", F.length("text").cast("double").alias("height"))
    return report.page_slots(p).select("doc_id", "page_index", "top")


@query("SELECT doc_id, substr(regexp_replace(text, '[\\x00-\\x1F\\x7F]', '', 'g'), 1, 500) AS title FROM documents")
def clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: texts as metadata."""
    return docs(spark, sf_dir).select("doc_id", labels.clean_metadata(F.col("text")).alias("title"))


# ---- evaluation

TRUTH = f"{FOUND}, truth AS (SELECT * FROM occ WHERE pattern_id IN ('email', 'ipv4')), det AS (SELECT * FROM occ WHERE pattern_id <> 'ipv4' OR doc_id % 3 <> 0)"


@query(f"""WITH {TRUTH},
hit AS (SELECT t.doc_id, t.seq, bool_or(d.doc_id IS NOT NULL) AS covered, coalesce(bool_or(d.entity_type = t.entity_type), false) AS typed FROM truth t LEFT JOIN det d ON t.doc_id = d.doc_id AND t.page_index = d.page_index AND contains(lower(d.value), lower(t.value)) GROUP BY 1, 2),
wrong AS (SELECT doc_id, count(*) AS n FROM det d WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.doc_id = d.doc_id AND t.page_index = d.page_index AND (contains(lower(d.value), lower(t.value)) OR contains(lower(t.value), lower(d.value)))) GROUP BY 1),
a AS (SELECT doc_id, count(*) AS n_truth, count(*) FILTER (WHERE covered) AS n_covered, count(*) FILTER (WHERE typed) AS n_typed FROM hit GROUP BY 1),
b AS (SELECT doc_id, count(*) AS n_detected FROM det GROUP BY 1)
SELECT coalesce(a.doc_id, b.doc_id) AS document_id, coalesce(n_truth, 0) AS n_truth, coalesce(n_covered, 0) AS n_covered, coalesce(n_typed, 0) AS n_typed, coalesce(n_detected, 0) AS n_detected, coalesce(n, 0) AS n_false
FROM a FULL JOIN b ON a.doc_id = b.doc_id LEFT JOIN wrong w ON w.doc_id = coalesce(a.doc_id, b.doc_id)""")
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mails and hosts are the truth; of the detections, hosts of every third document are missing."""
    truth, det = _evaluated(spark, sf_dir)
    return report.evaluation(truth, det)


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = occurrences(docs(spark, sf_dir)).select(F.col("doc_id").alias("document_id"), "entity_type", "value", "page_index", "pattern_id")
    det = o.filter("pattern_id <> 'ipv4' OR document_id % 3 <> 0").drop("pattern_id")
    return o.filter("pattern_id IN ('email', 'ipv4')").drop("pattern_id"), det


@query(f"""WITH {TRUTH}, t AS (SELECT count(*) AS n FROM truth), c AS (SELECT count(*) AS n FROM truth WHERE pattern_id <> 'ipv4' OR doc_id % 3 <> 0), d AS (SELECT count(*) AS n FROM det)
SELECT t.n::BIGINT AS n_truth, c.n::BIGINT AS n_covered, d.n::BIGINT AS n_detected, c.n / t.n AS recall FROM t, c, d""")
def evaluation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    return report.totals(report.evaluation(*_evaluated(spark, sf_dir))).select("n_truth", "n_covered", "n_detected", "recall")


# ---- events


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 50")
def newest_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 of each user's events."""
    ev = read_table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return report.newest(ev, ["user_id"], "at", 50).select("user_id", "event_id")


@query("SELECT user_id AS doc_id, least(count(*), 20)::BIGINT AS current, least(count(*), 20) / 20.0 AS share FROM events GROUP BY 1")
def stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25."""
    return report.progress(read_table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id")), 20).select("doc_id", F.col("current").cast("long").alias("current"), "share")


# ---- layout and streams


@query(f"""WITH {PAGES}, wide AS (SELECT doc_id, page_index, x - 6 AS x0, x + greatest(6.0 * length(text), 1) + 6 AS x1 FROM words),
span AS (SELECT doc_id, page_index, least(greatest(floor(x0 / 595.0 * 64), 0), 63)::INTEGER AS c0, least(greatest(ceil(x1 / 595.0 * 64) - 1, 0), 63)::INTEGER AS c1 FROM wide),
cols AS (SELECT DISTINCT doc_id, page_index, unnest(range(c0, greatest(c0, c1) + 1)) AS c FROM span)
SELECT doc_id, page_index, count(*) * 4 AS n_cells FROM cols GROUP BY 1, 2""")
def occupied_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each page's grid that words take; a line of words takes four rows of cells."""
    from ..operators import layout

    w = views.words(views.pages(docs(spark, sf_dir)))
    return layout.occupied_cells(w, views.PAGE_WIDTH, views.PAGE_HEIGHT).groupBy("doc_id", "page_index").agg(F.count("*").alias("n_cells"))


@query(f"WITH {PAGES} SELECT doc_id, page_index, sum(word_index * (word_index + 1))::BIGINT AS mark, count(*) AS n_words FROM words GROUP BY 1, 2")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a line are read from left to right; mark weighs each word's number by its place."""
    from ..operators import layout

    read = layout.text_reading_order(views.pages(docs(spark, sf_dir)))
    weighed = F.aggregate(F.transform("reading", lambda word, at: word.cast("long") * (at + 1)), F.lit(0).cast("long"), lambda s, v: s + v)
    return read.groupBy("doc_id", "page_index").agg(F.sum(weighed).alias("mark"), F.sum(F.size("reading").cast("long")).alias("n_words"))


@query("SELECT user_id, max(event_id) AS event_id, max(value) AS value FROM events GROUP BY 1")
def latest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest request of each key with the highest priority."""
    from ..streaming import sessions

    return sessions.latest(read_table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("user_id", "event_id", "value")


@query("SELECT event_id, user_id, event_type FROM events")
def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream with bounded batches, without repeats, drained into files."""
    from ..sources.staging import folder
    from ..streaming import sessions

    s = sessions.table_stream(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return sessions.drained(sessions.distinct_stream(s, ["event_id"], "ts", "3650 days"), folder(spark, "events")).select("event_id", "user_id", "event_type")


@query(f"WITH {GROUPS} SELECT doc_id, 'created' AS op, entity_type, canonical_value, index_in_type, n_members FROM groups")
def streamed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections as a stream with the ends of both detectors; the changes it sends at the barrier are the
    entities of the batch."""
    from ..sources.staging import folder
    from ..streaming import sessions

    o = occurrences(docs(spark, sf_dir))
    box = F.struct(*(F.col(f"bbox.{n}").alias(n) for n in ("x", "y", "width", "height")))
    found = o.select("doc_id", "seq", F.lit("found").alias("kind"), "entity_type", "page_index", "value", "normalized_value", "source", "confidence", box.alias("bbox"))
    end = o.groupBy("doc_id").agg((F.max("seq") + 1).alias("seq"))
    ends = [end.select("doc_id", "seq", F.lit(k).alias("kind")) for k in ("regex_finished", "ner_finished")]
    rows = found.unionByName(ends[0], allowMissingColumns=True).unionByName(ends[1], allowMissingColumns=True)
    path = folder(spark, "entities")
    rows.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    return sessions.drained(sessions.resolved(stream), path, "update").select("doc_id", "op", "entity_type", "canonical_value", "index_in_type", "n_members")


# ---- inline cases, the same rows on both sides

SAMPLES = [
    (1, 0, "Titular: Juan Pérez, DNI 34.567.891, CUIT 20-34567891-4, malo 20-12345678-9."),
    (1, 1, "al +54 11 1234-5678 o 011 4567-8902, MP-12345-6, patente ABC 123 o AB 123 CD o A 123 BCD, vence 15/3/30."),
    (1, 2, "Autos: López, María Fernanda c/ Empresa, 7 de julio de 2026, Av. Corrientes 1234, IBAN ES91 2100 0418 4502 0005 1332"),
    (1, 3, "domicilio real en San Martín 450, Matrícula Profesional: 4567, código A34.567.891"),
]


@query("""SELECT * FROM (VALUES (0, 'dni-ar', '34.567.891', '34567891'), (0, 'cuit-ar', '20-34567891-4', '20345678914'), (0, 'phone-mobile-ar', '20-12345678', '2012345678'), (1, 'phone-mobile-ar', '+54 11 1234-5678', '541112345678'),
(1, 'phone-landline-ar', '011 4567-8902', '01145678902'), (1, 'license-ar', 'MP-12345-6', 'MP123456'), (1, 'plate-vieja-ar', 'ABC 123', 'ABC123'), (1, 'plate-mercosur-ar', 'AB 123 CD', 'AB123CD'),
(1, 'plate-mercosur-moto-ar', 'A 123 BCD', 'A123BCD'), (1, 'date-ar', '15/3/30', '15/03/2030'), (2, 'caratula-ar', 'López, María Fernanda', 'maria fernanda lopez'), (2, 'date-textual-ar', '7 de julio de 2026', '07/07/2026'),
(2, 'address-keyword-ar', 'Av. Corrientes 1234', 'av. corrientes 1234'), (2, 'iban', 'ES91 2100 0418 4502 0005 1332', 'ES9121000418450200051332'), (3, 'address-keyword-ar', 'San Martín 450', 'san martin 450'),
(3, 'license-ar', '4567', '4567')) v(page_index, pattern_id, value, normalized_value)""")
def pattern_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 to R4, R6, R8 to R15, F8 to F12, P1, P2 on cases whose results are known."""
    page = spark.createDataFrame(SAMPLES, "doc_id long, page_index int, text string")
    return detect.detect(page, corpus_patterns(("maria",))).select("page_index", "pattern_id", "value", "normalized_value")


LEXICON = [(1, "María", "F"), (2, "Juan", "M"), (3, "Cruz", "A"), (4, "JUAN", "M"), (5, "Ariel", "F"), (6, "ariel", "M"), (7, "J.", "M"), (8, "X1", "F"), (9, "", "F"), (10, "Zoe", "Q"), (11, "María José", "F"), (12, "José", "M")]


@query("SELECT * FROM (VALUES ('ariel', 'm'), ('cruz', 'ambiguous'), ('jose', 'm'), ('juan', 'm'), ('maria', 'f'), ('maria jose', 'f')) v(name, label)")
def lexicon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of a name wins; names with dots or digits, without a known label or empty are left out."""
    return views.lexicon_rows(spark.createDataFrame(LEXICON, "line long, name string, label string"))


@query("SELECT * FROM (VALUES (1, 'f'), (2, 'm'), (3, 'f'), (4, NULL), (5, NULL), (6, 'm')) v(id, person_gender)")
def person_genders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names but the last, else the first; initials and ambiguous names say nothing."""
    people = spark.createDataFrame([(1, "María José Pérez"), (2, "Juan Pérez"), (3, "MARÍA Zeta Pérez"), (4, "Cruz Díaz"), (5, "J. Pérez"), (6, "juan")], "id int, canonical_value string")
    return grouping.genders(people, lexicon_rows(spark, sf_dir)).select("id", "person_gender")


@query("SELECT * FROM (VALUES (0, 9, 'PERSON', 0.8::DOUBLE, 'Ana Perez'), (13, 17, 'ORGANIZATION', 0.6, 'Acme')) v(start, \"end\", entity_type, confidence, value)")
def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's tokens as spans."""
    tokens = [("B-PER", 0.9, "Ana"), ("I-PER", 0.7, "Per"), ("B-PER", 0.8, "##ez"), ("O", 0.9, "de"), ("B-ORG", 0.6, "Ac"), ("I-LOC", 0.6, "##me"), ("O", 0.9, "/")]
    rows = spark.createDataFrame([(1, 0, 0, k, e, s, w) for k, (e, s, w) in enumerate(tokens)], "doc_id long, page_index int, chunk int, token_index int, entity string, score double, word string")
    texts = spark.createDataFrame([(1, 0, 0, "Ana Perez de Acme / S vive")], "doc_id long, page_index int, chunk int, text string")
    return ner.repaired(ner.label_spans(ner.positioned(rows, texts)), texts).select("start", "end", "entity_type", F.round("confidence", 6).alias("confidence"), "value")


@query("SELECT * FROM (VALUES (1, 'calle Mitre 450'), (2, 'calle Mitre'), (3, 'calle Mitre nro. 45'), (4, 'calle Mitre'), (5, 'calle 9')) v(id, value)")
def address_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a street takes its number, unless that goes on as something else."""
    rows = [(1, "calle Mitre 450 y", 0, 11), (2, "calle Mitre 450/2", 0, 11), (3, "calle Mitre nro. 45, x", 0, 11), (4, "calle Mitre 12,5", 0, 11), (5, "calle 9 450", 0, 7)]
    df = spark.createDataFrame([(*r, "ADDRESS") for r in rows], "id int, text string, start int, end int, entity_type string")
    return ner.extended_addresses(df).select("id", "value")


@query("SELECT * FROM (VALUES ('c1', 'PERSON,ORGANIZATION', 'b,a'), ('c2', 'DNI,PHONE', 'x')) v(conflict_id, types, spellings)")
def candidate_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types by confidence, the pattern's first on ties; spellings as first seen."""
    rows = [("c1", [("ner", "ORGANIZATION", 0.6, "b"), ("ner", "PERSON", 0.9, "a")]), ("c2", [("ner", "PHONE", 1.0, "x"), ("regex", "DNI", 1.0, "x")])]
    df = spark.createDataFrame(rows, "conflict_id string, candidates array<struct<source:string,entity_type:string,confidence:double,value:string>>")
    return edits.candidate_types(df).select("conflict_id", F.array_join("types", ",").alias("types"), F.array_join("spellings", ",").alias("spellings"))


@query("SELECT * FROM (VALUES (1, 'a', 10.0::DOUBLE, 1, 2), (1, 'b', 30.0, 4, 4)) v(page_index, replacement_id, shift, first, last)")
def repaint_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that move to make room, up to the next replacement; nothing moves where the room ends."""
    from ..operators import repaint

    box = lambda x, w: (float(x), 0.0, float(w), 10.0, None)
    words = [(1, 1, k, f"w{k}", box(x, 20)) for k, x in enumerate((0, 25, 50, 100, 125))] + [(1, 2, 0, "w", box(0, 20)), (1, 2, 1, "w", box(70, 20))]
    spans = [(1, 1, "a", box(0, 20), 30.0), (1, 1, "b", box(100, 20), 50.0), (1, 2, "c", box(0, 20), 30.0)]
    kind = "struct<x:double,y:double,width:double,height:double,rotation:int>"
    w = spark.createDataFrame(words, f"doc_id long, page_index int, word_index int, text string, bbox {kind}")
    r = spark.createDataFrame(spans, f"doc_id long, page_index int, replacement_id string, bbox {kind}, token_width double")
    return repaint.plans(r, w, 200.0).select("page_index", "replacement_id", "shift", "first", "last")


@query(f"""WITH {SEARCH}, hits AS (SELECT r.doc_id, r.page_index, r.word_index FROM rows r WHERE token LIKE 'mail%'),
{GROUPS.split(PAGES + ",", 1)[1]}
SELECT DISTINCT h.doc_id, h.page_index, h.word_index AS start_index, CASE WHEN g.n_members IS NULL THEN 'unmarked' WHEN g.n_members < 2 THEN 'hidden' ELSE 'disabled' END AS status
FROM hits h LEFT JOIN occ o ON h.doc_id = o.doc_id AND h.page_index = o.page_index AND h.word_index BETWEEN o.first_word AND o.last_word
LEFT JOIN groups g ON g.doc_id = o.doc_id AND g.entity_type = o.entity_type AND g.normalized_value = o.normalized_value""")
def match_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with a part that begins with "mail", and whether an entity hides them; entities that occur twice
    are off here."""
    page = views.pages(docs(spark, sf_dir))
    words = views.words(page)
    found = detect.find_text(words, "mail")
    box = words.select("doc_id", "page_index", F.col("word_index").alias("start_index"), "bbox")
    o = occurrences(docs(spark, sf_dir))
    g = grouping.exact_groups(o).withColumn("enabled", F.col("n_members") < 2)
    placed = found.join(box, ["doc_id", "page_index", "start_index"])
    return report.match_status(placed, grouping.members(o, g), g).select("doc_id", "page_index", "start_index", "status").distinct()

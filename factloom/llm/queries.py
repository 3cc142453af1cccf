"""Queries of the problems on text and record linkage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.typed import ref_of
from factloom.llm import components, formatting, leaks, packing, quality, resolution
from factloom.runtime import spread, table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = table(spark, sf_dir, "datoms").where("a = 'same_as'").select("e", ref_of(F.col("v")).alias("other"))
    return components.components(same, "e", "other").select(F.col("first").alias("e_first"), F.col("member").alias("e_other"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.pairs(resolution.resolve(table(spark, sf_dir, "datoms")))


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.resolve(table(spark, sf_dir, "datoms"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.datom_copies(table(spark, sf_dir, "datoms"))[1]


def p6_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.datom_copies(table(spark, sf_dir, "datoms"))[0]


def p8_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.contexts(_texts(spark, sf_dir))


def p8_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document, whether its text is packed whole and as it must be."""
    docs = _texts(spark, sf_dir)
    return packing.checked(docs, packing.contexts(docs))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(packing.contexts(_texts(spark, sf_dir)))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.found(leaks.leaks(_texts(spark, sf_dir), table(spark, sf_dir, "probes")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(_texts(spark, sf_dir))


def p10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.text_stats(_texts(spark, sf_dir))


QUERIES = {
    "p3_found": p3_found, "p5_found": p5_found, "p5_clusters": p5_clusters, "p8_contexts": p8_contexts, "p8_checked": p8_checked, "p8_fill": p8_fill, "p6_found": p6_found, "p6_copies": p6_copies, "p9_found": p9_found, "p10_found": p10_found, "p10_stats": p10_stats,
}

_RECORDS = r"""
WITH r AS (SELECT id, a, lower(upper(coalesce(v, ''))) AS v, regexp_split_to_array(lower(upper(coalesce(quote.text, ''))), '[;|\r\n]+') AS parts FROM datoms WHERE a IN ('defined_as', 'caution') AND id IS NOT NULL),
c AS (SELECT id, a, regexp_replace(v, '[\s\p{Z}\p{P}\p{C}`~^|]+', '', 'g') AS body,
             list_sort(list_distinct(list_filter(list_transform(parts, lambda p:
               (CASE WHEN regexp_matches(p, '[:=]') THEN regexp_replace(regexp_extract(p, '^([^:=]*)', 1), '[\s\p{Z}\p{P}\p{C}`~^|]+', '', 'g') ELSE '' END) || chr(1) ||
               regexp_replace(regexp_replace(p, '^[^:=]*[:=]', ''), '[\s\p{Z}\p{P}\p{C}`~^|]+', '', 'g')), lambda x: x <> chr(1)))) AS f FROM r),
o AS (SELECT id, min(a || chr(2) || body || chr(2) || array_to_string(f, chr(3))) AS k FROM c GROUP BY id),
g AS (SELECT k, min(id) AS id_first, count(*) AS copies FROM o GROUP BY k)
"""

# The statistics of quality.py and the rule list, once more; the list of common words is the parameter both share.
_SPACE = r"[ \t\n\x0B\f\r]"
_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(t, '[\r\n]+'), lambda x: length(trim(x)) > 0)) AS line FROM d),
w AS (SELECT doc_id, line, list_filter(regexp_split_to_array(lower(line), '[^\p{{L}}]+'), lambda x: x <> '') AS ws FROM l),
c AS (SELECT doc_id, line, length(line) AS n, len(ws) AS w, len(list_filter(ws, lambda x: list_contains({list(quality.COMMON)}, x))) AS c, length(regexp_replace(line, '[\p{{L}}\p{{N}} \t\n\x0B\f\r.,;:''"!?()-]+', '', 'g')) AS s,
  regexp_matches(line, '[.!?:;…»”"]{_SPACE}*$') AS e,
  regexp_matches(line, '^{_SPACE}*(?:[-*+•|]|\d+[.)]|\[.?\]|[a-z]\)|<)') OR regexp_matches(line, '\t| \| |;{_SPACE}*[^ \t\n\x0B\f\r]+;|[,;][^ \t\n\x0B\f\r]+[,;][^ \t\n\x0B\f\r]+[,;]|[^ \t\n\x0B\f\r] {{3,}}[^ \t\n\x0B\f\r].* {{3,}}[^ \t\n\x0B\f\r]|\(\d{{4}}\).*\d[):].*\d') AS li FROM w),
p AS (SELECT *, w >= {quality.PROSE_WORDS} AND c >= {quality.PROSE_COMMON} * w AND s <= {quality.PROSE_SYMBOLS} * n AS pr FROM c),
x AS (SELECT doc_id, sum(n) AS n, sum(w) AS w, sum(c) AS c, sum(s) AS s, count(*) FILTER (e) AS e, coalesce(sum(n) FILTER (pr), 0) AS p, coalesce(sum(n) FILTER (li AND NOT pr), 0) AS l, count(*) AS k FROM p GROUP BY doc_id),
y AS (SELECT d.doc_id, t, coalesce(n, 0) AS n, coalesce(w, 0)::BIGINT AS w, coalesce(c, 0) AS c, coalesce(s, 0) AS s, coalesce(e, 0) AS e, coalesce(p, 0) AS p, coalesce(l, 0) AS l, coalesce(k, 0) AS k, length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{{Nd}}]+', '', 'g')) AS dg,
  length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS up, len(regexp_extract_all(t, '\p{{Ll}}\p{{Lu}}|[,;!?]\p{{L}}|\p{{Ll}}\.\p{{L}}|{_SPACE}[,;.!?]')) AS od, len(regexp_extract_all(t, '[.!?…](?:{_SPACE}|$|["”»''’)])')) AS ends,
  len(list_distinct(regexp_split_to_array(lower(t), '[^\p{{L}}]+'))) AS df, length(t) - length(regexp_replace(t, '[^ \t\n\x0B\f\r]{{25,}}', '', 'g')) AS lg FROM d LEFT JOIN x USING (doc_id)),
z AS (SELECT doc_id, t, w AS words, coalesce(round(letters / nullif(w, 0), 6), 0.0) AS mean_word, coalesce(round(c / nullif(w, 0), 6), 0.0) AS common, coalesce(round(s / nullif(n, 0), 6), 0.0) AS symbols, coalesce(round(dg / nullif(n, 0), 6), 0.0) AS digits,
  coalesce(round(e / nullif(k, 0), 6), 0.0) AS punctuated_lines, coalesce(round(p / nullif(n, 0), 6), 0.0) AS prose_lines, coalesce(round(l / nullif(n, 0), 6), 0.0) AS listed_lines, coalesce(round(od / nullif(w, 0), 6), 0.0) AS odd,
  coalesce(round(df / nullif(sqrt(w), 0), 6), 0.0) AS distinct_, coalesce(round(w / nullif(greatest(ends, 1), 0), 6), 0.0) AS per_sentence, coalesce(round(up / nullif(letters, 0), 6), 0.0) AS upper, coalesce(round(lg / nullif(n, 0), 6), 0.0) AS long_words FROM y)
"""

SQL = {
    "p3_found": """
WITH RECURSIVE l AS (SELECT e AS u, json_extract_string(v, '$.ref') AS w FROM datoms WHERE a = 'same_as'),
b AS (SELECT u, w FROM l WHERE u <> w UNION SELECT w, u FROM l WHERE u <> w),
r AS (SELECT u AS e, u AS m FROM b UNION SELECT b.u, r.m FROM r JOIN b ON b.w = r.e WHERE r.m < b.u)
SELECT min(m) AS e_first, e AS e_other FROM r GROUP BY e HAVING min(m) <> e""",
    "p6_found": _RECORDS + "SELECT id_first, id AS id_other FROM o JOIN g USING (k) WHERE id <> id_first",
    "p8_checked": "SELECT doc_id, true AS whole, true AS fits FROM documents",
    "p10_stats": _QUALITY + 'SELECT doc_id, words, mean_word, common, symbols, digits, punctuated_lines, prose_lines, listed_lines, odd, distinct_ AS "distinct", per_sentence, upper, long_words FROM z',
    "p10_found": _QUALITY + f"SELECT doc_id FROM z WHERE length(trim(t)) > 0 AND ({quality.case_expression(quality.load_rules()).replace('distinct ', 'distinct_ ')}) = 1",
    "p6_copies": _RECORDS + "SELECT id_first, copies FROM g",
}

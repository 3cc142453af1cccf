"""Queries of the general data-processing problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import changefeed, hierarchy, latedata, lineage, widetable
from factloom.runtime import table

CELLS = ["dose_mg", "half_life_min", "shelf_months", "otc", "date", "form"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.settled_keys(table(spark, sf_dir, "tx"))


def p1_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled keys with the columns of their promotes, each as it was set last."""
    return changefeed.settled_decisions(table(spark, sf_dir, "tx"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latedata.tx_split(table(spark, sf_dir, "tx"))[1].select("id")


def p2_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = latedata.period_counts(latedata.tx_split(table(spark, sf_dir, "tx"))[0])
    return hours.select(F.col("key").alias("portal"), F.col("period").alias("hour_ms"), "n")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = widetable.attribute_types(table(spark, sf_dir, "attrs"), CELLS)
    return widetable.cells(widetable.wide_table(table(spark, sf_dir, "datoms"), types))


def p4_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widetable.wide_table(table(spark, sf_dir, "datoms"), widetable.attribute_types(table(spark, sf_dir, "attrs")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.tx_hierarchy(table(spark, sf_dir, "tx"))


def p7_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.descendants(hierarchy.tx_links(table(spark, sf_dir, "tx")), "id", "prev", hierarchy.NEAR)


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.path_index(hierarchy.tx_links(table(spark, sf_dir, "tx")), "id", "prev", hierarchy.NEAR)


def p7_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of every transaction, its ids divided by blanks."""
    return lineage.all_paths(_index(spark, sf_dir)).select("id", F.array_join("path", " ").alias("path"))


def p7_path_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of the last transaction of each portal."""
    last = table(spark, sf_dir, "tx").groupBy("portal").agg(F.max(F.struct(F.get("hlc", F.lit(0)), F.get("hlc", F.lit(1)), "id")).alias("x")).select("x.id")
    return lineage.paths(_index(spark, sf_dir), last).select("id", F.array_join("path", " ").alias("path"))


def p7_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every transaction, as a range of numbers within its tree."""
    return lineage.intervals(hierarchy.tx_links(table(spark, sf_dir, "tx")), "id", "prev", hierarchy.NEAR)


QUERIES = {
    "p1_found": p1_found, "p1_columns": p1_columns, "p2_found": p2_found, "p2_hours": p2_hours, "p4_found": p4_found, "p4_wide": p4_wide, "p7_found": p7_found, "p7_descendants": p7_descendants,
    "p7_paths": p7_paths, "p7_path_of": p7_path_of, "p7_intervals": p7_intervals,
}

_ARRIVED = """
WITH f AS (SELECT id, min(seq) AS seq, arg_min(portal, seq) AS portal, arg_min(hlc[1], seq) AS wall FROM tx GROUP BY id),
m AS (SELECT *, max(wall) OVER (PARTITION BY portal ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM f)
"""

_VALUES = r"""
WITH r AS (SELECT e, a, vf, id, regexp_replace(v, '^\s+|\s+$', '', 'g') AS s FROM datoms WHERE tier = 'culture' AND a IN ('dose_mg','half_life_min','shelf_months','otc','date','form')),
u AS (SELECT *, CASE a WHEN 'dose_mg' THEN regexp_replace(lower(s), '\s*(mg|milligrams?)\.?$', '')
                      WHEN 'half_life_min' THEN regexp_replace(lower(s), '\s*(minutes?|mins?)\.?$', '')
                      WHEN 'shelf_months' THEN regexp_replace(lower(s), '\s*(months?|mos?)\.?$', '') END AS num,
             regexp_replace(lower(s), '^(\d{4}.\d{1,2}.\d{1,2})[t ]\d{1,2}:\d{2}.*$', '\1') AS day FROM r),
d AS (SELECT *, CASE
        WHEN regexp_full_match(day, '\d{4}([-/.])\d{1,2}[-/.]\d{1,2}') THEN replace(replace(day, '/', '-'), '.', '-')
        WHEN regexp_full_match(day, '\d{8}') THEN day[1:4] || '-' || day[5:6] || '-' || day[7:8]
        WHEN regexp_full_match(day, '\d{1,2}[-/.]\d{1,2}[-/.]\d{4}') THEN regexp_replace(day, '^(\d+)[-/.](\d+)[-/.](\d+)$', '\3-\2-\1')
        WHEN regexp_full_match(day, '\d{1,2}\.?\s+[a-z]+\.?\s+\d{4}') THEN regexp_extract(day, '(\d{4})$', 1) || '-' ||
             (list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], regexp_extract(day, '([a-z]{3})', 1)))::VARCHAR || '-' || regexp_extract(day, '^(\d+)', 1)
      END AS iso FROM u),
c AS (SELECT e, a, vf, id, CASE
        WHEN num IS NOT NULL THEN CASE WHEN regexp_full_match(num, '[+-]?(\d+|\d{1,3}(,\d{3})+)(\.0+)?') THEN TRY_CAST(replace(regexp_replace(num, '\.0+$', ''), ',', '') AS BIGINT)::VARCHAR END
        WHEN a = 'otc' THEN CASE WHEN lower(s) IN ('true','t','yes','y','1') THEN 'true' WHEN lower(s) IN ('false','f','no','n','0') THEN 'false' END
        WHEN a = 'date' THEN TRY_CAST(iso AS DATE)::VARCHAR
        ELSE nullif(s, '') END AS val FROM d)
"""

_TREE = """
WITH RECURSIVE t AS (SELECT id, min(nullif(prev, '')) AS prev FROM tx WHERE id IS NOT NULL GROUP BY id),
down AS (SELECT t.id, t.prev, t.id AS root, t.id AS path FROM t WHERE prev IS NULL OR prev NOT IN (SELECT id FROM t) UNION ALL SELECT t.id, t.prev, down.root, down.path || ' ' || t.id FROM down JOIN t ON t.prev = down.id)"""

_WIDE = r"""
cells AS (SELECT e, a, vf, id, val FROM c UNION ALL SELECT d.e, d.a, d.vf, d.id, CASE WHEN k.vtype = 'ref' THEN nullif(regexp_replace(json_extract_string(CASE WHEN json_valid(d.v) THEN d.v END, '$.ref'), '^\s+|\s+$', '', 'g'), '') ELSE nullif(regexp_replace(d.v, '^\s+|\s+$', '', 'g'), '') END
  FROM datoms d JOIN attrs k ON k.a = d.a WHERE d.tier = 'culture' AND d.e IS NOT NULL AND d.a NOT IN ('dose_mg','half_life_min','shelf_months','otc','date','form')),
w AS (SELECT e, a, val FROM (SELECT *, row_number() OVER (PARTITION BY e, a ORDER BY vf DESC NULLS LAST, coalesce(id, ''), val) AS n FROM cells WHERE val IS NOT NULL AND e IS NOT NULL) WHERE n = 1)
SELECT e"""
_WIDE_COLUMNS = {"author": "", "causes": "", "caution": "", "contains": "", "date": "::DATE", "defined_as": "", "dose_mg": "::BIGINT", "form": "", "half_life_min": "::BIGINT", "is_a": "", "located_in": "", "name": "", "otc": "::BOOLEAN", "part_of": "", "same_as": "", "shelf_months": "::BIGINT", "treats": ""}

SQL = {
    "p1_columns": """
WITH p AS (SELECT DISTINCT id, portal, hlc[1] AS wall, hlc[2] AS counter, kind, payload FROM tx WHERE kind IN ('promote', 'retract')),
k AS (SELECT id, portal, wall, counter, kind, json_extract_string(payload, '$.decision.key') AS fact_key, json_extract_string(payload, '$.decision.support')::BIGINT AS support, json_extract_string(payload, '$.decision.rule') AS rule FROM p WHERE kind = 'promote'
      UNION ALL SELECT id, portal, wall, counter, kind, unnest(from_json(json_extract(payload, '$.keys'), '["VARCHAR"]')), NULL, NULL FROM p WHERE kind = 'retract'),
o AS (SELECT *, row_number() OVER (PARTITION BY fact_key ORDER BY wall, counter, portal, id) AS n FROM k WHERE fact_key IS NOT NULL),
r AS (SELECT fact_key, max(n) AS gone FROM o WHERE kind = 'retract' GROUP BY 1)
SELECT o.fact_key, arg_max(id, n) AS tx_id, arg_max(support, n) FILTER (support IS NOT NULL) AS support, arg_max(rule, n) FILTER (rule IS NOT NULL) AS rule FROM o LEFT JOIN r ON r.fact_key = o.fact_key WHERE kind = 'promote' AND (gone IS NULL OR n > gone) GROUP BY 1""",
    "p4_wide": _VALUES + "," + _WIDE + "".join(f", max(CASE WHEN a = '{a}' THEN val END){t} AS {a}" for a, t in _WIDE_COLUMNS.items()) + " FROM w GROUP BY e",
    "p7_paths": _TREE + " SELECT id, path FROM down",
    "p7_path_of": _TREE + " SELECT id, path FROM down WHERE id IN (SELECT arg_max(id, {'w': hlc[1], 'c': hlc[2], 'i': id}) FROM tx GROUP BY portal)",
    "p7_intervals": _TREE + """,
up AS (SELECT id, prev AS above FROM down WHERE prev IN (SELECT id FROM t) UNION ALL SELECT up.id, t.prev FROM up JOIN t ON t.id = up.above WHERE t.prev IN (SELECT id FROM t)),
z AS (SELECT down.id, down.prev, down.root, 1 + coalesce(n, 0) AS size FROM down LEFT JOIN (SELECT above, count(*) AS n FROM up GROUP BY above) u ON u.above = down.id),
f AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY prev ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z),
g AS (SELECT id, root, size, 1::BIGINT AS first FROM f WHERE id = root UNION ALL SELECT f.id, f.root, f.size, (g.first + 1 + f.before)::BIGINT FROM g JOIN f ON f.prev = g.id AND f.id <> f.root),
rest AS (SELECT t.id, t.prev FROM t ANTI JOIN down ON t.id = down.id),
walk AS (SELECT id, id AS cur, 0 AS n FROM rest UNION ALL SELECT walk.id, rest.prev, n + 1 FROM walk JOIN rest ON rest.id = walk.cur WHERE n < 2 * (SELECT count(*) FROM rest))
SELECT id, root, first, (first + size - 1)::BIGINT AS last FROM g UNION ALL SELECT id, min(cur), NULL, NULL FROM walk WHERE n >= (SELECT count(*) FROM rest) GROUP BY id""",
    "p1_found": """
WITH p AS (SELECT DISTINCT id, portal, hlc[1] AS wall, hlc[2] AS counter, kind, payload FROM tx WHERE kind IN ('promote', 'retract')),
k AS (SELECT id, portal, wall, counter, kind, json_extract_string(payload, '$.decision.key') AS fact_key FROM p WHERE kind = 'promote'
      UNION ALL SELECT id, portal, wall, counter, kind, unnest(from_json(json_extract(payload, '$.keys'), '["VARCHAR"]')) FROM p WHERE kind = 'retract')
SELECT fact_key, id AS tx_id FROM (SELECT *, row_number() OVER (PARTITION BY fact_key ORDER BY wall DESC, counter DESC, portal DESC, id DESC) AS n FROM k WHERE fact_key IS NOT NULL)
WHERE n = 1 AND kind = 'promote'""",
    "p2_found": _ARRIVED + "SELECT id FROM m WHERE mark - wall > 7200000",
    "p2_hours": _ARRIVED + "SELECT portal, (wall // 3600000) * 3600000 AS hour_ms, count(*) AS n FROM m WHERE mark IS NULL OR mark - wall <= 7200000 GROUP BY ALL",
    "p4_found": _VALUES + """
SELECT e, a, val FROM (SELECT *, row_number() OVER (PARTITION BY e, a ORDER BY vf DESC NULLS LAST, id) AS n FROM c WHERE val IS NOT NULL) WHERE n = 1""",
    "p7_found": """
WITH RECURSIVE t AS (SELECT id, min(nullif(prev, '')) AS prev FROM tx GROUP BY id),
down AS (SELECT t.id, t.id AS root, 1::BIGINT AS depth FROM t WHERE prev IS NULL OR prev NOT IN (SELECT id FROM t)
         UNION ALL SELECT t.id, down.root, down.depth + 1 FROM down JOIN t ON t.prev = down.id),
rest AS (SELECT t.id, t.prev FROM t ANTI JOIN down ON t.id = down.id),
walk AS (SELECT id, id AS cur, 0 AS n FROM rest
         UNION ALL SELECT walk.id, rest.prev, n + 1 FROM walk JOIN rest ON rest.id = walk.cur WHERE n < 2 * (SELECT count(*) FROM rest))
SELECT id, root, depth FROM down
UNION ALL SELECT id, min(cur) AS root, -1::BIGINT AS depth FROM walk WHERE n >= (SELECT count(*) FROM rest) GROUP BY id""",
    "p7_descendants": """
WITH RECURSIVE t AS (SELECT id, min(nullif(prev, '')) AS prev FROM tx GROUP BY id),
down AS (SELECT t.id, t.prev FROM t WHERE prev IS NULL OR prev NOT IN (SELECT id FROM t) UNION ALL SELECT t.id, t.prev FROM down JOIN t ON t.prev = down.id),
up AS (SELECT id, prev AS above FROM down WHERE prev IN (SELECT id FROM t) UNION ALL SELECT up.id, t.prev FROM up JOIN t ON t.id = up.above WHERE t.prev IN (SELECT id FROM t))
SELECT down.id, coalesce(n, 0)::BIGINT AS descendants FROM down LEFT JOIN (SELECT above, count(*) AS n FROM up GROUP BY above) u ON u.above = down.id
UNION ALL SELECT id, NULL FROM t WHERE id NOT IN (SELECT id FROM down)""",
}

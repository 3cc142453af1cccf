"""Queries of the fact engine over the tables tx, datoms, directives, sources, attrs and documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import runtime
from factloom.functions import canon, text
from factloom.operators import aliases, bulk, extract, facts, feed, hierarchy, log, replay, search
from factloom.runtime import table
from factloom.sources import texts

NOW = 1_760_200_000_000
QUESTION = "Which fungus treats fever or nausea, and what causes sleeplessness?"
NEEDLE = "Treats"
#: Characters of a content hash that the maps of the test tables hold.
STORED_HASH = 24

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _tx(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tx")


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    """(e, rep) of the entities that identity attributes make one with another."""
    named = table(spark, d, "datoms").join(_tx(spark, d).select(F.col("id").alias("tx")), "tx", "left_semi")
    return aliases.representatives(aliases.identity_links(named, table(spark, d, "attrs")))


def _facts(spark: SparkSession, d: str, also: tuple[str, ...] = (), same: DataFrame | None = None) -> DataFrame:
    return facts.located(table(spark, d, "datoms"), _tx(spark, d), also, _aliases(spark, d) if same is None else same)


def _live(spark: SparkSession, d: str, *also: str, same: DataFrame | None = None) -> DataFrame:
    """Live facts with the columns named besides their keys; the located ones are written once, as most queries read them several times."""
    located, _ = runtime.Scratch(spark, "facts").write(_facts(spark, d, also, same))
    return facts.alive(located, replay.retractions(_tx(spark, d)))


def _promoted(live: DataFrame) -> DataFrame:
    return facts.in_tier(live, "culture").select(F.col("culture_key").alias("key"))


def _shown(spark: SparkSession, d: str, *also: str) -> DataFrame:
    same, _ = runtime.Scratch(spark, "aliases").write(_aliases(spark, d))
    live = _live(spark, d, *also, same=same)
    return facts.displayed(live, facts.names(live), same)


# ---- pieces of SQL

_T = """t AS (SELECT *, hlc[1] AS wall, hlc[2] AS counter, {'w': hlc[1], 'c': hlc[2], 'p': portal, 'i': id} AS rk, {'l': portal <> 'steward', 'w': hlc[1], 'c': hlc[2], 'p': portal, 'i': id} AS lk
  FROM tx WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1)"""
_VAL = """CASE WHEN v LIKE '{%' AND json_valid(v) AND json_extract_string(v, '$.ref') IS NOT NULL THEN '{"ref":' || to_json(json_extract_string(v, '$.ref')) || '}' ELSE to_json(v)::VARCHAR END"""
_NORM = "lower(regexp_replace(trim({}, ' ' || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g'))"
_AL = f"""lk AS (SELECT DISTINCT d.e, 'e:' || sha256('["ident",' || to_json(d.a) || ',' || to_json({_NORM.format('d.v')}) || ']')[1:24] AS i FROM datoms d JOIN t ON t.id = d.tx WHERE d.a IN (SELECT a FROM attrs WHERE uniq = 'identity') AND d.e IS NOT NULL AND d.v IS NOT NULL),
b AS (SELECT e AS u, i AS w FROM lk WHERE e <> i UNION SELECT i, e FROM lk WHERE e <> i), rr AS (SELECT u AS e, u AS m FROM b UNION SELECT b.u, rr.m FROM rr JOIN b ON b.w = rr.e WHERE rr.m < b.u),
al AS (SELECT e, min(m) AS rep FROM rr GROUP BY e HAVING min(m) <> e)"""
_F = f"""{_AL}, f0 AS (SELECT d.id, d.e, d.a, d.v, d.nu, d.vf, d.quote, d.support, d.tier, d.source, d.tx, t.rk AS pos FROM datoms d JOIN t ON t.id = d.tx WHERE d.id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY d.id ORDER BY t.rk DESC) = 1),
f1 AS (SELECT f0.*, coalesce(al.rep, f0.e) AS rep FROM f0 LEFT JOIN al ON al.e = f0.e),
f AS (SELECT *, 'k:' || sha256('[' || to_json(tier) || ',' || to_json(rep) || ',' || to_json(a) || ',' || {_VAL} || ',null]')[1:32] AS key,
      'k:' || sha256('["culture",' || to_json(rep) || ',' || to_json(a) || ',' || {_VAL} || ',null]')[1:32] AS ckey FROM f1)"""
_R = """r AS (SELECT key, max(rk) AS pos FROM (SELECT rk, unnest(from_json(json_extract(payload, '$.keys'), '["VARCHAR"]')) AS key FROM t WHERE kind = 'retract') GROUP BY key),
ap AS (SELECT key, max(rk) AS pos FROM (SELECT rk, unnest(from_json(json_extract(payload, '$.keys'), '["VARCHAR"]')) AS key FROM t WHERE kind = 'approve') GROUP BY key)"""
_L = """ev AS (SELECT key, arg_max(op, pos) AS op, max(pos) AS event_at FROM (SELECT key, pos, 'assert' AS op FROM f UNION ALL SELECT key, pos, 'retract' FROM r) GROUP BY key),
l AS (SELECT f.*, ev.event_at FROM f JOIN ev USING (key) WHERE ev.op = 'assert')"""
_N = """n AS (SELECT rep AS e, arg_max(v, {'a': pos, 'i': id}) AS name FROM l WHERE a = 'name' GROUP BY rep),
s AS (SELECT l.*, coalesce(n.name, l.e) AS entity, coalesce(m.name, l.ref, l.v) AS value FROM (SELECT l.*, coalesce(al.rep, l.ref0) AS ref FROM (SELECT *, CASE WHEN v LIKE '{%' AND json_valid(v) THEN json_extract_string(v, '$.ref') END AS ref0 FROM l) l LEFT JOIN al ON al.e = l.ref0) l
      LEFT JOIN n ON n.e = l.rep LEFT JOIN n m ON m.e = l.ref)"""
_LIVE = f"WITH RECURSIVE {_T}, {_F}, {_R}, {_L}"
_SHOWN = f"{_LIVE}, {_N}"
_DEPTH = """p AS (SELECT id, min(nullif(prev, '')) AS prev FROM tx WHERE id IS NOT NULL GROUP BY id),
g AS (SELECT id, 1::BIGINT AS depth FROM p WHERE prev IS NULL OR prev NOT IN (SELECT id FROM p) UNION ALL SELECT p.id, g.depth + 1 FROM g JOIN p ON p.prev = g.id)"""
_P = "json_extract_string(payload, '$.{}')"


# ---- sources


@query("SELECT doc_id::VARCHAR AS id, name, sha256(text) AS hash FROM documents")
def source_listing(spark, d):
    return texts.listing(texts.table_texts(table(spark, d, "documents"), "doc_id", "name", "text"))


@query("SELECT hash, count(*) AS n, min(id) AS first FROM (SELECT sha256(text) AS hash, doc_id::VARCHAR AS id FROM documents) GROUP BY hash")
def source_duplicates(spark, d):
    return texts.duplicates(texts.table_texts(table(spark, d, "documents"), "doc_id", "name", "text"))


@query(f"""WITH {_T}, pl AS (SELECT source, arg_max(json_extract_string(payload, '$.places."' || source || '"'), rk) AS hash FROM (SELECT rk, payload, unnest(json_keys(payload, '$.places')) AS source FROM t WHERE kind = 'map') GROUP BY 1)
SELECT s.id, s.hash, s.name FROM (SELECT DISTINCT source_id AS id, hash[1:24] AS hash, name FROM sources UNION ALL SELECT 'doc:' || doc_id, sha256(text)[1:24], name FROM documents) s LEFT JOIN pl ON pl.source = s.id WHERE s.hash IS DISTINCT FROM pl.hash""")
def changed_sources(spark, d):
    """Listed sources and documents whose content is not what any portal mapped last; the maps of these tables hold the first 24 characters of a hash."""
    s = table(spark, d, "sources").select(F.col("source_id").alias("id"), "hash", "name").distinct()
    docs = texts.listing(texts.table_texts(table(spark, d, "documents"), "doc_id", "name", "text")).withColumn("id", F.concat(F.lit("doc:"), "id"))
    listed = s.unionByName(docs).withColumn("hash", F.substring("hash", 1, STORED_HASH))
    return texts.changed(listed, replay.last_places(_tx(spark, d)))


@query("SELECT DISTINCT source_id AS id, name, hash FROM sources UNION ALL SELECT 'doc:' || doc_id, name, sha256(text) FROM documents")
def source_union(spark, d):
    s = table(spark, d, "sources").select(F.col("source_id").alias("id"), "name", "hash").distinct()
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), "name", F.sha2("text", 256).alias("hash"))
    return texts.union(s, docs)


@query("SELECT DISTINCT source_id AS id, coalesce(name, source_id) AS name, hash[1:12] AS hash, dense_rank() OVER (ORDER BY lower(coalesce(name, source_id)), source_id) AS n FROM (SELECT DISTINCT * FROM sources)")
def sources_sorted(spark, d):
    s = table(spark, d, "sources").distinct().select(F.col("source_id").alias("id"), F.coalesce("name", "source_id").alias("name"), F.substring("hash", 1, 12).alias("hash"))
    ranks = search.numbered(s.select(F.lower("name").alias("l"), "id").distinct(), ["l", "id"], "n")
    return s.withColumn("l", F.lower("name")).join(ranks, ["id", "l"]).select("id", "name", "hash", "n")


# ---- the log


@query(f"WITH {_T} SELECT id, seq, kind, portal, wall, counter FROM t")
def log_once(spark, d):
    return log.once(_tx(spark, d), "kind", "portal", "hlc").select("id", "seq", "kind", "portal", log.wall().alias("wall"), log.counter().alias("counter"))


@query(f"""WITH {_T} SELECT id, sha256('{{' || concat_ws(',', '"agent":' || to_json(agent), '"directive":' || to_json(directive), '"hlc":[' || wall || ',' || counter || ']', '"kind":' || to_json(kind), '"model_hash":' || to_json(model_hash),
 '"payload_hash":' || to_json(payload_hash), '"portal":' || to_json(portal), '"prev":' || coalesce(to_json(prev)::VARCHAR, 'null'), '"signer":' || coalesce(to_json(signer)::VARCHAR, 'null'), '"skill":' || to_json(skill), '"skill_current":' || skill_current, '"skill_version":' || skill_version,
 '"source":' || to_json(source), '"source_hash":' || to_json(source_hash), '"tier":' || coalesce(to_json(tier)::VARCHAR, 'null')) || '}}') AS header_hash FROM t""")
def header_hashes(spark, d):
    return log.header_hashes(_tx(spark, d))


_ROLES = """roles AS (SELECT signer, arg_max(role, rk) AS role FROM (SELECT rk, unnest(json_keys(payload, '$.roles')) AS signer, 'steward' AS role FROM t WHERE kind = 'genesis'
 UNION ALL SELECT rk, json_extract_string(payload, '$.pub'), json_extract_string(payload, '$.role') FROM t WHERE kind = 'admit') GROUP BY signer)"""
_STEWARD = "('genesis', 'admit', 'schema', 'approve', 'pause', 'resume', 'skill')"
_PORTAL = "('directive', 'assert', 'expire', 'promote', 'map', 'retract', 'dream')"


@query(f"WITH {_T}, {_ROLES} SELECT signer, role FROM roles")
def signer_roles(spark, d):
    return log.roles(_tx(spark, d))


_ROWS = f"""rv AS (SELECT id, CASE WHEN role IS NULL THEN 'V6' WHEN kind IN {_STEWARD} AND role <> 'steward' THEN 'V7' WHEN kind IN {_PORTAL} AND role <> 'portal' THEN 'V8' WHEN kind NOT IN {_STEWARD} AND kind NOT IN {_PORTAL} THEN 'V9'
  WHEN tier = 'culture' AND kind <> 'promote' THEN 'V10' END AS "check", CASE WHEN role IS NULL THEN 'unknown signer' WHEN kind IN {_STEWARD} AND role <> 'steward' THEN 'only the steward may sign ' || kind
  WHEN kind IN {_PORTAL} AND role <> 'portal' THEN 'only arbiter code on a portal may sign ' || kind WHEN kind NOT IN {_STEWARD} AND kind NOT IN {_PORTAL} THEN 'unknown kind ' || kind ELSE 'only the promotion gate writes to culture' END AS reason FROM t LEFT JOIN roles USING (signer)
 UNION ALL SELECT id, 'V15', CASE WHEN json_extract_string(payload, '$.withheld') = 'true' THEN 'only episode payloads may be withheld' ELSE 'payload does not match header' END FROM t
  WHERE CASE WHEN json_extract_string(payload, '$.withheld') = 'true' THEN tier NOT LIKE 'episode:%' OR tier IS NULL ELSE sha256(payload) IS DISTINCT FROM payload_hash END)"""


@query(f"WITH {_T}, {_ROLES}, {_ROWS} SELECT * FROM rv WHERE \"check\" IS NOT NULL")
def row_violations(spark, d):
    return log.row_violations(_tx(spark, d), raw_payloads=True)


@query(f"""WITH {_T}, j AS (SELECT t.id, t.portal, t.prev, q.portal AS pp FROM t LEFT JOIN t q ON q.id = t.prev)
SELECT id, 'V12' AS "check", 'missing parent in portal chain' AS reason FROM j WHERE prev IS NOT NULL AND pp IS NULL
UNION ALL SELECT id, 'V13', 'parent belongs to another portal' FROM j WHERE pp IS NOT NULL AND pp <> portal
UNION ALL SELECT id, 'V14', 'fork: ' || portal || ' signed two transactions after one parent' FROM (SELECT id, portal, row_number() OVER (PARTITION BY portal, prev ORDER BY lk) AS n FROM t) WHERE n > 1""")
def chain_violations(spark, d):
    return log.chain_violations(_tx(spark, d))


@query(f"""WITH {_T}, i AS (SELECT {_P.format('id')} AS directive, arg_max(portal, rk) AS owner, arg_max({_P.format('expires')}::BIGINT, rk) AS expires, arg_max(coalesce({_P.format('budget')}::BIGINT, 50), rk) AS budget FROM t WHERE kind = 'directive' GROUP BY 1),
x AS (SELECT tx AS id, count(DISTINCT id) AS facts FROM datoms WHERE a <> 'name' GROUP BY tx),
c AS (SELECT t.id, t.kind, t.portal, t.wall, i.*, x.facts, row_number() OVER (PARTITION BY t.directive ORDER BY lk) > 1 AS again FROM t LEFT JOIN i ON i.directive = t.directive LEFT JOIN x ON x.id = t.id WHERE kind IN ('assert', 'expire')),
z AS (SELECT id, CASE WHEN owner IS NULL OR owner <> portal THEN 'V16only the issuing portal can close a directive' WHEN again THEN 'V17directive already closed' WHEN kind = 'assert' AND wall >= expires THEN 'V18result after the directive expired'
 WHEN kind = 'assert' AND facts > budget THEN 'V19result over budget' WHEN kind = 'expire' AND (expires IS NULL OR wall < expires) THEN 'V18expiry before the directive''s deadline' END AS y FROM c)
SELECT id, y[1:3] AS "check", y[4:] AS reason FROM z WHERE y IS NOT NULL""")
def closing_violations(spark, d):
    return log.closing_violations(_tx(spark, d), table(spark, d, "datoms"))


@query(f"""WITH {_T} SELECT id, 'V20' AS "check", 'a published skill version never changes; publish a new one' AS reason FROM (SELECT id, name, version, row_number() OVER (PARTITION BY name, version ORDER BY lk) AS n FROM
 (SELECT id, lk, {_P.format('name')} AS name, {_P.format('version')}::BIGINT AS version FROM t WHERE kind = 'skill')) WHERE n > 1 OR (name = 'ingest' AND version = 1)""")
def skill_violations(spark, d):
    return log.skill_violations(_tx(spark, d))


_GENESIS = f"""WITH {_T} SELECT id, 'V3' AS "check", 'the log must start with a genesis transaction' AS reason FROM (SELECT id, kind FROM t ORDER BY lk LIMIT 1) WHERE kind <> 'genesis'
UNION ALL SELECT id, 'V4', 'genesis must be signed by the steward it names' FROM t WHERE kind = 'genesis' AND NOT coalesce(signer = {_P.format('steward')} AND json_extract_string(payload, '$.roles."' || signer || '"') = 'steward', false)
UNION ALL SELECT id, 'V5', 'this log already has a genesis; the transaction belongs to another network' FROM t WHERE kind = 'genesis' AND lk > (SELECT min(lk) FROM t WHERE kind = 'genesis')"""
_ALL = " UNION ALL ".join(f"SELECT id, \"check\", reason FROM ({x})" for x in (_GENESIS, *(SQL[k] for k in ("row_violations", "chain_violations", "closing_violations", "skill_violations"))))


@query(f'SELECT "check", reason, count(*) AS n FROM ({_ALL}) GROUP BY ALL')
def log_violations(spark, d):
    return log.violations(_tx(spark, d), table(spark, d, "datoms"), raw_payloads=True).groupBy("check", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_T}, z AS (SELECT portal, prev, signer, id, lk, row_number() OVER (PARTITION BY portal, prev, signer ORDER BY lk) AS n FROM t),
y AS (SELECT portal, prev, signer, max(CASE WHEN n = 1 THEN id END) AS a, max(CASE WHEN n = 2 THEN id END) AS b, min(lk) AS lk FROM z WHERE n <= 2 GROUP BY ALL)
SELECT portal, prev, a, b FROM (SELECT *, row_number() OVER (PARTITION BY portal, prev ORDER BY lk) AS k FROM y WHERE b IS NOT NULL) WHERE k = 1""")
def fork_proofs(spark, d):
    return log.fork_proofs(_tx(spark, d))


@query(f"WITH RECURSIVE {_DEPTH} SELECT id, depth FROM g")
def chain_depth(spark, d):
    return hierarchy.tx_hierarchy(_tx(spark, d)).where("depth > 0").select("id", "depth")


@query(f"WITH RECURSIVE {_DEPTH}, {_T} SELECT portal, arg_max(id, {{'d': depth, 's': -seq}}) AS id, max(depth) AS depth FROM g JOIN t USING (id) GROUP BY portal")
def chain_tip(spark, d):
    return log.tips(hierarchy.tx_hierarchy(_tx(spark, d)), _tx(spark, d))


_CUT = f"""WITH RECURSIVE {_DEPTH}, {_T}, fp AS (SELECT DISTINCT portal, prev FROM (SELECT portal, prev, signer FROM t GROUP BY ALL HAVING count(*) > 1)),
cut AS (SELECT fp.portal, min(CASE WHEN fp.prev IS NULL THEN 0 ELSE g.depth END) AS cut FROM fp LEFT JOIN g ON g.id = fp.prev GROUP BY fp.portal HAVING min(CASE WHEN fp.prev IS NULL THEN 0 ELSE g.depth END) IS NOT NULL)"""


@query(f"{_CUT} SELECT portal, cut FROM cut")
def fork_cut(spark, d):
    t = _tx(spark, d)
    return log.fork_cuts(log.fork_proofs(t), hierarchy.tx_hierarchy(t).where("depth > 0"))


@query(f"{_CUT} SELECT id, depth FROM g JOIN t USING (id) LEFT JOIN cut USING (portal) WHERE cut IS NULL OR depth <= cut")
def valid_log(spark, d):
    t = _tx(spark, d)
    depths, _ = runtime.Scratch(spark, "depths").write(hierarchy.tx_hierarchy(t).where("depth > 0"))
    return log.valid(t, depths, log.fork_proofs(t)).select("id", "depth")


@query(f"WITH {_T} SELECT DISTINCT portal FROM (SELECT portal, prev, signer FROM t GROUP BY ALL HAVING count(*) > 1)")
def frozen_portals(spark, d):
    return log.fork_proofs(_tx(spark, d)).select("portal").distinct()


@query(f"WITH {_T} SELECT (SELECT count(*) FROM t) - k + 1 AS n, id, kind, portal, tier, wall, directive FROM (SELECT *, row_number() OVER (ORDER BY seq DESC) AS k FROM t) WHERE k > 60 AND k <= 120")
def log_page(spark, d):
    return log.page(_tx(spark, d), 60, 60)


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS now FROM events), w AS (SELECT *, max(now) OVER (PARTITION BY user_id ORDER BY event_id) AS wall FROM e)
SELECT user_id, event_id, wall, row_number() OVER (PARTITION BY user_id, wall ORDER BY event_id) - 1 AS counter FROM w""")
def hlc_assign(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("now"))
    return log.hybrid_clock(e, "now", "event_id", "user_id").select(F.col("user_id").cast("bigint").alias("user_id"), "event_id", "wall", "counter")


@query(f"""WITH {_T}, {_ROLES}, z AS (SELECT portal, prev, signer, id, lk, row_number() OVER (PARTITION BY portal, prev, signer ORDER BY lk) AS n FROM t),
y AS (SELECT portal, prev, signer, max(CASE WHEN n = 1 THEN id END) AS a, max(CASE WHEN n = 2 THEN id END) AS b, min(lk) AS lk FROM z WHERE n <= 2 GROUP BY ALL)
SELECT portal, prev, a, b FROM (SELECT *, row_number() OVER (PARTITION BY portal, prev ORDER BY lk) AS k FROM y WHERE b IS NOT NULL) WHERE k = 1 AND signer IN (SELECT signer FROM roles)""")
def checked_fork_proofs(spark, d):
    t = _tx(spark, d)
    return log.checked_proofs(log.fork_proofs(t).select("portal", "prev", "a", "b"), t)


@query(f"WITH {_T}, h AS (SELECT id FROM t WHERE seq <= (SELECT max(seq) // 2 FROM tx)) SELECT id, kind FROM (SELECT * FROM tx WHERE seq > (SELECT max(seq) // 2 FROM tx) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1) WHERE id NOT IN (SELECT id FROM h)")
def log_append(spark, d):
    """What a second delivery adds to the log: the later half of the arrivals against the earlier one."""
    t = _tx(spark, d)
    half = F.broadcast(t.agg(F.expr("max(seq) div 2").alias("half")))
    early, late = t.join(half).where("seq <= half").drop("half"), t.join(half).where("seq > half").drop("half")
    return log.append(early, late).select("id", "kind")


@query(f"WITH {_T} SELECT id, payload FROM t WHERE id = (SELECT min(id) FROM tx)")
def tx_lookup(spark, d):
    t = _tx(spark, d)
    first = F.broadcast(t.agg(F.min("id").alias("id")))
    return log.once(t.join(first, "id", "left_semi"), "payload").select("id", "payload")


# ---- replay


@query(f"WITH {_T}, {_R} SELECT key, ap.pos.w AS wall, ap.pos.i AS tx FROM ap")
def approvals(spark, d):
    return replay.approvals(_tx(spark, d)).select("key", F.col("at.wall").alias("wall"), F.col("at.id").alias("tx"))


@query(f"WITH {_T} SELECT coalesce(arg_max(kind, rk) = 'pause', false) AS paused FROM t WHERE kind IN ('pause', 'resume')")
def replay_paused(spark, d):
    return replay.paused(_tx(spark, d))


@query(f"""WITH {_T}, s AS (SELECT rk, payload, unnest(json_keys(payload, '$.attrs')) AS a FROM t WHERE kind = 'schema'),
m AS (SELECT a, arg_max(json_extract(payload, '$.attrs.' || a), rk) AS j FROM s GROUP BY a)
SELECT a, json_extract_string(j, '$.card') AS card, json_extract_string(j, '$.unique') AS uniq, json_extract_string(j, '$.kind') AS kind, json_extract_string(j, '$.ref')::BOOLEAN AS ref FROM m
UNION ALL SELECT a, card, uniq, kind, ref FROM attrs WHERE a NOT IN (SELECT a FROM m)""")
def replay_schema(spark, d):
    return replay.schema(_tx(spark, d), table(spark, d, "attrs"))


@query(f"""WITH {_T}, s AS (SELECT {_P.format('name')} AS name, {_P.format('version')}::BIGINT AS version, arg_max(array_to_string(from_json(json_extract(payload, '$.tools'), '["VARCHAR"]'), ','), rk) AS tools FROM t WHERE kind = 'skill' GROUP BY 1, 2)
SELECT * FROM s UNION ALL SELECT 'ingest', 1, 'read_source' WHERE NOT EXISTS (SELECT 1 FROM s WHERE name = 'ingest' AND version = 1)""")
def replay_skills(spark, d):
    return replay.skills(_tx(spark, d)).withColumn("tools", F.array_join("tools", ","))


@query(f"""WITH {_T}, s AS (SELECT {_P.format('name')} AS name, {_P.format('version')}::BIGINT AS version, arg_max(from_json(json_extract(payload, '$.tools'), '["VARCHAR"]'), rk) AS tools FROM t WHERE kind = 'skill' GROUP BY 1, 2),
u AS (SELECT * FROM s UNION ALL SELECT 'ingest', 1, ['read_source'] WHERE NOT EXISTS (SELECT 1 FROM s WHERE name = 'ingest' AND version = 1)), z AS (SELECT name, arg_max(tools, version) AS latest FROM u GROUP BY name)
SELECT d.skill, d.skill_version AS version, coalesce(array_to_string(list_filter(u.tools, lambda x: list_contains(z.latest, x)), ','), '') AS tools FROM (SELECT DISTINCT skill, skill_version FROM directives) d LEFT JOIN u ON u.name = d.skill AND u.version = d.skill_version LEFT JOIN z ON z.name = d.skill""")
def allowed_tools(spark, d):
    pinned = table(spark, d, "directives").select("skill", F.col("skill_version").alias("version"))
    return replay.allowed_tools(pinned, replay.skills(_tx(spark, d))).withColumn("tools", F.array_join("tools", ","))


_D = f"""dv AS (SELECT {_P.format('id')} AS directive, arg_max({{'source': {_P.format('source')}, 'budget': {_P.format('budget')}::BIGINT, 'expires': {_P.format('expires')}::BIGINT, 'portal': portal, 'issued': wall}}, rk) AS x, max(rk) AS pos FROM t WHERE kind = 'directive' GROUP BY 1),
od AS (SELECT dv.directive, x.source, x.budget, x.expires, x.portal, x.issued FROM dv LEFT JOIN (SELECT directive, max(rk) AS closed FROM t WHERE kind IN ('assert', 'expire') GROUP BY 1) c USING (directive) WHERE closed IS NULL OR closed < pos)"""


@query(f"WITH {_T}, {_D} SELECT * FROM od")
def open_directives(spark, d):
    return replay.open_directives(_tx(spark, d)).select("directive", "source", "budget", "expires", "portal", "issued")


@query(f"WITH {_T}, {_D} SELECT directive, portal, expires, {NOW} >= expires AS stale FROM od")
def stale_directives(spark, d):
    return replay.stale(replay.open_directives(_tx(spark, d)), NOW).select("directive", "portal", "expires", "stale")


@query(f"WITH {_T}, {_D} SELECT 'expire' AS kind, 'system' AS tier, portal, directive, '{{\"directive\":' || to_json(directive) || '}}' AS payload FROM od WHERE {NOW} >= expires")
def reconcile(spark, d):
    o = replay.open_directives(_tx(spark, d))
    due = o.where(F.lit(NOW) >= F.col("expires"))
    return due.select(F.lit("expire").alias("kind"), F.lit("system").alias("tier"), "portal", "directive", F.to_json(F.struct("directive")).alias("payload"))


_PL = """pl AS (SELECT portal, source, arg_max(json_extract_string(payload, '$.places."' || source || '"'), rk) AS hash FROM (SELECT portal, rk, payload, unnest(json_keys(payload, '$.places')) AS source FROM t WHERE kind = 'map') GROUP BY 1, 2)"""


@query(f"WITH {_T}, {_PL} SELECT portal, source, hash FROM pl")
def places(spark, d):
    return replay.places(_tx(spark, d))


@query(f"""WITH {_T} SELECT source, arg_max(json_extract_string(payload, '$.names."' || source || '"'), rk) AS name FROM (SELECT rk, payload, unnest(json_keys(payload, '$.names')) AS source FROM t WHERE kind = 'map') GROUP BY 1""")
def place_names(spark, d):
    return replay.place_names(_tx(spark, d))


@query(f"WITH {_T}, x AS (SELECT tx, count(DISTINCT id) AS facts FROM datoms WHERE a <> 'name' GROUP BY tx) SELECT t.id, t.directive, t.source, wall, coalesce(facts, 0) AS accepted, coalesce(json_array_length(payload, '$.rejected'), 0)::BIGINT AS refused FROM t LEFT JOIN x ON x.tx = t.id WHERE kind = 'assert'")
def results(spark, d):
    r = replay.results(_tx(spark, d), table(spark, d, "datoms"))
    return r.select("id", "directive", "source", "wall", "accepted", F.size("rejected").cast("bigint").alias("refused"))


@query(f"""WITH {_T}, nm AS (SELECT source, arg_max(json_extract_string(payload, '$.names."' || source || '"'), rk) AS name FROM (SELECT rk, payload, unnest(json_keys(payload, '$.names')) AS source FROM t WHERE kind = 'map') GROUP BY 1)
SELECT id, directive, coalesce(nm.name, t.source) AS name, wall FROM t LEFT JOIN nm ON nm.source = t.source WHERE kind = 'assert' ORDER BY rk DESC LIMIT 20""")
def results_recent(spark, d):
    t = _tx(spark, d)
    r = log.once(log.of_kind(t, "assert"), "directive", "source", "hlc", "portal").select("id", "directive", "source", log.wall().alias("wall"), log.replay_key().alias("at"))
    return replay.named_sources(r.orderBy(F.desc("at")).limit(20), replay.place_names(t)).select("id", "directive", "name", "wall")


@query(f"WITH {_T} SELECT reason, count(*) AS n FROM (SELECT unnest(from_json(json_extract(payload, '$.rejected'), '[{{\"reason\":\"VARCHAR\"}}]')).reason AS reason FROM t WHERE kind = 'assert') GROUP BY reason")
def refusal_histogram(spark, d):
    return replay.refusals(replay.results(_tx(spark, d), table(spark, d, "datoms")))


@query(f"WITH {_T} SELECT id, {_P.format('decision.key')} AS key, {_P.format('decision.support')}::BIGINT AS support, {_P.format('decision.rule')} AS rule FROM t WHERE kind = 'promote'")
def decisions(spark, d):
    return replay.decisions(_tx(spark, d))


@query(f"WITH {_T}, {_PL} SELECT portal, source FROM pl WHERE EXISTS (SELECT 1 FROM t WHERE kind = 'assert' AND t.source = pl.source AND t.source_hash[1:24] = pl.hash)")
def extracted_sources(spark, d):
    t = _tx(spark, d)
    done = log.of_kind(t, "assert").select("source", F.substring("source_hash", 1, STORED_HASH).alias("source_hash"))
    return replay.extracted(replay.places(t), done)


def _listed(spark, d) -> DataFrame:
    """(id, name, hash) of sources and documents, the hash cut as the maps of these tables have it."""
    s = table(spark, d, "sources").select(F.col("source_id").alias("id"), F.coalesce("name", "source_id").alias("name"), "hash").distinct()
    docs = texts.listing(texts.table_texts(table(spark, d, "documents"), "doc_id", "name", "text")).withColumn("id", F.concat(F.lit("doc:"), "id"))
    return s.unionByName(docs).withColumn("hash", F.substring("hash", 1, STORED_HASH))


_LISTED = "ls AS (SELECT DISTINCT source_id AS id, coalesce(name, source_id) AS name, hash[1:24] AS hash FROM sources UNION ALL SELECT 'doc:' || doc_id, name, sha256(text)[1:24] FROM documents)"
_DONE = "dn AS (SELECT DISTINCT source, source_hash[1:24] AS hash FROM t WHERE kind = 'assert')"


def _done(spark, d) -> DataFrame:
    return log.of_kind(_tx(spark, d), "assert").select(F.col("source").alias("id"), F.substring("source_hash", 1, STORED_HASH).alias("hash")).distinct()


@query(f"WITH {_T}, {_LISTED}, {_DONE} SELECT id, name FROM ls WHERE NOT EXISTS (SELECT 1 FROM dn WHERE dn.source = ls.id AND dn.hash = ls.hash)")
def bulk_queue(spark, d):
    """Listed sources and documents without a result for what they hold now."""
    return bulk.queue(_listed(spark, d), _done(spark, d), ["id", "hash"]).select("id", "name")


@query(f"WITH {_T}, {_LISTED}, {_DONE} SELECT id, name FROM ls WHERE id NOT IN (SELECT source FROM dn WHERE source IS NOT NULL) ORDER BY id LIMIT 1")
def next_source(spark, d):
    return bulk.next_source(_listed(spark, d), _done(spark, d), "id").select("id", "name")


@query(f"WITH {_T}, {_LISTED}, {_DONE} SELECT count(*) AS listed, count(*) FILTER (id IN (SELECT source FROM dn WHERE source IS NOT NULL)) AS done FROM ls")
def done_count(spark, d):
    return bulk.done_count(_listed(spark, d), _done(spark, d))


@query(f"WITH {_LISTED} SELECT id, name FROM ls WHERE contains(lower(name), 'ward')")
def source_filter(spark, d):
    return search.named_like(_listed(spark, d), "name", " Ward").select("id", "name")


@query(f"WITH {_T}, {_LISTED} SELECT DISTINCT source AS id FROM t WHERE kind = 'assert' AND source IN (SELECT id FROM ls)")
def selection_kept(spark, d):
    """Of the sources with results those that are still listed."""
    return search.still_listed(_done(spark, d).select("id").distinct(), _listed(spark, d))


_FROZEN = "fz AS (SELECT DISTINCT portal FROM (SELECT portal, prev, signer FROM t GROUP BY ALL HAVING count(*) > 1))"
_PAUSED = "(SELECT coalesce(arg_max(kind, rk) = 'pause', false) FROM t WHERE kind IN ('pause', 'resume'))"


@query(f"""WITH {_T}, {_PL}, {_D}, {_FROZEN}, o AS (SELECT portal, count(*) AS n FROM od GROUP BY 1) SELECT pl.portal, source, CASE WHEN portal IN (SELECT portal FROM fz) THEN 'frozen: this portal''s chain forked; the steward must re-key it'
WHEN {_PAUSED} THEN 'paused by the steward' WHEN coalesce(n, 0) >= 8 THEN 'open directive limit reached; expire stale directives first' END AS refused FROM pl LEFT JOIN o USING (portal)""")
def issuable_sources(spark, d):
    """Every mapped source with why no lease may be issued for it now, null where one may."""
    t = _tx(spark, d)
    return replay.issuable(replay.places(t), replay.open_directives(t), log.fork_proofs(t), replay.paused(t))


@query(f"""WITH {_T}, {_D}, nm AS (SELECT source, arg_max(json_extract_string(payload, '$.names."' || source || '"'), rk) AS name FROM (SELECT rk, payload, unnest(json_keys(payload, '$.names')) AS source FROM t WHERE kind = 'map') GROUP BY 1)
SELECT directive AS id, od.source, coalesce(nm.name, od.source) AS name, portal, issued, expires, {NOW} >= expires AS stale FROM od LEFT JOIN nm ON nm.source = od.source""")
def directives_list(spark, d):
    """Open directives in the order of their ids, with the names of their sources."""
    t = _tx(spark, d)
    o = replay.named_sources(replay.stale(replay.open_directives(t), NOW), replay.place_names(t))
    return o.select(F.col("directive").alias("id"), "source", "name", "portal", "issued", "expires", "stale").orderBy("id")


@query(f"""WITH {_T}, {_FROZEN}, {_ROLES}, {_ROWS}, vs AS ({_ALL}) SELECT count(*) FILTER (v) = 0 AS ok, (SELECT count(*) FROM t) AS count, count(*) FILTER (v) AS violations,
(SELECT count(*) FROM (SELECT DISTINCT portal, prev FROM (SELECT portal, prev, signer FROM t GROUP BY ALL HAVING count(*) > 1))) AS forks FROM (SELECT "check" <> 'V14' AS v FROM vs)""")
def verify_log(spark, d):
    return log.verify(_tx(spark, d), table(spark, d, "datoms"), hashed=False, raw_payloads=True)


# ---- facts


@query("SELECT DISTINCT v, 'e:' || sha256('[\"ident\",\"name\",' || to_json(lower(regexp_replace(trim(v, ' ' || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g'))) || ']')[1:24] AS e FROM datoms WHERE a = 'name' AND v IS NOT NULL")
def entity_ids(spark, d):
    return table(spark, d, "datoms").where("a = 'name' and v is not null").select("v").distinct().withColumn("e", canon.entity_id("name", F.col("v")))


@query(f"SELECT DISTINCT e, a, v, 'k:' || sha256('[\"culture\",' || to_json(e) || ',' || to_json(a) || ',' || {_VAL} || ',null]')[1:32] AS key FROM datoms")
def fact_keys(spark, d):
    return table(spark, d, "datoms").select("e", "a", "v").distinct().withColumn("key", canon.fact_key(F.lit("culture"), F.col("e"), F.col("a"), F.col("v")))


@query(f"{_LIVE} SELECT key, op, event_at.w AS wall FROM ev")
def last_events(spark, d):
    return facts.last_events(_facts(spark, d), replay.retractions(_tx(spark, d))).select("key", "op", F.col("event_at.wall").alias("wall"))


@query(f"{_LIVE} SELECT id, key FROM l")
def alive_facts(spark, d):
    return _live(spark, d).select("id", "key")


@query(f"{_LIVE} SELECT id, e, a, v FROM l WHERE tier = 'culture'")
def tier_scan(spark, d):
    return facts.in_tier(_live(spark, d), "culture").select("id", "e", "a", "v")


@query(f"{_LIVE} SELECT id, source, ckey AS culture_key FROM l WHERE tier LIKE 'episode:%'")
def episode_scan(spark, d):
    return facts.in_episodes(_live(spark, d, "source")).select("id", "source", "culture_key")


@query(f"WITH RECURSIVE {_T}, {_AL} SELECT e, rep FROM al")
def alias_components(spark, d):
    return _aliases(spark, d)


@query(f"{_SHOWN} SELECT e, name FROM n")
def entity_names(spark, d):
    return facts.names(_live(spark, d))


_EV = "g AS (SELECT ckey AS key, count(DISTINCT coalesce(source, chr(1))) AS support, min(id) AS rep, arg_min(id, {'a': pos, 'i': id}) AS first FROM l WHERE tier LIKE 'episode:%' GROUP BY ckey), pr AS (SELECT DISTINCT ckey AS key FROM l WHERE tier = 'culture')"


@query(f"{_LIVE}, {_EV} SELECT support, count(*) AS n FROM g GROUP BY support")
def gate_support_histogram(spark, d):
    return facts.groups(facts.in_episodes(_live(spark, d, "source"))).groupBy("support").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_LIVE}, {_EV} SELECT key, rep, support, CASE WHEN ap.key IS NOT NULL AND support < 2 THEN 'approved' ELSE 'auto' END AS rule FROM g LEFT JOIN ap USING (key) WHERE key NOT IN (SELECT key FROM pr) AND (support >= 2 OR ap.key IS NOT NULL) AND key NOT IN (SELECT key FROM r)")
def promotion_gate(spark, d):
    live, t = _live(spark, d, "source"), _tx(spark, d)
    return facts.gate(facts.in_episodes(live), _promoted(live), replay.approvals(t), replay.retractions(t))


@query(f"{_LIVE}, {_EV} SELECT key, rep, support, CASE WHEN support < 2 THEN 'approved' ELSE 'auto' END AS rule FROM g WHERE support >= 2 OR key IN (SELECT key FROM pr)")
def gate_with_approvals(spark, d):
    """The gate where every culture row counts as an approval of its key, and nothing is promoted yet."""
    live, t = _live(spark, d, "source"), _tx(spark, d)
    approved = facts.in_tier(live, "culture").groupBy(F.col("culture_key").alias("key")).agg(F.max("at").alias("at"))
    none = approved.where("false").select("key")
    return facts.gate(facts.in_episodes(live), none, approved, replay.retractions(t).where("false"))


@query(f"""{_LIVE}, x AS (SELECT ckey AS key, id, coalesce(source, chr(1)) AS source, event_at, min(event_at) OVER (PARTITION BY ckey) AS after FROM l WHERE tier LIKE 'episode:%')
SELECT key, min(id) AS rep, count(DISTINCT source) AS support, 'auto' AS rule FROM x WHERE event_at > after GROUP BY key HAVING count(DISTINCT source) >= 2""")
def gate_after_retract(spark, d):
    """The gate where every key was retracted at its first evidence, so that only later evidence counts."""
    live = facts.in_episodes(_live(spark, d, "source"))
    ev = live.join(live.groupBy("key").agg(F.max("at").alias("event_at")), "key")
    retracted = ev.groupBy(F.col("culture_key").alias("key")).agg(F.min("event_at").alias("at"))
    none = retracted.where("false")
    return facts.gate(ev, none.select("key"), none, retracted)


@query(f"{_LIVE}, {_EV} SELECT g.key, first AS id, g.support, ap.key IS NOT NULL AS approved FROM g JOIN l ON l.id = g.first LEFT JOIN ap ON ap.key = g.key WHERE g.support < 2 AND l.a <> 'name' AND g.key NOT IN (SELECT key FROM pr)")
def held_facts(spark, d):
    live = _live(spark, d, "source")
    return facts.held(facts.in_episodes(live), _promoted(live), replay.approvals(_tx(spark, d)))


@query(f"{_LIVE}, sc AS (SELECT a FROM attrs WHERE card <> 'many') SELECT rep AS e, a, array_to_string(list_sort(list(DISTINCT {_VAL})), '|') AS vals FROM l WHERE tier = 'culture' AND a NOT IN (SELECT a FROM sc) GROUP BY rep, a")
def settled_many(spark, d):
    live = facts.in_tier(_live(spark, d), "culture")
    return facts.settled_many(live, table(spark, d, "attrs")).select("e", "a", F.array_join("vals", "|").alias("vals"))


def _one(kind: str, first: str) -> str:
    return f"{_LIVE} SELECT rep AS e, a, id, v FROM l WHERE tier = 'culture' AND a IN (SELECT a FROM attrs WHERE card = 'one' AND kind = '{kind}') QUALIFY row_number() OVER (PARTITION BY rep, a ORDER BY coalesce({first}, 0) DESC, coalesce(nu, 0) DESC, id) = 1"


@query(_one("state", "vf"))
def settled_one_state(spark, d):
    return facts.settled_one(facts.in_tier(_live(spark, d, "nu", "vf"), "culture"), table(spark, d, "attrs"), "state").drop("ctx")


@query(_one("claim", "support"))
def settled_one_claim(spark, d):
    return facts.settled_one(facts.in_tier(_live(spark, d, "nu", "support"), "culture"), table(spark, d, "attrs"), "claim").drop("ctx")


@query(f"{_SHOWN} SELECT entity, a, value, support, nu FROM s WHERE tier = 'culture' AND a <> 'name' AND contains(lower(entity || ' ' || a || ' ' || value), '{NEEDLE.lower()}') QUALIFY row_number() OVER (PARTITION BY lower(entity), a, value ORDER BY support DESC, pos, id) = 1")
def memory_search(spark, d):
    return facts.memory(facts.in_tier(_shown(spark, d, "nu", "support"), "culture"), NEEDLE)


@query(f"{_SHOWN} SELECT entity, a, value, support, nu FROM s WHERE tier = 'culture' AND a <> 'name' QUALIFY row_number() OVER (PARTITION BY lower(entity), a, value ORDER BY support DESC, pos, id) = 1")
def memory_all(spark, d):
    return facts.memory(facts.in_tier(_shown(spark, d, "nu", "support"), "culture"))


@query(f"{_SHOWN} SELECT id, entity, a, value FROM s")
def displayed_facts(spark, d):
    return _shown(spark, d).select("id", "entity", "a", "value")


# ---- extraction and recall


@query(r"""SELECT DISTINCT id, regexp_replace(regexp_replace(quote.text, '^[\x00-\x20]+', ''), '[\x00-\x20]+$', '') AS trimmed, CASE WHEN length(quote.text) > 200 THEN quote.text[1:199] || '…' ELSE quote.text END AS cut, regexp_replace(id, '^[a-z]+:', '')[1:10] AS short,
lower(regexp_replace(regexp_replace(regexp_replace(v, '^[\x00-\x20]+', ''), '[\x00-\x20]+$', ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS norm FROM datoms""")
def quote_functions(spark, d):
    q = F.col("quote.text")
    return table(spark, d, "datoms").select("id", text.trimmed(q).alias("trimmed"), text.cut_quote(q).alias("cut"), text.short_id(F.col("id")).alias("short"), text.norm(F.col("v")).alias("norm")).distinct()


@query(r"""WITH x AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
o AS (SELECT doc_id, i, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS start, regexp_replace(line, '\r$', '') AS raw FROM x),
b AS (SELECT *, regexp_replace(regexp_replace(raw, '^[\x00-\x20]+', ''), '[\x00-\x20]+$', '') AS l FROM o), c AS (SELECT *, string_split(CASE WHEN starts_with(l, '- ') OR starts_with(l, '* ') THEN l[3:] ELSE l END, '|') AS p FROM b),
q AS (SELECT *, list_transform(p, lambda y: regexp_replace(regexp_replace(y, '^[\x00-\x20]+', ''), '[\x00-\x20]+$', '')) AS s FROM c WHERE len(p) = 3)
SELECT doc_id, i::INT AS i, s[1] AS entity, replace(lower(s[2]), ' ', '_') AS a, s[3] AS v, 800::BIGINT AS nu, start::BIGINT AS start, (start + length(raw))::BIGINT AS "end", raw AS quote FROM q WHERE s[1] <> '' AND s[2] <> '' AND s[3] <> ''""")
def pattern_extract(spark, d):
    return extract.pattern_facts(table(spark, d, "documents"), "doc_id", "text")


_PATTERN = SQL["pattern_extract"]


@query(f"WITH pf AS ({_PATTERN}) SELECT doc_id, i, entity, a, v FROM pf QUALIFY row_number() OVER (PARTITION BY doc_id, entity, a, lower(v) ORDER BY i) = 1")
def proposal_dedupe(spark, d):
    p = extract.pattern_facts(table(spark, d, "documents"), "doc_id", "text")
    return extract.distinct_facts(p, "doc_id").select("doc_id", "i", "entity", "a", "v")


@query(f"""WITH pf AS ({_PATTERN}), k AS (SELECT pf.*, q2.ref, CASE WHEN q2.a IS NULL THEN 'attribute not in the schema: ' || pf.a END AS no FROM pf LEFT JOIN attrs q2 ON q2.a = pf.a AND q2.a <> 'name'),
z AS (SELECT *, sum(CASE WHEN no IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS kept FROM k) SELECT doc_id, i, a, coalesce(no, CASE WHEN kept > 50 THEN 'over budget' END) AS reason FROM z""")
def admit_facts(spark, d):
    docs = table(spark, d, "documents")
    return extract.admit(extract.pattern_facts(docs, "doc_id", "text"), docs, "doc_id", "text", table(spark, d, "attrs")).select("doc_id", "i", "a", "reason")


@query(f"""WITH pf AS ({_PATTERN}), z AS (SELECT pf.*, q2.ref, sum(1) OVER (PARTITION BY doc_id ORDER BY i) AS kept FROM pf JOIN attrs q2 ON q2.a = pf.a AND q2.a <> 'name'), y AS (SELECT *, sha256('["p-own","' || doc_id || '"]') AS nonce FROM z WHERE kept <= 50),
w AS (SELECT *, lower(regexp_replace(entity, '\\s+', ' ', 'g')) AS en, lower(regexp_replace(v, '\\s+', ' ', 'g')) AS vn FROM y),
u AS (SELECT *, 'e:' || sha256('["ident","name",' || to_json(en) || ']')[1:24] AS e, 'e:' || sha256('["ident","name",' || to_json(vn) || ']')[1:24] AS te FROM w)
SELECT 'd:' || sha256('["' || nonce || '",' || i || ']')[1:24] AS id, e, a, CASE WHEN ref THEN '{{"ref":"' || te || '"}}' ELSE v END AS v, nu FROM u
UNION ALL SELECT 'd:' || sha256('["' || nonce || '",' || i || ',"name"]')[1:24], e, 'name', entity, 1000 FROM u
UNION ALL SELECT 'd:' || sha256('["' || nonce || '",' || i || ',"vname"]')[1:24], te, 'name', v, 1000 FROM u WHERE ref""")
def datom_flatmap(spark, d):
    docs = table(spark, d, "documents")
    a = extract.admit(extract.pattern_facts(docs, "doc_id", "text"), docs, "doc_id", "text", table(spark, d, "attrs"))
    return extract.datom_rows(a, "doc_id", "p-own", NOW).select("id", "e", "a", "v", "nu")


@query()
def passages(spark, d):
    return extract.passages(table(spark, d, "documents"), "doc_id", "text")


_TOKENS = "list_distinct(list_transform(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3 AND NOT list_contains(" + str(list(text.STOP)) + ", w)), lambda w: CASE WHEN w[-1:] = 's' AND length(w) > 4 THEN w[:-2] ELSE w END))"


@query(f"SELECT doc_id, len({_TOKENS.format('text')})::INT AS n, sha256(array_to_string(list_sort({_TOKENS.format('text')}), ' ')) AS tokens FROM documents WHERE text IS NOT NULL")
def tokenize_docs(spark, d):
    w = runtime.spread(table(spark, d, "documents").select("doc_id", "text")).where("text is not null").select("doc_id", text.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n"), F.sha2(F.array_join(F.array_sort("w"), " "), 256).alias("tokens"))


_RECALL = f"""{_SHOWN}, qq AS (SELECT {_TOKENS.format("'" + QUESTION + "'")} AS q), pr AS (SELECT DISTINCT ckey FROM l WHERE tier = 'culture'),
tr AS (SELECT *, regexp_replace(regexp_replace(coalesce(quote.text, ''), '^[\\x00-\\x20]+', ''), '[\\x00-\\x20]+$', '') AS qt FROM s WHERE a <> 'name'),
se AS (SELECT entity, a, value, coalesce(support, 0) AS support, nu, qt, 0 AS pool, '' AS k, pos, id FROM tr WHERE tier = 'culture'),
hb AS (SELECT ckey, arg_min(entity, {{'a': pos, 'i': id}}) AS entity, arg_min(a, {{'a': pos, 'i': id}}) AS a, arg_min(value, {{'a': pos, 'i': id}}) AS value, count(DISTINCT coalesce(source, chr(1))) AS support, arg_min(nu, {{'a': pos, 'i': id}}) AS nu,
  arg_min(qt, {{'h': -len(list_intersect((SELECT q FROM qq), {_TOKENS.format('qt')})), 'a': pos, 'i': id}}) AS qt, min({{'a': pos, 'i': id}}) AS o FROM tr WHERE tier LIKE 'episode:%' AND ckey NOT IN (SELECT ckey FROM pr) GROUP BY ckey),
un AS (SELECT * FROM se UNION ALL SELECT entity, a, value, support, nu, qt, 1, ckey, o.a, o.i FROM hb),
de AS (SELECT *, CASE WHEN length(qt) > 200 THEN qt[1:199] || '…' ELSE qt END AS quote FROM un QUALIFY row_number() OVER (PARTITION BY lower(entity), a, lower(value) ORDER BY pool, k, pos, id) = 1),
sc AS (SELECT *, list_intersect((SELECT q FROM qq), {_TOKENS.format("entity || ' ' || replace(a, '_', ' ') || ' ' || value")}) AS fw, list_intersect((SELECT q FROM qq), {_TOKENS.format('quote')}) AS qw FROM de),
fi AS (SELECT *, (2 * len(fw) + len(list_filter(qw, lambda w: NOT list_contains(fw, w))))::DOUBLE AS raw FROM sc)
SELECT entity, a, value, support, nu, CASE WHEN pool = 0 THEN 'settled' ELSE 'held' END AS status, quote, raw + CASE WHEN pool = 0 THEN 0.5 ELSE 0 END AS score FROM fi WHERE raw > 0 ORDER BY score DESC, pool, k, pos, id LIMIT 8"""


def _recalled(spark, d):
    shown = _shown(spark, d, "nu", "support", "source", "quote")
    return search.recall(facts.in_tier(shown, "culture"), facts.in_episodes(shown), _promoted(shown), QUESTION, 8)


@query(_RECALL)
def recall_topk(spark, d):
    return _recalled(spark, d).drop("ord")


@query(f"""WITH z AS (SELECT *, row_number() OVER () AS n FROM ({_RECALL})) SELECT n::INT AS n, '[' || n || '] ' || entity || ' ' || replace(a, '_', ' ') || ' ' || value || ' (' || CASE WHEN status = 'held' THEN 'unconfirmed: ' || support || CASE WHEN support = 1 THEN ' source' ELSE ' sources' END || ', not yet through the gate'
WHEN support >= 2 THEN support || ' sources' ELSE 'approved' END || ')' || CASE WHEN quote <> '' THEN ' (source says: "' || quote || '")' ELSE '' END AS line FROM z""")
def recall_prompt_lines(spark, d):
    return search.prompt_lines(_recalled(spark, d))


@query(f"SELECT count(*) FILTER (status = 'settled') AS settled, count(*) FILTER (status = 'held') AS held FROM ({_RECALL})")
def recall_counts(spark, d):
    return search.counts(_recalled(spark, d))


# ---- feeds and bulk runs


@query("SELECT event_id, event_type FROM events WHERE event_id > 500")
def trace_since(spark, d):
    return feed.since(table(spark, d, "events"), "event_id", 500).select("event_id", "event_type")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 400")
def trace_ring(spark, d):
    return feed.last(table(spark, d, "events"), "event_id").select("event_id", "event_type")


_TRACE = """tr AS (SELECT t.seq, CASE kind WHEN 'promote' THEN 'promote' WHEN 'assert' THEN 'check' WHEN 'map' THEN 'scan' WHEN 'expire' THEN 'refuse' ELSE 'commit' END AS step, CASE WHEN kind = 'assert' THEN coalesce(facts, 0) END AS accepted,
 CASE WHEN kind = 'assert' THEN coalesce(json_array_length(payload, '$.rejected'), 0) END AS rejected FROM t LEFT JOIN (SELECT tx, count(DISTINCT id) AS facts FROM datoms WHERE a <> 'name' GROUP BY tx) x ON x.tx = t.id)"""


@query(f"""WITH {_T}, {_TRACE} SELECT seq, step, CASE WHEN step = 'refuse' THEN 'bad' WHEN step = 'check' THEN CASE WHEN rejected > 0 AND accepted = 0 THEN 'bad' ELSE 'good' END WHEN step = 'promote' THEN 'good' END AS tone, step = 'refuse' AS alarm,
row_number() OVER (ORDER BY seq) AS nth FROM tr WHERE step <> 'commit' ORDER BY seq DESC LIMIT 150""")
def activity_feed(spark, d):
    """The activity list of the log's own work: maps, results with what they kept and refused, promotions and expiries."""
    t = _tx(spark, d)
    kind = F.col("kind")
    step = F.when(kind == "promote", "promote").when(kind == "assert", "check").when(kind == "map", "scan").when(kind == "expire", "refuse").otherwise("commit")
    r = replay.results(t, table(spark, d, "datoms")).select("id", "accepted", F.size("rejected").alias("rejected"))
    trace = log.once(t, "kind").join(r, "id", "left").withColumn("step", step)
    return feed.activity(trace, "seq").select("seq", "step", "tone", "alarm", "nth")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 6")
def chat_history_last6(spark, d):
    return search.history(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")


_STEPS = "st AS (SELECT user_id AS run, event_id AS i, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'extracted' END AS outcome, (value * 100)::BIGINT AS kept, json_extract_string(props, '$.k')::BIGINT AS refused FROM events)"


def _steps(spark, d):
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "skipped").otherwise("extracted")
    return table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("i"), outcome.alias("outcome"), F.round(F.col("value") * 100).cast("bigint").alias("kept"), F.get_json_object("props", "$.k").cast("bigint").alias("refused"))


@query(f"WITH {_STEPS} SELECT count(*) FILTER (outcome = 'extracted') AS extracted, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed, coalesce(sum(kept) FILTER (outcome = 'extracted'), 0)::BIGINT AS kept, coalesce(sum(refused) FILTER (outcome = 'extracted'), 0)::BIGINT AS refused FROM st")
def bulk_totals(spark, d):
    return bulk.totals(_steps(spark, d))


@query(f"WITH {_STEPS}, z AS (SELECT *, sum(CASE WHEN outcome = 'extracted' THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY i) AS g FROM st) SELECT run, i, outcome, (sum(CASE WHEN outcome = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY run, g ORDER BY i))::BIGINT AS fails FROM z")
def bulk_consecutive_failures(spark, d):
    return bulk.failure_runs(_steps(spark, d), "run", "i").select("run", "i", "outcome", "fails")


@query(f"""{_SHOWN}, {_PL}, {_D}, {_EV}, {_FROZEN}, sk AS (SELECT {_P.format('version')}::BIGINT AS version FROM t WHERE kind = 'skill' AND {_P.format('name')} = 'ingest' UNION ALL SELECT 1)
SELECT p.portal, (SELECT count(*) FROM t) AS txs, {_PAUSED} AS paused, p.portal IN (SELECT portal FROM fz) AS frozen, (SELECT count(*) FROM pl WHERE pl.portal = p.portal) AS sources, (SELECT count(*) FROM od WHERE od.portal = p.portal) AS open,
(SELECT count(*) FROM (SELECT DISTINCT lower(entity), a, value FROM s WHERE tier = 'culture' AND a <> 'name')) AS culture, (SELECT count(*) FROM g JOIN l ON l.id = g.first WHERE g.support < 2 AND l.a <> 'name' AND g.key NOT IN (SELECT key FROM pr)) AS held,
(SELECT count(*) FROM t WHERE kind = 'assert') AS results, (SELECT 'ingest v' || max(version) FROM sk) AS skill FROM (SELECT DISTINCT portal FROM t) p""")
def summary_row(spark, d):
    """What each portal's summary screen shows: its own sources and leases, and what holds for all."""
    t, shown = _tx(spark, d), _shown(spark, d, "nu", "support", "source")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    seen = t.where("id is not null").agg(F.count_distinct("id").alias("txs"), F.count_distinct(F.when(F.col("kind") == "assert", F.col("id"))).alias("results"))
    skill = replay.skills(t).where("name = 'ingest'").agg(F.concat(F.lit("ingest v"), F.max("version").cast("string")).alias("skill"))
    whole = seen.join(replay.paused(t)).join(skill)
    held = facts.held(facts.in_episodes(shown), _promoted(shown), replay.approvals(t))
    for df, name in ((facts.memory(facts.in_tier(shown, "culture")), "culture"), (held, "held")):
        whole = whole.join(F.broadcast(n(df, name)))
    own = t.where("id is not null").select("portal").distinct()
    for df, name in ((replay.places(t), "sources"), (replay.open_directives(t), "open")):
        own = own.join(df.groupBy("portal").agg(F.count(F.lit(1)).alias(name)), "portal", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    frozen = log.fork_proofs(t).select("portal").distinct().withColumn("frozen", F.lit(True))
    own = own.join(frozen, "portal", "left").withColumn("frozen", F.coalesce("frozen", F.lit(False)))
    return own.join(F.broadcast(whole)).select("portal", "txs", "paused", "frozen", "sources", "open", "culture", "held", "results", "skill")


@query()
def state_hash(spark, d):
    """The hash of the settled state; the same for any order of the log's rows."""
    t = _tx(spark, d)
    culture, schema = facts.in_tier(_live(spark, d, "nu", "vf", "support"), "culture"), replay.schema(t, table(spark, d, "attrs"))
    settled = [facts.settled_many(culture, schema), facts.settled_one(culture, schema, "state"), facts.settled_one(culture, schema, "claim")]
    parts = [*settled, replay.decisions(t).drop("id"), replay.paused(t), replay.schema_version(t), replay.approvals(t).select("key"), replay.open_directives(t).select("directive"), replay.skills(t), replay.places(t)]
    return spark.createDataFrame([(facts.state_hash(parts),)], "state string")

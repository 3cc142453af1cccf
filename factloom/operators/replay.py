"""State rebuilt from the log: every part is an aggregate by replay key, so arrival order does not matter.

A view reads the rows of its own kinds only. Copies of a row do not change a latest
value, so they are dropped only where rows are counted or returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.log import CLOSING_KINDS, OPEN_LIMIT, of_kind, once, replay_key, wall

DEFAULT_TOOLS = {("ingest", 1): ["read_source"]}


def _json(path: str):
    return F.get_json_object("payload", path)


def keys_of(tx: DataFrame, kind: str) -> DataFrame:
    """(key, at): the keys in the payloads of one kind, each with its replay key."""
    return of_kind(tx, kind).select(F.explode(F.from_json(_json("$.keys"), "array<string>")).alias("key"), replay_key().alias("at")).where("key is not null")


def approvals(tx: DataFrame) -> DataFrame:
    return keys_of(tx, "approve").groupBy("key").agg(F.max("at").alias("at"))


def retractions(tx: DataFrame) -> DataFrame:
    return keys_of(tx, "retract").groupBy("key").agg(F.max("at").alias("at"))


def paused(tx: DataFrame) -> DataFrame:
    """One row: whether the last of pause and resume was a pause (without either: false)."""
    return of_kind(tx, "pause", "resume").agg(F.coalesce(F.max_by("kind", replay_key()) == "pause", F.lit(False)).alias("paused"))


def schema(tx: DataFrame, defaults: DataFrame) -> DataFrame:
    """(a, card, uniq, kind, ref): the attribute schema, defaults overridden by the last definition in the log."""
    d = of_kind(tx, "schema").select(replay_key().alias("at"), F.explode(F.from_json(_json("$.attrs"), "map<string,struct<card:string,`unique`:string,kind:string,ref:boolean>>")).alias("a", "d"))
    last = d.groupBy("a").agg(F.max_by("d", "at").alias("d")).select("a", "d.card", F.col("d.unique").alias("uniq"), "d.kind", "d.ref")
    own = defaults.select("a", "card", "uniq", "kind", "ref")
    return last.unionByName(own.join(last.select("a"), "a", "left_anti"))


def schema_version(tx: DataFrame) -> DataFrame:
    return of_kind(tx, "schema").agg(F.count_distinct("id").alias("version"))


def skills(tx: DataFrame) -> DataFrame:
    """(name, version, tools): the last tools published for each version, the default where none was."""
    t = of_kind(tx, "skill").select(_json("$.name").alias("name"), _json("$.version").cast("bigint").alias("version"), F.from_json(_json("$.tools"), "array<string>").alias("tools"), replay_key().alias("at"))
    last = t.groupBy("name", "version").agg(F.max_by("tools", "at").alias("tools"))
    seed = tx.sparkSession.createDataFrame([(n, v, tools) for (n, v), tools in DEFAULT_TOOLS.items()], "name string, version bigint, tools array<string>")
    return last.unionByName(seed.join(last, ["name", "version"], "left_anti"))


def allowed_tools(pinned: DataFrame, published: DataFrame) -> DataFrame:
    """(skill, version, tools): of the pinned version those that the latest version has too, in the pinned order."""
    latest = published.groupBy(F.col("name").alias("skill")).agg(F.max_by("tools", "version").alias("latest"))
    own = published.select(F.col("name").alias("skill"), "version", F.col("tools").alias("mine"))
    tools = F.coalesce(F.filter("mine", lambda t: F.array_contains("latest", t)), F.array().cast("array<string>"))
    return pinned.select("skill", "version").distinct().join(own, ["skill", "version"], "left").join(latest, "skill", "left").select("skill", "version", tools.alias("tools"))


def directives(tx: DataFrame) -> DataFrame:
    """All directives as the log has them: (directive, source, skill, skill_version, budget, expires, portal, issued, at)."""
    d = of_kind(tx, "directive").select(
        _json("$.id").alias("directive"), _json("$.source").alias("source"), _json("$.source_hash").alias("source_hash"), _json("$.skill").alias("skill"), _json("$.skill_version").cast("bigint").alias("skill_version"),
        _json("$.budget").cast("bigint").alias("budget"), _json("$.expires").cast("bigint").alias("expires"), "portal", wall().alias("issued"), replay_key().alias("at"),
    ).where("directive is not null")
    cols = [c for c in d.columns if c not in ("directive", "at")]
    return d.groupBy("directive").agg(F.max_by(F.struct(*cols), "at").alias("x"), F.max("at").alias("at")).select("directive", "x.*", "at")


def open_directives(tx: DataFrame) -> DataFrame:
    """Directives that nothing closed after they were issued."""
    d = directives(tx)
    closed = of_kind(tx, *CLOSING_KINDS).groupBy("directive").agg(F.max(replay_key()).alias("closed"))
    return d.join(closed, "directive", "left").where("closed is null or closed < at").drop("at", "closed")


def places(tx: DataFrame) -> DataFrame:
    """(portal, source, hash): the content hash that a portal recorded last for each source."""
    p = of_kind(tx, "map").select("portal", replay_key().alias("at"), F.explode(F.from_json(_json("$.places"), "map<string,string>")).alias("source", "hash"))
    return p.groupBy("portal", "source").agg(F.max_by("hash", "at").alias("hash"))


def last_places(tx: DataFrame) -> DataFrame:
    """(source, hash): the content hash recorded last for each source, by any portal."""
    p = of_kind(tx, "map").select(replay_key().alias("at"), F.explode(F.from_json(_json("$.places"), "map<string,string>")).alias("source", "hash"))
    return p.groupBy("source").agg(F.max_by("hash", "at").alias("hash"))


def place_names(tx: DataFrame) -> DataFrame:
    """(source, name): the display name given last, by any portal."""
    p = of_kind(tx, "map").select(replay_key().alias("at"), F.explode(F.from_json(_json("$.names"), "map<string,string>")).alias("source", "name"))
    return p.groupBy("source").agg(F.max_by("name", "at").alias("name"))


def results(tx: DataFrame, datoms: DataFrame) -> DataFrame:
    """Results of runs: their header, facts accepted (from ``datoms`` where the payload is withheld) and refusals."""
    facts = datoms.where("a <> 'name' and tx is not null").groupBy(F.col("tx").alias("id")).agg(F.count_distinct("id").alias("facts"))
    rejected = F.from_json(_json("$.rejected"), "array<struct<i:bigint,a:string,reason:string>>")
    t = once(of_kind(tx, "assert"), "directive", "agent", "source", "source_hash", "skill_version", "hlc", "portal", "payload")
    t = t.select("id", "directive", "agent", "source", "source_hash", "skill_version", wall().alias("wall"), replay_key().alias("at"), F.coalesce(rejected, F.array().cast("array<struct<i:bigint,a:string,reason:string>>")).alias("rejected"))
    return t.join(facts, "id", "left").withColumn("accepted", F.coalesce("facts", F.lit(0))).drop("facts")


def refusals(results: DataFrame) -> DataFrame:
    """(reason, n): why facts were refused."""
    return results.select(F.explode("rejected").alias("r")).groupBy("r.reason").agg(F.count(F.lit(1)).alias("n"))


def decisions(tx: DataFrame) -> DataFrame:
    return once(of_kind(tx, "promote"), "payload").select("id", _json("$.decision.key").alias("key"), _json("$.decision.support").cast("bigint").alias("support"), _json("$.decision.rule").alias("rule"))


def extracted(places: DataFrame, results: DataFrame, portal: str | None = None) -> DataFrame:
    """(portal, source): sources with a result, of any portal, for exactly the content recorded last."""
    p = places if portal is None else places.where(F.col("portal") == portal)
    done = results.select("source", F.col("source_hash").alias("hash")).distinct()
    return p.join(done, ["source", "hash"], "left_semi").select("portal", "source")


def stale(open_directives: DataFrame, now: int) -> DataFrame:
    return open_directives.withColumn("stale", F.lit(now) >= F.col("expires"))


def expiries(open_directives: DataFrame, portal: str, now: int) -> DataFrame:
    """The expire transactions that a portal owes: (kind, tier, portal, directive, payload) of its directives past their deadline."""
    due = open_directives.where((F.col("portal") == portal) & (F.lit(now) >= F.col("expires")))
    return due.select(F.lit("expire").alias("kind"), F.lit("system").alias("tier"), "portal", "directive", F.to_json(F.struct("directive")).alias("payload"))


def named_sources(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``name``, the display name of ``source``, or itself where it has none."""
    return rows.join(names.select("source", F.col("name").alias("_name")), "source", "left").withColumn("name", F.coalesce("_name", "source")).drop("_name")


def issuable(places: DataFrame, open_directives: DataFrame, frozen: DataFrame, paused: DataFrame, limit: int = OPEN_LIMIT) -> DataFrame:
    """(portal, source, refused): why no directive may be issued for a source now; null where one may."""
    load = open_directives.groupBy("portal").agg(F.count(F.lit(1)).alias("open"))
    cut = frozen.select("portal").distinct().withColumn("frozen", F.lit(True))
    p = places.join(cut, "portal", "left").join(load, "portal", "left").join(F.broadcast(paused))
    why = F.when(F.col("frozen"), "frozen: this portal's chain forked; the steward must re-key it").when(F.col("paused"), "paused by the steward")
    return p.select("portal", "source", why.when(F.coalesce("open", F.lit(0)) >= limit, "open directive limit reached; expire stale directives first").alias("refused"))

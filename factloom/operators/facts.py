"""Facts: liveness, names, evidence, the promotion gate, and the settled view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import canon
from factloom.functions.text import trimmed
from factloom.operators.log import of_kind, replay_key

GATE_K = 2

# The columns of a fact.
COLUMNS = ("e", "a", "v", "ctx", "nu", "vf", "vt", "quote", "support", "tier", "t", "source", "tx")


QUOTE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("text", T.StringType())])
_FACT = "id string, e string, a string, ctx string, nu bigint, vf bigint, vt bigint, quote struct<start:bigint,`end`:bigint,text:string>, origin string, origin_tx string, support bigint, excised boolean"


def facts_of(tx: DataFrame) -> DataFrame:
    """The facts that a log's own payloads hold, with tier, time, source and transaction: what ``datoms`` has as a table.

    Withheld payloads hold none, and excised facts are left out. ``v`` is a text, or
    a reference as its JSON.
    """
    held = of_kind(tx, "assert", "promote", "dream").where(~F.coalesce(F.get_json_object("payload", "$.withheld") == "true", F.lit(False)))
    one = F.explode(F.from_json(F.get_json_object("payload", "$.datoms"), "array<string>"))
    d = held.select("tier", F.get("hlc", F.lit(0)).alias("t"), "source", F.col("id").alias("tx"), one.alias("j"))
    d = d.select("*", F.from_json("j", _FACT).alias("x"), F.get_json_object("j", "$.v").alias("v")).where("not coalesce(x.excised, false)")
    return d.select("x.id", "x.e", "x.a", "v", "x.ctx", "x.nu", "x.vf", "x.vt", "x.quote", "x.origin", "x.origin_tx", "x.support", "tier", "t", "source", "tx").distinct()


def located(datoms: DataFrame, tx: DataFrame, columns: tuple[str, ...] = COLUMNS, aliases: DataFrame | None = None) -> DataFrame:
    """Facts with keys and replay order: each id once, as its last transaction has it.

    Of ``columns`` those that are not needed to tell facts apart can be left out.
    Adds ``rep`` (what e stands for by ``aliases`` (e, rep), itself where that has no
    row), ``key`` (of the fact's own tier), ``culture_key`` and ``at`` (replay key).
    Facts of a transaction that the log lacks are left out. Copies of a transaction
    add copies of a fact, which are dropped with the others of its id.
    """
    at = tx.where("id is not null").select(F.col("id").alias("tx"), replay_key().alias("at"))
    kept = [c for c in COLUMNS if c in columns or c in ("e", "a", "v", "ctx", "tier", "tx")]
    d = datoms.where("id is not null").select("id", *kept).join(at, "tx")
    latest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("at"), *kept))
    last = d.withColumn("_n", latest).where("_n = 1").drop("_n")
    if aliases is None:
        last = last.withColumn("rep", F.col("e"))
    else:
        last = last.join(aliases, "e", "left").withColumn("rep", F.coalesce("rep", "e"))
    tail = F.concat(F.lit(","), canon.text(F.col("rep")), F.lit(","), canon.text(F.col("a")), F.lit(","), canon.value(F.col("v")), F.lit(","), canon.text(F.col("ctx")), F.lit("]"))
    key = lambda tier: F.concat(F.lit("k:"), F.substring(canon.h(F.concat(F.lit("["), tier, F.col("_tail"))), 1, 32))
    last = last.withColumn("_tail", tail).withColumn("culture_key", key(F.lit('"culture"')))
    own = F.when(F.col("tier") == "culture", F.col("culture_key")).otherwise(key(canon.text(F.col("tier"))))
    return last.withColumn("key", own).drop("_tail")


def last_events(facts: DataFrame, retracted: DataFrame) -> DataFrame:
    """(key, op, at): the last of asserts and retractions of each fact key."""
    events = facts.select("key", "at", F.lit("assert").alias("op")).unionByName(retracted.select("key", "at", F.lit("retract").alias("op")))
    return events.groupBy("key").agg(F.max_by("op", "at").alias("op"), F.max("at").alias("event_at"))


def alive(facts: DataFrame, retracted: DataFrame) -> DataFrame:
    """Facts whose last event is an assert: those whose key no later transaction retracted.

    Only keys with a retraction are looked at more closely, so the facts themselves
    are not moved for this.
    """
    gone = retracted.select("key", F.col("at").alias("gone_at"))
    dead = facts.select("key", "at").join(gone, "key").groupBy("key").agg(F.max("at").alias("last"), F.max("gone_at").alias("gone_at")).where("gone_at > last")
    return facts.join(dead.select("key"), "key", "left_anti")


def with_event_times(evidence: DataFrame, retracted: DataFrame) -> DataFrame:
    """Adds ``event_at``, the last assert of each fact's own key, where its culture key was retracted (null elsewhere)."""
    near = evidence.join(retracted.select(F.col("key").alias("culture_key")).distinct(), "culture_key", "left_semi")
    return evidence.join(near.groupBy("key").agg(F.max("at").alias("event_at")), "key", "left")


def in_tier(live: DataFrame, tier: str) -> DataFrame:
    return live.where(F.col("tier") == tier)


def in_episodes(live: DataFrame) -> DataFrame:
    return live.where(F.col("tier").startswith("episode:"))


def names(live: DataFrame) -> DataFrame:
    """(e, name): of each representative the name that stands last in fact order, of any tier."""
    own = live.where("a = 'name' and e is not null")
    return own.groupBy(F.col("rep").alias("e")).agg(F.max(F.struct("at", "id", "v")).alias("x")).select("e", F.col("x.v").alias("name"))


def displayed(facts: DataFrame, names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Adds ``entity`` and ``value`` as shown: names where known, else ids; references as the name of what they point at."""
    n = names.select(F.col("e").alias("rep"), F.col("name").alias("entity"))
    d = facts.withColumn("ref", F.when(F.col("v").startswith("{"), F.get_json_object("v", "$.ref")))
    if aliases is not None:
        d = d.join(aliases.select(F.col("e").alias("ref"), F.col("rep").alias("_of")), "ref", "left").withColumn("ref", F.coalesce("_of", "ref")).drop("_of")
    r = names.select(F.col("e").alias("ref"), F.col("name").alias("ref_name"))
    return d.join(n, "rep", "left").join(r, "ref", "left").withColumns({"entity": F.coalesce("entity", "e"), "value": F.coalesce("ref_name", "ref", "v")}).drop("ref", "ref_name")


def fact_line(entity: Column, a: Column, value: Column) -> Column:
    """A fact in one line, as traces and notes show it; what is missing as a question mark."""
    part = lambda c: F.coalesce(trimmed(c), F.lit("?"))
    return F.concat(part(entity), F.lit(" · "), F.coalesce(a, F.lit("?")), F.lit(" · "), part(value))


def by_source(evidence: DataFrame) -> DataFrame:
    """Evidence per culture key and source: one row each, so one key's facts are counted where they are read.

    A missing source counts as a source of its own.
    """
    return evidence.groupBy(F.col("culture_key").alias("key"), F.coalesce("source", F.lit("\u0000")).alias("src")).agg(F.min("id").alias("rep"), F.min(F.struct("at", "id")).alias("first"))


def groups(evidence: DataFrame) -> DataFrame:
    """(key, support, rep, first): distinct sources, the smallest id and the first fact of each culture key."""
    g = by_source(evidence).groupBy("key").agg(F.count(F.lit(1)).alias("support"), F.min("rep").alias("rep"), F.min("first").alias("first"))
    return g.select("key", "support", "rep", F.col("first.id").alias("first"))


def gate(evidence: DataFrame, promoted: DataFrame, approved: DataFrame, retracted: DataFrame, k: int = GATE_K) -> DataFrame:
    """Facts that the gate promotes now: (key, rep, support, rule).

    A key is promoted when ``k`` distinct sources hold it or it was approved, and
    it is not promoted already. After a retraction only later evidence and later
    approvals count; with a later approval alone the old evidence still supplies
    the row and the support. ``evidence`` (culture_key, id, source, and event_at, or key and at),
    ``promoted`` (key), ``approved`` and ``retracted`` (key, at).
    """
    if "event_at" not in evidence.columns:
        evidence = with_event_times(evidence, retracted)
    r = retracted.select(F.col("key").alias("culture_key"), F.col("at").alias("after"))
    fresh = F.col("after").isNull() | (F.col("event_at") > F.col("after"))
    e = evidence.join(r, "culture_key", "left").withColumn("fresh", fresh)
    s = e.groupBy(F.col("culture_key").alias("key"), F.coalesce("source", F.lit("\u0000")).alias("src")).agg(
        F.min("id").alias("rep"), F.min(F.when(F.col("fresh"), F.col("id"))).alias("fresh_rep"), F.max("fresh").alias("fresh"), F.max("after").alias("after")
    )
    g = s.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("fresh").cast("bigint")).alias("fresh_n"), F.min("rep").alias("rep"), F.min("fresh_rep").alias("fresh_rep"), F.max("after").alias("after"))
    g = g.join(promoted.select("key").distinct(), "key", "left_anti").join(approved.select("key", F.col("at").alias("appr")), "key", "left")
    use = F.col("fresh_n") > 0
    said = F.col("appr").isNotNull() & (F.col("after").isNull() | (F.col("appr") > F.col("after")))
    g = g.select("key", F.when(use, F.col("fresh_n")).otherwise(F.col("n")).alias("support"), F.when(use, F.col("fresh_rep")).otherwise(F.col("rep")).alias("rep"), said.alias("said"), use.alias("use"))
    g = g.where((F.col("use") | F.col("said")) & ((F.col("support") >= k) | F.col("said")))
    return g.select("key", "rep", "support", F.when(F.col("said") & (F.col("support") < k), "approved").otherwise("auto").alias("rule"))


def held(evidence: DataFrame, promoted: DataFrame, approved: DataFrame, k: int = GATE_K) -> DataFrame:
    """(key, id, support, approved): facts other than names that wait for more sources; id is the first in fact order."""
    g = groups(evidence.where("a <> 'name'")).where(F.col("support") < k).join(promoted.select("key").distinct(), "key", "left_anti")
    a = approved.select("key", F.lit(True).alias("approved"))
    return g.join(a, "key", "left").select("key", F.col("first").alias("id"), "support", F.coalesce("approved", F.lit(False)).alias("approved"))


def memory(culture: DataFrame, query: str = "") -> DataFrame:
    """(entity, a, value, support, nu): live culture facts whose line holds the query; per line the largest support, the first among equals."""
    c = culture.where("a <> 'name'").withColumns({"lower_entity": F.lower("entity"), "rank": F.struct((-F.col("support")).alias("s"), "at", "id")})
    q = query.strip().lower()
    if q:
        c = c.where(F.contains(F.lower(F.concat_ws(" ", "entity", "a", "value")), F.lit(q)))
    return c.groupBy("lower_entity", "a", "value").agg(F.min_by(F.struct("entity", "support", "nu"), "rank").alias("x")).select("x.entity", "a", "value", "x.support", "x.nu")


def settled_many(culture: DataFrame, schema: DataFrame) -> DataFrame:
    """(e, a, ctx, vals): all values, canonical and sorted, of attributes that may have many or that the schema lacks; e is the representative.

    Values are made distinct before they are gathered, so a cell gathers what it shows.
    """
    own = culture.join(schema.where("card <> 'many'").select("a"), "a", "left_anti")
    one = own.select(F.col("rep").alias("e"), "a", "ctx", canon.value(F.col("v")).alias("v")).distinct()
    return one.groupBy("e", "a", "ctx").agg(F.sort_array(F.collect_list("v")).alias("vals"))


def settled_one(culture: DataFrame, schema: DataFrame, kind: str) -> DataFrame:
    """(e, a, ctx, id, v): the one value that holds, for attributes of a kind: dreams last, then the later valid time
    (state) or the larger support (claim), then the larger confidence, then the smaller id; nulls count as 0. e is the representative."""
    own = schema.where((F.col("card") != "many") & (F.col("kind") == kind)).select("a")
    z = lambda c: -F.coalesce(F.col(c), F.lit(0))
    order = F.struct((F.col("tier") == "dream").alias("dream"), z("vf" if kind == "state" else "support").alias("first"), z("nu").alias("nu"), F.col("id"), F.col("v"))
    best = culture.join(own, "a", "left_semi").groupBy(F.col("rep").alias("e"), "a", "ctx").agg(F.min(order).alias("x"))
    return best.select("e", "a", "ctx", "x.id", "x.v")


def state_hash(parts: list[DataFrame]) -> str:
    """One hash over relations that must agree everywhere: each is hashed row by row, sorted within hash buckets and folded.

    Rows travel as hashes to 256 buckets; the driver gets 256 digests a relation.
    """
    digests = []
    for n, df in enumerate(parts):
        row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
        buckets = df.select(row.alias("r")).groupBy("r").agg(F.count(F.lit(1)).alias("c")).select(F.substring("r", 1, 2).alias("b"), F.conv(F.substring("r", 3, 15), 16, 10).cast("decimal(38,0)").alias("x"), F.conv(F.substring("r", 18, 15), 16, 10).cast("decimal(38,0)").alias("y"), "c")
        got = buckets.groupBy("b").agg(F.sum(F.col("x") * F.col("c")).cast("string").alias("x"), F.sum(F.col("y") * F.col("c")).cast("string").alias("y")).collect()
        digests.append(canon.canon([n, sorted([r["b"], r["x"], r["y"]] for r in got)]))
    import hashlib

    return hashlib.sha256("".join(digests).encode()).hexdigest()

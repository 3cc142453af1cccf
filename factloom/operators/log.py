"""The transaction log: order, checks, chains, forks and pages.

A check is a relation of violations (id, check, reason); the log holds when their
union is empty. Checks that depend on what came before are windows over the load
order, so none of them walks the log row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import canon, signature
from factloom.operators import latedata
from factloom.operators.skew import hot_keys, lookup

# The kinds of transactions, header fields and limits; messages below are fixed too, as callers match them.
STEWARD_KINDS = ("genesis", "admit", "schema", "approve", "pause", "resume", "skill")
PORTAL_KINDS = ("directive", "assert", "expire", "promote", "map", "retract", "dream")
CLOSING_KINDS = ("assert", "expire")
HEADER = ("directive", "agent", "skill", "model_hash", "source", "source_hash")
DEFAULT_BUDGET, TTL_MS, OPEN_LIMIT = 50, 600_000, 8


def wall() -> Column:
    return F.get("hlc", F.lit(0))


def counter() -> Column:
    return F.get("hlc", F.lit(1))


def replay_key() -> Column:
    """The order in which state is replayed; comparable as it is."""
    return F.struct(wall().alias("wall"), counter().alias("counter"), F.col("portal").alias("portal"), F.col("id").alias("id"))


def load_key() -> Column:
    return F.struct((F.col("portal") != "steward").alias("late"), wall().alias("wall"), counter().alias("counter"), F.col("portal").alias("portal"), F.col("id").alias("id"))


def once(tx: DataFrame, *columns: str) -> DataFrame:
    """Every transaction once, at its first arrival: (id, seq, ``columns``), all columns where none are named.

    Copies of an id are one row, as the id is the hash of its header. So a log is
    filtered by kind before this, and aggregates that copies do not change leave it out.
    """
    cols = [c for c in columns or tx.columns if c not in ("id", "seq")]
    arrival = F.row_number().over(Window.partitionBy("id").orderBy(F.asc_nulls_last("seq")))
    return tx.where("id is not null").select("id", "seq", *cols).withColumn("_n", arrival).where("_n = 1").drop("_n")


def of_kind(tx: DataFrame, *kinds: str) -> DataFrame:
    """The rows of some kinds, copies included: a filter that reaches the scan."""
    return tx.where(F.col("id").isNotNull() & F.col("kind").isin(*kinds))


def header_json() -> Column:
    """A row's header in canonical JSON; fields that a kind does not have are left out."""
    at = F.concat(F.lit("["), canon.number(wall()), F.lit(","), canon.number(counter()), F.lit("]"))
    items = {"hlc": at} | {c: canon.text(F.col(c)) for c in ("kind", "payload_hash", "portal", "prev", "signer", "tier")}
    items |= {c: F.when(F.col(c).isNotNull(), canon.text(F.col(c))) for c in HEADER}
    items |= {c: F.when(F.col(c).isNotNull(), canon.number(F.col(c))) for c in ("skill_version", "skill_current")}
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), items[k]) for k in sorted(items))), F.lit("}"))


def header_hashes(tx: DataFrame) -> DataFrame:
    return tx.where("id is not null").select("id", canon.h(header_json()).alias("header_hash")).distinct()


def id_violations(tx: DataFrame, signatures: bool = False) -> DataFrame:
    """Ids that are not the hash of their header and, on request, bad signatures."""
    t = tx.where("id is not null")
    out = t.where(canon.h(header_json()) != F.col("id")).select("id").distinct().select("id", F.lit("V1").alias("check"), F.lit("id does not match header").alias("reason"))
    if signatures:
        bad = t.select("id", "signer", "sig").distinct().where(~signature.verified("signer", "sig", "id")).select("id", F.lit("V2").alias("check"), F.lit("bad signature").alias("reason"))
        out = out.unionByName(bad)
    return out


def _said(df: DataFrame, check: str, reason: str | Column) -> DataFrame:
    return df.select("id", F.lit(check).alias("check"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def roles(tx: DataFrame) -> DataFrame:
    """(signer, role): the last grant by genesis or admit."""
    given = of_kind(tx, "genesis").select(replay_key().alias("at"), F.explode(F.from_json(F.get_json_object("payload", "$.roles"), "map<string,string>")).alias("signer", "role"))
    admitted = of_kind(tx, "admit").select(replay_key().alias("at"), F.get_json_object("payload", "$.pub").alias("signer"), F.get_json_object("payload", "$.role").alias("role"))
    return given.unionByName(admitted).groupBy("signer").agg(F.max_by("role", "at").alias("role"))


def row_violations(tx: DataFrame, raw_payloads: bool = False) -> DataFrame:
    """Checks of one row: its kind, tier and payload, and the role of its signer.

    ``raw_payloads``: also accept the hash of the payload's text as it is stored, as
    in tables whose writers did not hash the canonical form. The few signers that
    write most rows meet their roles by broadcast.
    """
    withheld = F.coalesce(F.get_json_object("payload", "$.withheld") == "true", F.lit(False))
    matches = canon.h(canon.canonical_native(F.col("payload"))) == F.col("payload_hash")
    if raw_payloads:
        matches = (F.sha2("payload", 256) == F.col("payload_hash")) | matches
    fault = F.when(withheld & ~F.coalesce(F.col("tier").startswith("episode:"), F.lit(False)), "only episode payloads may be withheld").when(
        ~withheld & ~F.coalesce(matches, F.lit(False)), "payload does not match header"
    )
    t = once(tx.withColumn("fault", fault), "kind", "tier", "signer", "fault")
    signed = tx.select("signer")
    r = lookup(t, roles(tx), "signer", hot_keys(signed, "signer"))
    kind = F.col("kind")
    known = kind.isin(*STEWARD_KINDS, *PORTAL_KINDS)
    signer = r.select(
        "id",
        F.when(F.col("role").isNull(), F.struct(F.lit("V6").alias("c"), F.lit("unknown signer").alias("r")))
        .when(kind.isin(*STEWARD_KINDS) & (F.col("role") != "steward"), F.struct(F.lit("V7").alias("c"), F.concat(F.lit("only the steward may sign "), kind).alias("r")))
        .when(kind.isin(*PORTAL_KINDS) & (F.col("role") != "portal"), F.struct(F.lit("V8").alias("c"), F.concat(F.lit("only arbiter code on a portal may sign "), kind).alias("r")))
        .when(~known, F.struct(F.lit("V9").alias("c"), F.concat(F.lit("unknown kind "), kind).alias("r")))
        .when((F.col("tier") == "culture") & (kind != "promote"), F.struct(F.lit("V10").alias("c"), F.lit("only the promotion gate writes to culture").alias("r"))).alias("x"),
    ).where("x is not null").select("id", F.col("x.c").alias("check"), F.col("x.r").alias("reason"))
    return signer.unionByName(_said(t.where("fault is not null"), "V15", F.col("fault")))


def chain_violations(tx: DataFrame) -> DataFrame:
    """Parents that are missing or of another portal, and forks: all but the first id (in load order) after one parent."""
    t = once(tx, "portal", "prev", "hlc").select("id", "portal", "prev", load_key().alias("at"))
    p = t.select(F.col("id").alias("prev"), F.col("portal").alias("parent_portal"))
    linked = t.where("prev is not null").join(p, "prev", "left")
    missing = _said(linked.where("parent_portal is null"), "V12", "missing parent in portal chain")
    foreign = _said(linked.where("parent_portal is not null and parent_portal <> portal"), "V13", "parent belongs to another portal")
    first = t.groupBy("portal", "prev").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    f = first.select(F.col("portal").alias("fp"), F.col("prev").alias("fv"), "first")
    forked = t.join(f, (F.col("portal") == F.col("fp")) & F.col("prev").eqNullSafe(F.col("fv"))).where(F.col("at") != F.col("first"))
    return missing.unionByName(foreign).unionByName(_said(forked, "V14", F.concat(F.lit("fork: "), F.col("portal"), F.lit(" signed two transactions after one parent"))))


def genesis_violations(tx: DataFrame) -> DataFrame:
    """The log starts with one genesis, signed by the steward it names."""
    t = tx.where("id is not null")
    first = t.agg(F.min_by(F.struct("id", "kind"), load_key()).alias("x")).where("x is not null").select("x.id", "x.kind")
    g = once(of_kind(tx, "genesis"), "portal", "hlc", "signer", "payload")
    steward = F.get_json_object("payload", "$.steward")
    named = F.from_json(F.get_json_object("payload", "$.roles"), "map<string,string>")
    bad = g.where(~F.coalesce((F.col("signer") == steward) & (F.try_element_at(named, F.col("signer")) == "steward"), F.lit(False)))
    one = of_kind(tx, "genesis").agg(F.min(load_key()).alias("first"))
    more = g.join(F.broadcast(one), load_key() != F.col("first"))
    return _said(first.where("kind <> 'genesis'"), "V3", "the log must start with a genesis transaction").unionByName(
        _said(bad, "V4", "genesis must be signed by the steward it names")
    ).unionByName(_said(more, "V5", "this log already has a genesis; the transaction belongs to another network"))


def issued(tx: DataFrame) -> DataFrame:
    """(directive, owner, expires, budget) from the directive transactions, the last by replay key for an id."""
    p = lambda k: F.get_json_object("payload", f"$.{k}")
    d = of_kind(tx, "directive").select(p("id").alias("directive"), F.col("portal").alias("owner"), p("expires").cast("bigint").alias("expires"), F.coalesce(p("budget").cast("bigint"), F.lit(DEFAULT_BUDGET)).alias("budget"), replay_key().alias("at"))
    return d.where("directive is not null").groupBy("directive").agg(F.max_by(F.struct("owner", "expires", "budget"), "at").alias("x")).select("directive", "x.*")


def closing_violations(tx: DataFrame, datoms: DataFrame) -> DataFrame:
    """Directives closed by another portal, twice, too late, too early, or with more facts than their budget."""
    t = once(of_kind(tx, *CLOSING_KINDS), "kind", "portal", "directive", "hlc")
    facts = datoms.where("a <> 'name' and tx is not null").groupBy("tx").agg(F.count_distinct("id").alias("facts")).select(F.col("tx").alias("id"), "facts")
    c = t.select("id", "kind", "portal", "directive", wall().alias("wall"), load_key().alias("at")).join(issued(tx), "directive", "left").join(facts, "id", "left")
    again = F.row_number().over(Window.partitionBy(F.coalesce("directive", "id")).orderBy("at")) > 1  # rows that name no directive are no group
    c = c.withColumn("again", again)
    late = (F.col("kind") == "assert") & F.coalesce(F.col("wall") >= F.col("expires"), F.lit(False))
    early = (F.col("kind") == "expire") & F.coalesce(F.col("wall") < F.col("expires"), F.lit(True))
    over = (F.col("kind") == "assert") & F.coalesce(F.col("facts") > F.col("budget"), F.lit(False))
    verdict = lambda c, r: F.struct(F.lit(c).alias("c"), F.lit(r).alias("r"))
    x = (
        F.when(F.col("owner").isNull() | (F.col("owner") != F.col("portal")), verdict("V16", "only the issuing portal can close a directive"))
        .when(F.col("again"), verdict("V17", "directive already closed"))
        .when(late, verdict("V18", "result after the directive expired"))
        .when(over, verdict("V19", "result over budget"))
        .when(early, verdict("V18", "expiry before the directive's deadline"))
    )
    return c.select("id", x.alias("x")).where("x is not null").select("id", F.col("x.c").alias("check"), F.col("x.r").alias("reason"))


def skill_violations(tx: DataFrame) -> DataFrame:
    """Skill versions published again; ingest 1 is published from the start."""
    s = once(of_kind(tx, "skill"), "portal", "hlc", "payload").select("id", F.get_json_object("payload", "$.name").alias("name"), F.get_json_object("payload", "$.version").cast("bigint").alias("version"), load_key().alias("at"))
    seeded = (F.col("name") == "ingest") & (F.col("version") == 1)
    again = s.withColumn("n", F.row_number().over(Window.partitionBy("name", "version").orderBy("at"))).where((F.col("n") > 1) | seeded)
    return _said(again, "V20", "a published skill version never changes; publish a new one")


def violations(tx: DataFrame, datoms: DataFrame, raw_payloads: bool = False) -> DataFrame:
    """All violations of the checks that need no key: (id, check, reason)."""
    out = genesis_violations(tx)
    for part in (row_violations(tx, raw_payloads), chain_violations(tx), closing_violations(tx, datoms), skill_violations(tx)):
        out = out.unionByName(part)
    return out


class Rejected(ValueError):
    """A log that breaks its rules."""


def load(tx: DataFrame, datoms: DataFrame, proofs: DataFrame | None = None, signatures: bool = True, hashed: bool = True, raw_payloads: bool = False) -> DataFrame:
    """The log in load order, or ``Rejected`` with the first violations.

    Ids and signatures are checked too; ``signatures`` and ``hashed`` switch these off
    for tables whose ids are not made from their headers. ``proofs``: stored fork
    proofs (portal, prev, a, b), of which none may fail ``checked_proofs``.
    """
    bad = violations(tx, datoms, raw_payloads)
    if hashed:
        bad = id_violations(tx, signatures).unionByName(bad)
    said = bad.orderBy("check", "id").limit(20).collect()
    if proofs is not None and not said:
        wrong = proofs.join(checked_proofs(proofs, tx).select("a", "b"), ["a", "b"], "left_anti").limit(1).collect()
        if wrong:
            raise Rejected("invalid fork proof")
    if said:
        raise Rejected("; ".join(f"{r['id']}: {r['reason']}" for r in said))
    return once(tx).orderBy(load_key())


def verify(tx: DataFrame, datoms: DataFrame, signatures: bool = True, hashed: bool = True, raw_payloads: bool = False) -> DataFrame:
    """One row on the whole log, read anew: (ok, count, violations, forks). A log with forks holds, as far as the forks."""
    bad = violations(tx, datoms, raw_payloads)
    if hashed:
        bad = id_violations(tx, signatures).unionByName(bad)
    forked = F.coalesce(F.col("check") == "V14", F.lit(False))
    n = bad.agg(F.count_if(~forked).alias("violations"))
    count = tx.agg(F.count_distinct("id").alias("count"))
    forks = fork_proofs(tx).agg(F.count(F.lit(1)).alias("forks"))
    return count.join(F.broadcast(n)).join(F.broadcast(forks)).select((F.col("violations") == 0).alias("ok"), "count", "violations", "forks")


def fork_proofs(tx: DataFrame) -> DataFrame:
    """(portal, prev, a, b): two ids by one signer after one parent; the first two in load order, one proof a parent."""
    t = once(tx, "portal", "prev", "signer", "hlc").select("portal", "prev", "signer", "id", load_key().alias("at"))
    n = F.row_number().over(Window.partitionBy("portal", "prev", "signer").orderBy("at"))
    pairs = t.withColumn("n", n).where("n <= 2").groupBy("portal", "prev", "signer").agg(F.min_by("id", "n").alias("a"), F.max_by("id", "n").alias("b"), F.min("at").alias("at"))
    return pairs.where("a <> b").groupBy("portal", "prev").agg(F.min_by(F.struct("a", "b"), "at").alias("x")).select("portal", "prev", "x.a", "x.b")


def checked_proofs(proofs: DataFrame, tx: DataFrame) -> DataFrame:
    """Given proofs (portal, prev, a, b) whose two transactions exist, differ, and share portal, prev and a known signer."""
    # only the transactions that a proof names are looked at
    named = proofs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    t = tx.join(named, "id", "left_semi").select("id", "portal", "prev", "signer").distinct()
    t = t.join(roles(tx).select("signer"), "signer", "left_semi")
    side = lambda s: t.select(*(F.col(c).alias(f"{s}_{c}") for c in t.columns))
    j = proofs.join(side("a"), F.col("a") == F.col("a_id")).join(side("b"), F.col("b") == F.col("b_id"))
    good = (F.col("a") != F.col("b")) & (F.col("a_portal") == F.col("b_portal")) & F.col("a_prev").eqNullSafe(F.col("b_prev")) & (F.col("a_signer") == F.col("b_signer"))
    return j.where(good).select(F.col("a_portal").alias("portal"), F.col("a_prev").alias("prev"), "a", "b").dropDuplicates(["portal", "prev"])


def tips(depths: DataFrame, tx: DataFrame) -> DataFrame:
    """(portal, id, depth): the deepest transaction of each portal, the first to arrive among equals."""
    t = tx.where("id is not null").groupBy("id").agg(F.min("seq").alias("seq"), F.min("portal").alias("portal"))
    return depths.where("depth > 0").join(t, "id").groupBy("portal").agg(F.max_by(F.struct("id", "depth"), F.struct("depth", -F.col("seq"))).alias("x")).select("portal", "x.id", "x.depth")


def fork_cuts(proofs: DataFrame, depths: DataFrame) -> DataFrame:
    """(portal, cut): the depth up to which a forked portal counts; an unknown parent cuts nothing."""
    d = depths.select(F.col("id").alias("prev"), F.col("depth").alias("d"))
    at = proofs.select("portal", "prev").join(d, "prev", "left").select("portal", F.when(F.col("prev").isNull(), 0).otherwise(F.col("d")).alias("cut"))
    return at.where("cut is not null").groupBy("portal").agg(F.min("cut").cast("bigint").alias("cut"))


def valid(tx: DataFrame, depths: DataFrame, proofs: DataFrame, *columns: str) -> DataFrame:
    """The transactions that replay reads: those of a forked portal up to the fork only."""
    t = once(tx, *columns, "portal").join(depths.select("id", "depth"), "id").join(fork_cuts(proofs, depths), "portal", "left")
    return t.where("cut is null or depth <= cut").drop("cut")


def hybrid_clock(rows: DataFrame, now: str, order: str, by: str, block: int = latedata.BLOCK) -> DataFrame:
    """(by, order, wall, counter) as a writer would give them: the highest time so far, and the place among equals.

    The running maximum is taken in blocks of ``order`` numbers, so no task takes a
    whole writer; rows of one wall time of one writer meet in one task.
    """
    r = rows.select(F.col(by).alias("key"), F.col(order).cast("bigint").alias("seq"), F.col(now).cast("bigint").alias("wall"), F.lit("").alias("id"))
    m = latedata.with_watermark(r, block).select("key", "seq", F.greatest("wall", "mark").alias("wall"))
    n = F.row_number().over(Window.partitionBy("key", "wall").orderBy("seq")).cast("bigint") - 1
    return m.select(F.col("key").alias(by), F.col("seq").alias(order), "wall", n.alias("counter"))


def page(tx: DataFrame, offset: int, limit: int) -> DataFrame:
    """The log, newest arrival first: (n, id, kind, portal, tier, wall, directive), n the arrival number from 1.

    The numbers come from counts: a page needs the rows that arrived after it only, not a sorted log.
    """
    t = once(tx, "kind", "portal", "tier", "hlc", "directive")
    top = t.orderBy(F.desc("seq")).limit(offset + limit).select("id", "kind", "portal", "tier", wall().alias("wall"), "directive", "seq")
    total = tx.agg(F.count_distinct("id").alias("total"))
    n = F.row_number().over(Window.orderBy(F.desc("seq")))
    return top.withColumn("k", n).where(F.col("k") > offset).join(F.broadcast(total)).select((F.col("total") - F.col("k") + 1).alias("n"), "id", "kind", "portal", "tier", "wall", "directive")


def headers(tx: DataFrame) -> DataFrame:
    """(id, header, sig) without payloads, the header as canonical JSON: what a fork proof shows."""
    return once(tx).select("id", header_json().alias("header"), "sig")


def row_json() -> Column:
    """A whole transaction in canonical JSON; a payload that is no JSON is null."""
    return canon.obj(header=header_json(), id=canon.text(F.col("id")), payload=F.coalesce(canon.canonical(F.col("payload")), F.lit("null")), sig=canon.text(F.col("sig")))


def append(log: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` that the log does not hold, each once: an upsert that ignores what is there."""
    return once(new).join(log.select("id"), "id", "left_anti")

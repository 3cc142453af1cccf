"""Writing to the log: bootstrap, the transactions that the engine makes, and their chaining.

A transaction names its predecessor by hash, so the new rows of one chain are hashed
one after another; chains are independent, and each is one group of a grouped map.
A commit adds few rows to a chain, and only the tips of the log are read.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import canon
from factloom.operators.log import HEADER, Rejected, counter, of_kind, roles, wall

STEWARD = "steward"
DRAFT = "portal string, n bigint, kind string, tier string, payload string, signer string, directive string, agent string, skill string, model_hash string, source string, source_hash string, skill_version bigint, skill_current bigint"
ROW = "id string, portal string, prev string, hlc array<bigint>, kind string, tier string, payload_hash string, signer string, directive string, agent string, skill string, model_hash string, source string, source_hash string, skill_version bigint, skill_current bigint, sig string, payload string"


def draft(rows: DataFrame, **columns) -> DataFrame:
    """Rows to commit (``DRAFT``) from columns or literals by name; those not named are null."""
    fields = [f.split() for f in DRAFT.split(", ")]
    own = {c: columns[c] if isinstance(columns.get(c), Column) else F.lit(columns.get(c)) for c, _ in fields}
    return rows.select(*(own[c].cast(t).alias(c) for c, t in fields))


def heads(tx: DataFrame, depths: DataFrame) -> DataFrame:
    """(portal, tip, wall, counter): the deepest transaction of each chain, and the latest clock of the whole log."""
    t = tx.where("id is not null").groupBy("id", "portal").agg(F.min("seq").alias("seq"))
    tip = depths.where("depth > 0").select("id", "depth").join(t, "id").groupBy("portal").agg(F.max_by("id", F.struct("depth", -F.col("seq"))).alias("tip"))
    last = tx.agg(F.max(F.struct(wall().alias("wall"), counter().alias("counter"))).alias("x")).select(F.coalesce("x.wall", F.lit(0)).alias("wall"), F.coalesce("x.counter", F.lit(0)).alias("counter"))
    return tip.join(F.broadcast(last))


def chained(drafts: DataFrame, heads: DataFrame, now: int, sign: Callable[[str, str], str] | None = None) -> DataFrame:
    """The rows of ``drafts`` as transactions, in the order of ``n`` within each chain: clocks, predecessors, hashes, signatures.

    The first row of a chain hangs from its tip in ``heads`` (none: it is the first of
    all). A clock is the later of ``now`` and the log's last, and counts on among
    equals. A fact of a ``promote`` payload without an id gets the one that its
    predecessor determines. ``sign`` (signer, id) gives the signature, else it is empty.
    """
    names = [c.split()[0] for c in ROW.split(", ")]
    meta = (*HEADER, "skill_version", "skill_current")

    def run(new: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        out = []
        prev = head["tip"].iloc[0] if len(head) else None
        last = (int(head["wall"].iloc[0]), int(head["counter"].iloc[0])) if len(head) else (0, 0)
        for r in new.sort_values("n").to_dict("records"):
            at = max(now, last[0])
            last = (at, last[1] + 1 if at == last[0] else 0)
            payload = json.loads(r["payload"]) if r["payload"] else {}
            if r["kind"] == "promote":
                for d in payload.get("datoms", []):
                    d.setdefault("id", "d:" + canon.digest(["promote", d["origin"], prev])[:24])
            body = canon.canon(payload)
            header = {c: (int(r[c]) if c.startswith("skill_") else r[c]) for c in meta if r[c] is not None and r[c] == r[c]}
            header |= {"portal": r["portal"], "prev": prev, "hlc": list(last), "kind": r["kind"], "tier": r["tier"], "payload_hash": canon.sha(body), "signer": r["signer"]}
            prev_id = canon.digest(header)
            row = dict.fromkeys(names) | header | {"id": prev_id, "sig": sign(r["signer"], prev_id) if sign else "", "payload": body}
            prev = prev_id
            out.append(tuple(row[c] for c in names))
        frame = pd.DataFrame(out, columns=names)
        return frame.astype({"skill_version": "Int64", "skill_current": "Int64"})

    return drafts.groupBy("portal").cogroup(heads.groupBy("portal")).applyInPandas(run, ROW).where("id is not null")


def with_arrival(new: DataFrame, log: DataFrame) -> DataFrame:
    """New transactions with arrival numbers after those of the log, in the order of their clocks; a commit's rows are few."""
    from factloom.operators.search import numbered

    last = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_last"))
    n = numbered(new.withColumns({"_w": wall(), "_c": counter()}), ["_w", "_c", "portal", "id"], "_n")
    return n.join(F.broadcast(last)).withColumn("seq", F.col("_last") + F.col("_n")).drop("_w", "_c", "_n", "_last")


def bootstrap(tx: DataFrame, steward: str, portal_key: str, network: str, now: int) -> DataFrame:
    """What a device commits when it opens a log (``DRAFT``): its genesis, an admission of its key, or nothing.

    A log of another steward is refused.
    """
    spark = tx.sparkSession
    one = spark.range(1)
    if of_kind(tx, "genesis").isEmpty():
        payload = canon.canon({"steward": steward, "roles": {steward: "steward", portal_key: "portal"}, "network": network, "created": now})
        return draft(one, portal=STEWARD, n=0, kind="genesis", tier="system", signer=steward, payload=payload)
    known = {r["signer"]: r["role"] for r in roles(tx).where(F.col("signer").isin(steward, portal_key)).collect()}
    if known.get(steward) != "steward":
        raise Rejected("this log was started by a different steward key than the one on this device")
    admit = draft(one, portal=STEWARD, n=0, kind="admit", tier="system", signer=steward, payload=canon.canon({"pub": portal_key, "role": "portal"}))
    return admit.where(F.lit(portal_key not in known))


def steward_row(spark, steward: str, kind: str, payload: dict) -> DataFrame:
    """One row of the steward: approve (its keys sorted), pause, resume, skill, schema."""
    if kind == "approve":
        payload = {"keys": sorted(payload["keys"])}
    return draft(spark.range(1), portal=STEWARD, n=0, kind=kind, tier="system", signer=steward, payload=canon.canon(payload))


def promotion_rows(gated: DataFrame, facts: DataFrame, portal: str, signer: str) -> DataFrame:
    """A ``promote`` row (``DRAFT``) for each fact that the gate lets through, by key: a copy of its representative, and the decision."""
    from pyspark.sql import Window

    f = facts.select(F.col("id").alias("rep"), "e", "a", "v", "ctx", "nu", "vf", "vt", "quote", F.col("tx").alias("origin_tx"))
    ref = F.when(F.col("v").startswith("{"), F.get_json_object("v", "$.ref"))
    text = lambda c: canon.text(F.col(c) if isinstance(c, str) else c)
    quote = F.when(F.col("quote").isNull(), F.lit("null")).otherwise(canon.obj(start=canon.number(F.col("quote.start")), end=canon.number(F.col("quote.end")), text=text("quote.text")))
    value = F.when(ref.isNotNull(), canon.obj(ref=text(ref))).otherwise(text("v"))
    datom = canon.obj(
        e=text("e"), a=text("a"), v=value, ctx=text("ctx"), nu=canon.number(F.col("nu")), vf=canon.number(F.col("vf")), vt=canon.number(F.col("vt")), quote=quote,
        origin=text("rep"), origin_tx=text("origin_tx"), derived_from=F.lit("null"), support=canon.number(F.col("support")),
    )
    decision = canon.obj(key=text("key"), support=canon.number(F.col("support")), rule=text("rule"))
    rows = gated.join(f, "rep").select("key", canon.obj(datoms=canon.array(datom), decision=decision).alias("payload"))
    n = F.row_number().over(Window.partitionBy(F.lit(portal)).orderBy("key"))
    return draft(rows.withColumn("n", n), portal=portal, n=F.col("n"), kind="promote", tier="culture", signer=signer, payload=F.col("payload"))

"""Runs over sources: leases issued, checked before and after the agent works, and what the log gets of each.

All leases of a call are one DataFrame, so a thousand sources are issued, read,
checked and admitted in one pass; the rules are those of a single run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import canon
from factloom.operators import commit, extract
from factloom.operators.log import DEFAULT_BUDGET, OPEN_LIMIT, TTL_MS

SKILL = "ingest"


def issue(wanted: DataFrame, places: DataFrame, open_directives: DataFrame, frozen: DataFrame, paused: DataFrame, skills: DataFrame, portal: str, now: int, log_size: int, budget: int = DEFAULT_BUDGET) -> DataFrame:
    """(source, refused, id, skill, skill_version, source_hash, budget, expires) of wanted sources (source, in the order of n).

    ``refused`` is null where a lease is issued: nothing is frozen or paused, the
    portal has mapped the source, the skill is published, and it has room for another
    open lease; earlier sources come first.
    """
    mapped = places.where(F.col("portal") == portal).select("source", F.col("hash").alias("source_hash"))
    latest = skills.where(F.col("name") == SKILL).agg(F.max("version").alias("skill_version"))
    state = latest.join(paused.select("paused")).join(frozen.where(F.col("portal") == portal).agg((F.count(F.lit(1)) > 0).alias("frozen"))).join(
        open_directives.where(F.col("portal") == portal).agg(F.count(F.lit(1)).alias("open"))
    )
    x = wanted.select("source", "n").join(mapped, "source", "left").join(F.broadcast(state))
    why = F.when(F.col("frozen"), "frozen: this portal's chain forked; the steward must re-key it").when(F.col("paused"), "paused by the steward")
    why = why.when(F.col("source_hash").isNull(), "source is not in the workspace map").when(F.col("skill_version").isNull(), "skill is not in the registry")
    nth = F.sum(F.when(why.isNull(), 1).otherwise(0)).over(Window.partitionBy(F.lit(portal)).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("nth", nth).withColumn("refused", F.coalesce(why, F.when(F.col("open") + F.col("nth") > OPEN_LIMIT, "open directive limit reached; expire stale directives first")))
    size = F.lit(log_size) + F.col("nth") - 1
    return x.select("source", "refused", canon.directive_id(F.lit(portal), F.lit(now), F.col("source"), size).alias("id"), F.lit(SKILL).alias("skill"), "skill_version", "source_hash", F.lit(budget).cast("bigint").alias("budget"), (F.lit(now) + TTL_MS).alias("expires"), "n")


def directive_rows(issued: DataFrame, portal: str, signer: str) -> DataFrame:
    """The ``directive`` rows (``commit.DRAFT``) of issued leases."""
    t = canon.text
    payload = canon.obj(
        id=t(F.col("id")), task=F.lit('"extract"'), skill=t(F.col("skill")), skill_version=canon.number(F.col("skill_version")), source=t(F.col("source")), source_hash=t(F.col("source_hash")),
        budget=canon.number(F.col("budget")), expires=canon.number(F.col("expires")),
    )
    return commit.draft(issued.where("refused is null").withColumn("payload", payload), portal=portal, n=F.col("n"), kind="directive", tier="system", signer=signer, payload=F.col("payload"))


def prepared(directives: DataFrame, texts: DataFrame, frozen: DataFrame, paused: DataFrame, portal: str, now: int) -> DataFrame:
    """Open directives with their text and ``refused``, null where they may run now.

    ``directives``: (directive, source, source_hash, expires, portal, ...), those open;
    ``texts``: (id, text). The same check after the work finds what changed meanwhile.
    """
    t = texts.select(F.col("id").alias("source"), "text")
    state = paused.select("paused").join(frozen.where(F.col("portal") == portal).agg((F.count(F.lit(1)) > 0).alias("frozen")))
    x = directives.join(t, "source", "left").join(F.broadcast(state))
    why = F.when(F.col("frozen"), "frozen: this portal's chain forked; the steward must re-key it").when(F.col("paused"), "paused by the steward")
    why = why.when(F.col("portal") != portal, "no such open directive on this portal").when(F.lit(now) >= F.col("expires"), "directive expired")
    why = why.when(F.col("text").isNull(), "source is not available on this device").when(F.sha2("text", 256) != F.col("source_hash"), "source changed since the directive; rescan")
    return x.withColumn("refused", why).drop("paused", "frozen")


def bad_tools(directives: DataFrame, used: list[str], allowed: DataFrame) -> DataFrame:
    """(directive, bad_tool): the first tool used that the directive's skill does not allow, null where all are allowed."""
    a = allowed.select("skill", F.col("version").alias("skill_version"), "tools")
    x = directives.select("directive", "skill", "skill_version").join(a, ["skill", "skill_version"], "left")
    own = F.array(*(F.lit(t) for t in used)) if used else F.array().cast("array<string>")
    bad = F.filter(own, lambda t: ~F.array_contains(F.coalesce("tools", F.array().cast("array<string>")), t))
    return x.select("directive", F.get(bad, F.lit(0)).alias("bad_tool"))


def run(ready: DataFrame, propose: Callable[[DataFrame], DataFrame], schema: DataFrame, allowed: DataFrame, tools: list[str], portal: str, wall: int) -> tuple[DataFrame, DataFrame]:
    """Run an agent on directives that may run: their results (directive, accepted, rejected) and the facts kept (as ``extract.datom_rows``).

    ``propose`` makes proposals (directive, i, entity, a, v, nu, start, end, quote) of
    texts (directive, text), as ``extract.pattern_facts`` does; ``tools`` are those it used.
    """
    texts = ready.where("refused is null").select("directive", "text", "budget", "skill", "skill_version")
    own = propose(texts.select("directive", "text")).join(bad_tools(texts, tools, allowed), "directive", "left").join(texts.select("directive", "budget"), "directive")
    admitted = extract.admit(own, texts, "directive", "text", schema)
    refused = F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct(F.col("i").cast("bigint").alias("i"), "a", "reason"))))
    counts = admitted.groupBy("directive").agg(F.count_if(F.col("reason").isNull()).alias("accepted"), refused.alias("rejected"))
    empty = F.array().cast("array<struct<i:bigint,a:string,reason:string>>")
    results = texts.select("directive").join(counts, "directive", "left").select("directive", F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("rejected", empty).alias("rejected"))
    return results, extract.datom_rows(admitted, "directive", portal, wall)

import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import canon
from factloom.operators import commit, extract, facts, hierarchy, log, replay, runs
from test_log import SCHEMA, T0, no_datoms

STEWARD, PORTAL = "S", "p-1"


def empty_log(spark):
    return spark.createDataFrame([], SCHEMA)


def add(spark, tx, drafts, now):
    """The log with drafts committed to it, written out as a log on disk would be."""
    new = commit.chained(drafts, commit.heads(tx, hierarchy.tx_hierarchy(tx)), now)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = tx.select(*names).collect() + commit.with_arrival(new, tx).select(*names).orderBy("seq").collect()
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)


def test_a_log_from_its_first_row_to_the_gate(spark):
    tx = empty_log(spark)
    tx = add(spark, tx, commit.bootstrap(tx, STEWARD, PORTAL, "n", T0), T0)
    assert commit.bootstrap(tx, STEWARD, PORTAL, "n", T0).count() == 0
    assert [json.loads(r["payload"]) for r in commit.bootstrap(tx, STEWARD, "p-2", "n", T0).collect()] == [{"pub": "p-2", "role": "portal"}]
    with pytest.raises(log.Rejected, match="different steward"):
        commit.bootstrap(tx, "X", PORTAL, "n", T0)

    texts = {"s1": "willow | treats | fever\nrue | odd | x\n", "s2": "- willow | treats | fever\n"}
    src = spark.createDataFrame(list(texts.items()), "id string, text string")
    places = {i: canon.sha(t) for i, t in texts.items()}
    mapped = commit.draft(spark.range(1), portal=PORTAL, n=0, kind="map", tier="system", signer=PORTAL, payload=canon.canon({"places": places, "names": {}}))
    tx = add(spark, tx, mapped, T0)

    wanted = spark.createDataFrame([("s1", 1), ("s2", 2), ("s9", 3)], "source string, n bigint")
    frozen = log.fork_proofs(tx)
    issued = runs.issue(wanted, replay.places(tx), replay.open_directives(tx), frozen, replay.paused(tx), replay.skills(tx), PORTAL, T0 + 5, 2)
    said = {r["source"]: r["refused"] for r in issued.collect()}
    assert said == {"s1": None, "s2": None, "s9": "source is not in the workspace map"}
    tx = add(spark, tx, runs.directive_rows(issued, PORTAL, PORTAL), T0 + 5)

    open_ = replay.open_directives(tx)
    assert open_.count() == 2
    late = {r["refused"] for r in runs.prepared(open_, src, frozen, replay.paused(tx), PORTAL, T0 + log.TTL_MS + 9).collect()}
    other = {r["source"]: r["refused"] for r in runs.prepared(open_, src.withColumn("text", F.when(F.col("id") == "s1", "edited").otherwise(F.col("text"))), frozen, replay.paused(tx), PORTAL, T0 + 6).collect()}
    assert late == {"directive expired"} and other == {"s1": "source changed since the directive; rescan", "s2": None}
    ready = runs.prepared(open_, src, frozen, replay.paused(tx), PORTAL, T0 + 6)
    assert {r["refused"] for r in ready.collect()} == {None}
    held = runs.prepared(open_, src, frozen, spark.createDataFrame([(True,)], "paused boolean"), PORTAL, T0 + 6)
    assert {r["refused"] for r in held.collect()} == {"paused by the steward"}

    schema = spark.createDataFrame([("treats", True), ("name", False)], "a string, ref boolean")
    allowed = replay.allowed_tools(open_.select("skill", F.col("skill_version").alias("version")), replay.skills(tx))
    propose = lambda t: extract.pattern_facts(t, "directive", "text")
    results, kept = runs.run(ready, propose, schema, allowed, ["read_source"], PORTAL, T0 + 7)
    got = sorted((r["accepted"], [(x["i"], x["reason"]) for x in r["rejected"]]) for r in results.collect())
    assert got == [(1, []), (1, [(1, "attribute not in the schema: odd")])]
    refused, none = runs.run(ready, propose, schema, allowed, ["web"], PORTAL, T0 + 7)
    assert {x["reason"] for r in refused.collect() for x in r["rejected"]} == {"tool not allowed by the skill: web"} and none.count() == 0

    rows = kept.collect()
    drafts = []
    for n, r in enumerate(open_.orderBy("directive").collect()):
        ds = [{"id": k["id"], "e": k["e"], "a": k["a"], "v": json.loads(k["v"]) if k["v"].startswith("{") else k["v"], "ctx": None, "nu": k["nu"], "vf": k["vf"], "vt": None, "quote": k["quote"].asDict(), "support": 1} for k in rows if k["directive"] == r["directive"]]
        drafts.append(commit.draft(spark.range(1), portal=PORTAL, n=n, kind="assert", tier="episode:" + r["directive"], signer=PORTAL, directive=r["directive"], source=r["source"], source_hash=r["source_hash"], payload=canon.canon({"datoms": ds, "rejected": []})))
    tx = add(spark, tx, drafts[0].unionByName(drafts[1]), T0 + 8)
    assert replay.open_directives(tx).count() == 0 and {r["kind"] for r in tx.collect()} >= {"directive", "assert"}

    datoms = facts.facts_of(tx)
    live = facts.located(datoms, tx)
    none = spark.createDataFrame([], "key string, at struct<wall:bigint,counter:bigint,portal:string,id:string>")
    gated = facts.gate(facts.in_episodes(live), none.select("key"), none, none)
    assert gated.count() == 3  # the fact, and the names of its two entities
    tx = add(spark, tx, commit.promotion_rows(gated, live, PORTAL, PORTAL), T0 + 9)
    culture = facts.in_tier(facts.located(facts.facts_of(tx), tx), "culture")
    assert {(r["support"], r["id"][:2]) for r in culture.collect()} == {(2, "d:")} and culture.select("id").distinct().count() == 3
    again = facts.gate(facts.in_episodes(live), culture.select(F.col("culture_key").alias("key")), none, none)
    assert again.count() == 0
    assert log.load(tx, facts.facts_of(tx), signatures=False).count() == tx.count()
    assert [r["keys"] for r in commit.steward_row(spark, STEWARD, "approve", {"keys": ["b", "a"]}).select(F.from_json("payload", "keys array<string>").alias("x")).select("x.keys").collect()] == [["a", "b"]]


def test_open_leases_are_limited(spark):
    tx = empty_log(spark)
    wanted = spark.createDataFrame([(f"s{i}", i) for i in range(12)], "source string, n bigint")
    places = spark.createDataFrame([(PORTAL, f"s{i}", "h") for i in range(12)], "portal string, source string, hash string")
    held = spark.createDataFrame([(PORTAL,), (PORTAL,), ("p-2",)], "portal string")
    got = runs.issue(wanted, places, held, log.fork_proofs(tx), replay.paused(tx), replay.skills(tx), PORTAL, T0, 0)
    assert [r["source"] for r in got.where("refused is null").orderBy("n").collect()] == [f"s{i}" for i in range(6)]
    assert no_datoms(spark).count() == 0

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import canon, signature
from factloom.operators import hierarchy, log, replay

SCHEMA = "seq bigint, id string, portal string, prev string, hlc array<bigint>, kind string, tier string, payload_hash string, signer string, directive string, agent string, skill string, model_hash string, source string, source_hash string, skill_version bigint, skill_current bigint, sig string, payload string"
T0 = 1_700_000_000_000


class Log:
    """Writes a small log as the writers do: hashed headers, chained portals."""

    def __init__(self):
        self.rows, self.tip, self.n = [], {}, 0

    def add(self, kind, payload, portal="p-1", tier="system", signer=None, wall=None, prev="tip", **header):
        self.n += 1
        prev = self.tip.get(portal) if prev == "tip" else prev
        body = canon.canon(payload)
        h = {k: v for k, v in header.items() if v is not None} | {
            "portal": portal, "prev": prev, "hlc": [wall or T0 + self.n, 0], "kind": kind, "tier": tier, "payload_hash": hashlib.sha256(body.encode()).hexdigest(), "signer": signer or ("S" if portal == "steward" else portal),
        }
        i = hashlib.sha256(canon.canon(h).encode()).hexdigest()
        self.tip[portal] = i
        row = {c.split()[0]: None for c in SCHEMA.split(", ")} | h | {"seq": self.n, "id": i, "sig": "", "payload": body}
        self.rows.append(row)
        return i

    def start(self):
        self.add("genesis", {"steward": "S", "roles": {"S": "steward"}, "network": "n", "created": 1}, portal="steward")
        self.add("admit", {"pub": "p-1", "role": "portal"}, portal="steward")
        self.add("admit", {"pub": "p-2", "role": "portal"}, portal="steward")
        return self

    def df(self, spark):
        cols = [c.split()[0] for c in SCHEMA.split(", ")]
        return spark.createDataFrame([tuple(r[c] for c in cols) for r in self.rows], SCHEMA)


def no_datoms(spark, rows=()):
    return spark.createDataFrame(list(rows), "id string, a string, tx string")


def said(df):
    return sorted((r["check"], r["reason"]) for r in df.collect())


def lease(lg, did="d1", portal="p-1", expires=T0 + 1000, budget=2):
    return lg.add("directive", {"id": did, "expires": expires, "budget": budget, "source": "s1", "skill": "ingest", "skill_version": 1}, portal=portal)


def test_a_good_log_has_no_violations(spark):
    lg = Log().start()
    lease(lg)
    lg.add("assert", {"withheld": True, "rejected": []}, tier="episode:d1", directive="d1", source="s1")
    lg.add("promote", {"decision": {"key": "k:1", "support": 2, "rule": "auto"}}, tier="culture")
    tx = lg.df(spark)
    assert said(log.violations(tx, no_datoms(spark))) == [] and said(log.id_violations(tx)) == []
    assert [r["id"] for r in log.load(tx, no_datoms(spark), signatures=False).collect()][0] == lg.rows[0]["id"]
    assert tuple(log.verify(tx, no_datoms(spark), signatures=False).first()) == (True, len(lg.rows), 0, 0)


def test_a_signed_log_loads_until_it_is_edited(spark):
    lg, keys = Log(), {signature.sign(s, "")[0]: s for s in (11, 22)}
    steward, portal = keys
    lg.add("genesis", {"steward": steward, "roles": {steward: "steward", portal: "portal"}}, portal="steward", signer=steward)
    lg.add("map", {"places": {}}, signer=portal)
    for r in lg.rows:
        r["sig"] = signature.sign(keys[r["signer"]], r["id"])[1]
    assert log.load(lg.df(spark), no_datoms(spark)).count() == 2
    none = spark.createDataFrame([("p-1", None, "x", "y")], "portal string, prev string, a string, b string")
    with pytest.raises(log.Rejected, match="proof"):
        log.load(lg.df(spark), no_datoms(spark), none)
    lg.rows[1]["sig"] = lg.rows[0]["sig"]
    with pytest.raises(log.Rejected, match="bad signature"):
        log.load(lg.df(spark), no_datoms(spark))
    lg.rows[1]["tier"] = "dream"
    with pytest.raises(log.Rejected, match="id does not match header"):
        log.load(lg.df(spark), no_datoms(spark), signatures=False)


def test_each_violation(spark):
    lg = Log().start()
    lg.add("pause", {}, portal="p-1")
    lg.add("map", {}, portal="steward")
    lg.add("map", {}, portal="p-9")
    lg.add("dance", {}, portal="p-2")
    lg.add("expire", {"directive": "d0"}, tier="culture", portal="p-2", directive="d0")
    lg.add("map", {"withheld": True}, portal="p-2")
    lg.add("skill", {"name": "ingest", "version": 1, "tools": []}, portal="steward")
    lg.add("skill", {"name": "x", "version": 1, "tools": []}, portal="steward")
    lg.add("skill", {"name": "x", "version": 1, "tools": ["a"]}, portal="steward")
    lg.add("genesis", {"steward": "X", "roles": {}}, portal="steward")
    lg.add("map", {}, portal="p-1", prev="nowhere")
    lg.add("map", {}, portal="p-1", prev=lg.tip["p-2"])
    bad = lg.add("map", {"places": {}}, portal="p-2")
    lg.rows[-1]["payload"] = '{"places":{"x":"y"}}'
    got = {c for c, _ in said(log.violations(lg.df(spark), no_datoms(spark)))}
    assert got == {"V4", "V5", "V6", "V7", "V8", "V9", "V10", "V12", "V13", "V15", "V16", "V20"} and bad
    with pytest.raises(log.Rejected):
        log.load(lg.df(spark), no_datoms(spark), signatures=False)


def test_tampered_header_and_signature(spark):
    lg = Log().start()
    lg.rows[1]["tier"] = "culture"
    assert said(log.id_violations(lg.df(spark))) == [("V1", "id does not match header")]
    pub, sig = signature.sign(77, lg.rows[0]["id"])
    lg.rows = lg.rows[:1]
    lg.rows[0] |= {"sig": sig}
    assert ("V2", "bad signature") in said(log.id_violations(lg.df(spark), signatures=True))


def test_leases(spark):
    lg = Log().start()
    for d, kw in (("d1", {}), ("d2", {"expires": T0 + 3}), ("d3", {"expires": T0 + 100}), ("d4", {"portal": "p-2"}), ("d5", {})):
        lease(lg, d, **kw)
    ok = lg.add("assert", {"rejected": []}, tier="episode:d1", directive="d1")
    lg.add("assert", {"rejected": []}, tier="episode:d1", directive="d1")  # again
    lg.add("assert", {"rejected": []}, tier="episode:d2", directive="d2")  # late
    lg.add("expire", {"directive": "d3"}, directive="d3")  # early
    lg.add("assert", {"rejected": []}, tier="episode:d4", directive="d4")  # foreign
    over = lg.add("assert", {"rejected": []}, tier="episode:d5", directive="d5")
    facts = [(f"f{i}", "treats", over) for i in range(3)] + [("n", "name", over), ("g", "treats", ok)]
    assert said(log.closing_violations(lg.df(spark), no_datoms(spark, facts))) == [
        ("V16", "only the issuing portal can close a directive"), ("V17", "directive already closed"), ("V18", "expiry before the directive's deadline"), ("V18", "result after the directive expired"), ("V19", "result over budget"),
    ]


def forked():
    lg = Log().start()
    a = lg.add("map", {"n": 1})
    lg.add("map", {"n": 2})
    lg.add("map", {"n": 3})
    lg.add("map", {"n": 9}, prev=a)
    lg.add("map", {"n": 8}, portal="p-2")
    return lg, a


def test_forks_cut_a_portal(spark):
    lg, a = forked()
    tx = lg.df(spark)
    proofs = log.fork_proofs(tx)
    assert [(r["portal"], r["prev"]) for r in proofs.collect()] == [("p-1", a)]
    assert log.checked_proofs(proofs.select("portal", "prev", "a", "b"), tx).count() == 1
    assert log.checked_proofs(proofs.select("portal", "prev", "a", F.col("a").alias("b")), tx).count() == 0
    depths = hierarchy.tx_hierarchy(tx)
    kept = {r["id"] for r in log.valid(tx, depths, proofs).collect()}
    assert kept == {r["id"] for r in lg.rows if r["portal"] != "p-1"} | {a}
    assert {r["portal"]: r["depth"] for r in log.tips(depths, tx).collect()} == {"steward": 3, "p-1": 3, "p-2": 1}


def test_replay_does_not_depend_on_order(spark):
    lg = Log().start()
    for k, n in (("pause", 1), ("resume", 1), ("pause", 1)):
        lg.add(k, {}, portal="steward")
    lg.add("approve", {"keys": ["k1", "k2"]}, portal="steward")
    lg.add("approve", {"keys": ["k1"]}, portal="steward")
    lg.add("skill", {"name": "ingest", "version": 2, "tools": ["quote", "read_source"]}, portal="steward")
    lg.add("schema", {"attrs": {"cures": {"card": "many", "kind": "claim", "ref": True, "unique": None}}}, portal="steward")
    lg.add("map", {"places": {"s1": "h1", "s2": "h2"}, "names": {"s1": "one"}})
    lg.add("map", {"places": {"s1": "h3"}})
    lease(lg, "d1"), lease(lg, "d2")
    lg.add("expire", {"directive": "d1"}, directive="d1")
    attrs = spark.createDataFrame([("name", "one", "identity", "state", False), ("cures", "one", None, "claim", False)], "a string, card string, uniq string, kind string, ref boolean")
    seen = set()
    for k in range(4):
        random.Random(k).shuffle(lg.rows)
        tx = lg.df(spark)
        seen.add(json.dumps([
            replay.paused(tx).first()[0], sorted(r["key"] for r in replay.approvals(tx).collect()), sorted(map(str, replay.skills(tx).collect())), sorted(map(str, replay.schema(tx, attrs).collect())),
            sorted(map(str, replay.places(tx).collect())), sorted(map(str, replay.place_names(tx).collect())), sorted(r["directive"] for r in replay.open_directives(tx).collect()),
        ]))
    assert len(seen) == 1
    state = json.loads(seen.pop())
    assert state[0] is True and state[1] == ["k1", "k2"] and state[6] == ["d2"] and any("h3" in x for x in state[4]) and any("cures" in x and "many" in x for x in state[3])
    tools = replay.allowed_tools(spark.createDataFrame([("ingest", 1), ("ingest", 2), ("x", 1)], "skill string, version bigint"), replay.skills(tx))
    assert {(r["skill"], r["version"]): r["tools"] for r in tools.collect()} == {("ingest", 1): ["read_source"], ("ingest", 2): ["quote", "read_source"], ("x", 1): []}


def test_pages_clock_append_and_expiries(spark):
    lg = Log().start()
    for i in range(5):
        lg.add("map", {"n": i})
    lease(lg, "d1", expires=T0 + 5)
    tx = lg.df(spark)
    assert [r["n"] for r in log.page(tx, 2, 3).collect()] == [7, 6, 5]
    assert log.append(tx.limit(4), tx.unionByName(tx)).count() == 5
    due = replay.expiries(replay.open_directives(tx), "p-1", T0 + 5)
    assert [(r["kind"], r["payload"]) for r in due.collect()] == [("expire", '{"directive":"d1"}')]
    c = log.hybrid_clock(spark.createDataFrame([(1, 5), (2, 3), (3, 5), (4, 9)], "i bigint, now bigint").withColumn("p", F.lit("x")), "now", "i", "p", block=2)
    assert [(r["wall"], r["counter"]) for r in c.orderBy("i").collect()] == [(5, 0), (5, 1), (5, 2), (9, 0)]
    rows = {r["id"]: (r["j"], r["header"], r["sig"]) for r in tx.select("id", log.row_json().alias("j")).join(log.headers(tx), "id").collect()}
    for i, (j, header, sig) in rows.items():
        assert j == canon.canon(json.loads(j)) and hashlib.sha256(header.encode()).hexdigest() == i and json.loads(j)["header"] == json.loads(header) and sig == json.loads(j)["sig"]


def test_empty_log(spark):
    tx = Log().df(spark)
    assert said(log.violations(tx, no_datoms(spark))) == [] and replay.paused(tx).first()[0] is False and replay.skills(tx).count() == 1

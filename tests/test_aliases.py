import random

from factloom.functions import canon
from factloom.operators import aliases, facts
from pyspark.sql import functions as F


def grouped(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        lo, hi = sorted((find(a), find(b)))
        up[hi] = lo
    return {(x, find(x)) for x in up if find(x) != x}


def test_representatives_against_union_find(spark):
    rng = random.Random(4)
    for n in (5, 40, 90):
        pairs = [(f"e:{rng.randrange(60):02d}", f"e:{rng.choice('xay')}{rng.randrange(40):02d}") for _ in range(n)] + [("e:01", "e:x00"), ("e:x00", "e:x00")]
        pairs += [("e:x01", "e:a03"), ("e:a03", "e:y04"), ("e:07", "e:08"), ("e:08", "e:03")]  # ids that are both
        chain = [(f"e:c{i}", f"e:d{i}") for i in range(12)] + [(f"e:c{i + 1}", f"e:d{i}") for i in range(12)]
        df = spark.createDataFrame([*pairs, *chain, (None, "e:1"), ("e:1", None)], "e string, i string")
        assert {tuple(r) for r in aliases.representatives(df).collect()} == grouped(pairs + chain)


def test_no_links(spark):
    assert aliases.representatives(spark.createDataFrame([], "e string, i string")).collect() == []


def test_entities_of_one_name_have_one_key(spark):
    schema = spark.createDataFrame([("name", "identity"), ("treats", None)], "a string, uniq string")
    rows = [("d1", "e:1", "name", "Elder  Bark"), ("d2", "e:2", "name", "elder bark "), ("d3", "e:1", "treats", "gout"), ("d4", "e:2", "treats", "gout"), ("d5", "e:3", "name", "rue"), ("d6", "e:3", "name", None)]
    d = spark.createDataFrame(rows, "id string, e string, a string, v string").withColumns({"tier": F.lit("episode:x"), "tx": F.lit("t"), "ctx": F.lit(None).cast("string")})
    tx = spark.createDataFrame([("t", "p", [5, 0])] * 2, "id string, portal string, hlc array<bigint>")
    same = aliases.representatives(aliases.identity_links(d, schema))
    got = {r["id"]: r for r in facts.located(d, tx, (), same).collect()}
    assert len(got) == 6 and got["d3"]["culture_key"] == got["d4"]["culture_key"] and got["d3"]["rep"] <= "e:1"
    own = spark.range(1).select(canon.entity_id("name", F.lit("rue")).alias("i")).first()["i"]
    assert got["d5"]["rep"] == min(own, "e:3")


def test_facts_of_the_payloads(spark):
    payload = '{"datoms":[{"id":"d:1","e":"e:1","a":"treats","v":{"ref":"e:2"},"nu":700,"quote":{"start":0,"end":3,"text":"abc"}},{"id":"d:2","excised":true},{"id":"d:3","e":"e:1","a":"name","v":"Rue"}]}'
    rows = [("t1", "assert", "episode:d", [7, 0], "s1", payload)] * 2 + [("t2", "assert", "episode:e", [8, 0], "s1", '{"withheld": true, "datoms": [{"id":"d:9"}]}'), ("t3", "map", "system", [9, 0], None, "{}")]
    tx = spark.createDataFrame(rows, "id string, kind string, tier string, hlc array<bigint>, source string, payload string")
    got = {r["id"]: r for r in facts.facts_of(tx).collect()}
    assert set(got) == {"d:1", "d:3"} and got["d:1"]["quote"]["end"] == 3 and got["d:1"]["v"] == '{"ref":"e:2"}' and (got["d:3"]["v"], got["d:3"]["t"], got["d:3"]["tier"], got["d:3"]["source"]) == ("Rue", 7, "episode:d", "s1")

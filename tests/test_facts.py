import sys

from pyspark import cloudpickle
from pyspark.sql import Observation
from pyspark.sql import functions as F

from factloom.operators import extract, facts, search
from factloom.sources import texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # for the model below

AT = "struct<wall:bigint,counter:bigint,portal:string,id:string>"


def at(w):
    return (w, 0, "p", f"t{w}")


def evidence(spark, rows):
    return spark.createDataFrame([(k, i, s, at(w)) for k, i, s, w in rows], f"culture_key string, id string, source string, event_at {AT}")


def keyed(spark, rows):
    return spark.createDataFrame([(k, at(w)) for k, w in rows], f"key string, at {AT}")


def gate(spark, ev, promoted=(), approved=(), retracted=()):
    p = spark.createDataFrame([(k,) for k in promoted], "key string")
    return {(r["key"], r["rep"], r["support"], r["rule"]) for r in facts.gate(evidence(spark, ev), p, keyed(spark, approved), keyed(spark, retracted)).collect()}


def test_gate_counts_distinct_sources(spark):
    ev = [("k1", "d2", "s1", 1), ("k1", "d1", "s1", 2), ("k2", "d5", "s1", 1), ("k2", "d4", "s2", 1), ("k3", "d6", None, 1), ("k3", "d7", "s9", 1), ("k4", "a", "s1", 1), ("k4", "b", "s2", 1)]
    assert gate(spark, ev, promoted=["k4"]) == {("k2", "d4", 2, "auto"), ("k3", "d6", 2, "auto")}
    assert gate(spark, ev[:2], approved=[("k1", 5)]) == {("k1", "d1", 1, "approved")}
    assert gate(spark, []) == set()


def test_gate_after_a_retraction(spark):
    ev = [("k", "a", "s1", 1), ("k", "b", "s2", 2), ("k", "c", "s3", 7), ("k", "d", "s4", 8)]
    r = [("k", 5)]
    assert gate(spark, ev[:2], retracted=r) == set()  # old evidence is spent
    assert gate(spark, ev[:3], retracted=r) == set()  # one fresh source is not enough
    assert gate(spark, ev, retracted=r) == {("k", "c", 2, "auto")}  # fresh sources only
    assert gate(spark, ev[:3], retracted=r, approved=[("k", 4)]) == set()  # an old approval is spent too
    assert gate(spark, ev[:3], retracted=r, approved=[("k", 6)]) == {("k", "c", 1, "approved")}
    assert gate(spark, ev[:2], retracted=r, approved=[("k", 6)]) == {("k", "a", 2, "auto")}  # stale evidence still supplies the row


def facts_df(spark, rows):
    return spark.createDataFrame([(*r[:6], r[6], at(r[7]), (0, 1, r[8])) for r in rows], f"id string, e string, a string, v string, tier string, support bigint, source string, at {AT}, quote struct<start:bigint,end:bigint,text:string>").withColumns(
        {"nu": F.lit(500).cast("bigint"), "vf": F.col("at.wall"), "ctx": F.lit(None).cast("string"), "culture_key": F.concat_ws("|", "e", "a", "v"), "rep": F.col("e")}
    )


ROWS = [
    ("n1", "e:1", "name", "Ginger", "culture", 1, None, 1, ""), ("n2", "e:2", "name", "gout", "episode:x", 1, "s1", 1, ""), ("f1", "e:1", "treats", '{"ref": "e:2"}', "culture", 2, None, 2, "Ginger treats gout."),
    ("h1", "e:1", "causes", "mouth burning", "episode:x", 1, "s1", 3, "it burns"), ("h2", "e:1", "causes", "mouth burning", "episode:y", 1, "s2", 4, "burns the mouth of some who take it for gout"),
    ("h3", "e:1", "treats", '{"ref":"e:2"}', "episode:y", 1, "s2", 5, "a held twin of a settled fact"),
]


def shown(spark):
    f = facts_df(spark, ROWS)
    return facts.displayed(f, facts.names(f))


def test_recall_orders_settled_and_held(spark):
    x = shown(spark)
    promoted = facts.in_tier(x, "culture").select(F.col("culture_key").alias("key"))
    got = search.recall(facts.in_tier(x, "culture"), facts.in_episodes(x), promoted, "Does ginger cause mouth burning or gout?", 8)
    rows = got.collect()
    assert [(r["status"], r["value"], r["support"], r["score"]) for r in rows] == [("held", "mouth burning", 2, 9.0), ("settled", "gout", 2, 4.5)]
    assert rows[0]["quote"] == "burns the mouth of some who take it for gout"
    lines = [r["line"] for r in search.prompt_lines(got).orderBy("n").collect()]
    assert lines[1] == '[2] Ginger treats gout (2 sources) (source says: "Ginger treats gout.")'
    assert lines[0].startswith("[1] Ginger causes mouth burning (unconfirmed: 2 sources, not yet through the gate)")
    assert "general knowledge" in search.system_prompt([]) and "[1]" in search.system_prompt(lines)
    assert tuple(search.counts(got).first()) == (1, 1)
    asked = search.messages([("user", str(n)) for n in range(9)], "why?", lines)
    assert len(asked) == 8 and asked[0]["role"] == "system" and asked[1]["content"] == "3" and asked[-1] == {"role": "user", "content": "why?"}
    assert search.messages([], "why?", None) == [{"role": "user", "content": "why?"}]


def test_memory_and_settled_values(spark):
    c = facts.in_tier(shown(spark), "culture")
    assert [(r["entity"], r["value"]) for r in facts.memory(c, " TREATS Gout ").collect()] == [("Ginger", "gout")]
    assert facts.memory(c, "no%such_").count() == 0
    schema = spark.createDataFrame([("date", "one", "state"), ("defined_as", "one", "claim"), ("treats", "many", "claim")], "a string, card string, kind string")
    f = facts_df(spark, [("b", "e", "date", "1", "culture", 9, None, 1, ""), ("a", "e", "date", "2", "culture", 1, None, 5, ""), ("z", "e", "date", "3", "dream", 1, None, 9, ""), ("d", "e", "defined_as", "x", "culture", 1, None, 9, ""), ("c", "e", "defined_as", "y", "culture", 4, None, 1, "")])
    f = facts.in_tier(f, "culture")
    assert [r["v"] for r in facts.settled_one(f, schema, "state").collect()] == ["2"] and [r["v"] for r in facts.settled_one(f, schema, "claim").collect()] == ["y"]
    both = f.unionByName(f.withColumn("ctx", F.lit("other")).withColumn("v", F.lit("9")))
    assert sorted((r["ctx"] or "", r["v"]) for r in facts.settled_one(both, schema, "state").collect()) == [("", "2"), ("other", "9")]
    m = facts_df(spark, [("1", "e", "treats", "b", "culture", 1, None, 1, ""), ("2", "e", "treats", "a", "culture", 1, None, 1, ""), ("3", "e", "treats", "a", "culture", 1, None, 1, ""), ("4", "e", "odd", "q", "culture", 1, None, 1, "")])
    assert {(r["a"], tuple(r["vals"])) for r in facts.settled_many(m, schema).collect()} == {("treats", ('"a"', '"b"')), ("odd", ('"q"',))}


HANDBOOK = "# Notes\n\n- ginger | treats | gout\r\n* elder bark | contains | sambucin\nno fact | here\n ginger | Derived From | x\na | b | c | d\n| treats | y\nginger | treats | pain\n"


def test_pattern_facts_quote_their_lines(spark):
    docs = spark.createDataFrame([("d", HANDBOOK), ("n", None), ("e", "")], "id string, text string")
    got = extract.pattern_facts(docs, "id", "text").orderBy("start").collect()
    assert [(r["entity"], r["a"], r["v"]) for r in got] == [("ginger", "treats", "gout"), ("elder bark", "contains", "sambucin"), ("ginger", "derived_from", "x"), ("ginger", "treats", "pain")]
    assert all(HANDBOOK[r["start"]:r["end"]] == r["quote"] for r in got) and not any("\r" in r["quote"] for r in got)


SCHEMA = [("name", False), ("treats", True), ("contains", True), ("date", False)]


def schema(spark):
    return spark.createDataFrame(SCHEMA, "a string, ref boolean")


def test_admission_ladder_and_budget(spark):
    docs = spark.createDataFrame([("d", HANDBOOK)], "id string, text string")
    p = extract.pattern_facts(docs, "id", "text")
    a = extract.admit(p, docs, "id", "text", schema(spark), budget=2).orderBy("i").collect()
    assert [r["reason"] for r in a] == [None, None, "attribute not in the schema: derived_from", "over budget"]
    assert {r["reason"] for r in extract.admit(p, docs, "id", "text", schema(spark), bad_tool="web").collect()} == {"tool not allowed by the skill: web"}
    forged = p.withColumn("quote", F.lit("else")).unionByName(p.withColumn("start", F.lit(-1).cast("bigint"))).withColumn("i", F.pmod(F.xxhash64("i", "quote", "start"), F.lit(1_000_000)).cast("int"))
    assert {r["reason"] for r in extract.admit(forged, docs, "id", "text", schema(spark)).collect()} == {"quote does not match the source"}
    rows = extract.datom_rows(extract.admit(p, docs, "id", "text", schema(spark)), "id", "p-1", 7).collect()
    assert len(rows) == 9 and {r["nu"] for r in rows} == {800, 1000} and sum(r["a"] == "name" for r in rows) == 6
    names = {r["v"]: r["e"] for r in rows if r["a"] == "name"}
    assert any(r["v"] == f'{{"ref":"{names["gout"]}"}}' and r["e"] == names["ginger"] for r in rows)


def test_passages_end_at_breaks():
    text = ("One sentence here. " * 30 + "\n\n") * 12
    cuts = extract.passage_bounds(text)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(b - a <= 2400 + 2 for a, b in cuts) and all(x[1] == y[0] for x, y in zip(cuts, cuts[1:]))
    assert extract.passage_bounds("") == [] and extract.passage_bounds(" \n ") == [] and extract.passage_bounds("x" * 6000) == [(0, 2400), (2400, 4800), (4800, 6000)]


class Fake:
    def id(self):
        return "model:fake"

    def generate(self, system, user, most):
        assert "treats" in system and user.startswith("Passage:\n")
        return "- elder bark | treats | gout | \"used against gout\"\nNONE\nbad line\nelder bark | TREATS | Gout | used against gout\nx | treats | y | invented quote|with pipe\na | b | c |\n"


def test_model_facts(spark):
    docs = spark.createDataFrame([("d", "Elder bark was used against gout.")], "id string, text string")
    out = extract.generated(docs, "id", "text", Fake, ["name", "treats"])
    got = extract.model_facts(out).orderBy("i").collect()
    assert [(r["entity"], r["a"], r["v"], r["start"], r["end"], r["quote"]) for r in got] == [("elder bark", "treats", "gout", 15, 32, "used against gout"), ("x", "treats", "y", -1, -1, "invented quote|with pipe")]
    seen = Observation()
    extract.watched(out, seen).collect()
    assert seen.get == {"passages": 1, "texts": 1, "characters": len(Fake().generate("treats", "Passage:\n", 0))}
    assert extract.chosen("pattern", None) == extract.chosen("pattern", "model", False) == "pattern" and extract.chosen("pattern", "model") == "model"
    assert [tuple(r) for r in extract.agreed(out, extract.model_facts(out)).collect()] == [("d", 0, 2, 1)]


def test_text_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.md").write_text("eins")
    (tmp_path / "two.csv").write_text("x,y\n1,2")
    (tmp_path / "A.TXT").write_text("loud")
    (tmp_path / ".hidden.txt").write_text("no")
    (tmp_path / "three.pdf").write_text("no")
    (tmp_path / "big.txt").write_text("x" * 200)
    f = texts.folder(spark, str(tmp_path), most_bytes=100)
    assert {(r["name"], r["text"]) for r in f.collect()} == {("a/one.md", "eins"), ("two.csv", "x,y\n1,2"), ("A.TXT", "loud")}
    s = texts.bundled(spark, str(tmp_path / "a"))
    assert [r["id"] for r in s.collect()] == ["sample:one.md"]
    both = texts.union(f, s)
    assert texts.listing(both).count() == 4 and texts.read(both, "sample:one.md").first()[0] == "eins"
    old = spark.createDataFrame([("sample:one.md", s.first()["hash"])], "source string, hash string")
    assert texts.changed(texts.listing(both), old).count() == 3
    assert sorted(r["n"] for r in texts.duplicates(both).collect()) == [1, 1, 2]

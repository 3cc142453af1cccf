import numpy as np

from factloom.llm import quality, rules
from factloom.llm.quality_train import planted, reading

PROSE = "The dose was raised to 20 mg in the first week, without harm. Most of them slept well and had no trouble with it."
TABLE = "\n".join(f"{i},{i * 7},Zelitz,{i * 3}" for i in range(40))


def test_statistics(spark):
    df = spark.createDataFrame([(1, "One two.\nThe third line"), (2, None), (3, "")], "doc_id bigint, text string")
    r = {x["doc_id"]: x for x in quality.text_stats(df).collect()}
    assert r[1]["words"] == 5 and r[1]["mean_word"] == round(18 / 5, 6) and r[1]["punctuated_lines"] == 0.5 and r[1]["common"] == 0.4
    assert r[2]["words"] == r[3]["words"] == 0 and r[2]["symbols"] == 0.0


def test_prose_and_junk(spark):
    rows = [(1, PROSE), (2, TABLE), (3, PROSE + "\n" + TABLE), (4, PROSE.upper()), (5, None), (6, ""), (7, " ".join(PROSE.replace("20", str(i)).replace("week", f"w{chr(97 + i % 26)}rd{chr(97 + i % 17)}") for i in range(300))), (8, "accept all " * 60), (9, PROSE + "\n- a | treats | b\n- a | date | 1901"), (2, TABLE)]
    got = sorted(r[0] for r in quality.not_prose(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [2, 2, 3, 8]
    assert [d for d, t in rows if reading(t)] == [2, 3, 8, 2]


def test_rule_list_finds_thresholds():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = (x[:, 0] < 0.3) | ((x[:, 1] > 0.8) & (x[:, 2] < 0.5))
    got = rules.learn(x, y, ("a", "b", "c"))
    assert (rules.predict(got, rng.random((1, 3)), ("a", "b", "c")).shape) == (1,)
    t = rng.random((600, 3))
    assert (rules.predict(got, t, ("a", "b", "c")) != ((t[:, 0] < 0.3) | ((t[:, 1] > 0.8) & (t[:, 2] < 0.5)))).mean() < 0.03
    assert quality.case_expression(got).startswith("CASE WHEN ")


def test_planted_classes_are_told_apart(spark):
    words = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    made = planted(words, 400, seed=9)
    assert 60 < sum(j for _, j in made) < 200
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id bigint, text string")
    junk = {r[0] for r in quality.not_prose(df).collect()}
    assert sum((i in junk) != j for i, (_, j) in enumerate(made)) <= 4


def test_a_rule_that_fails_on_the_pruning_part_is_dropped():
    rng = np.random.default_rng(3)
    x, y = rng.random((300, 4)), rng.random(300) < 0.5
    assert rules.learn(x, y, ("a", "b", "c", "d"))["rules"] == []

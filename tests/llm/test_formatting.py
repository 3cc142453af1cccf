from pyspark.sql import functions as F

from factloom.llm import formatting

SCHEMA = "id string, a string, v string, q string, digest int, canon string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    report, members = formatting.collapse(df, "id", "a", F.col("v"), F.col("q"))
    return {tuple(r) for r in report.collect()}, {tuple(r) for r in members.collect()}


def test_typography_and_field_order_are_ignored(spark):
    report, members = run(spark, [
        ("d2", "x", "Take  AFTER rest.", "name: Bo; use= gout"),
        ("d1", "x", "take after\nrest", "USE : Gout | NAME=bo;"),
        ("d3", "x", "rest after take", "name: Bo; use= gout"),
        ("d4", "x", "take after rest", "name: gout; use: bo"),
        ("d5", "y", "take after rest", "name: bo; use: gout"),
        ("d2", "x", "Take  AFTER rest.", "name: Bo; use= gout"),
    ])
    assert members == {("d1", "d2")}
    assert report == {("d1", 2), ("d3", 1), ("d4", 1), ("d5", 1)}


def test_nulls_empty_and_long_texts(spark):
    long = "word " * 20_000
    report, members = run(spark, [("a", None, None, None), ("b", None, "", ""), (None, "x", "v", "q"), ("c", "x", long, "n: 1"), ("d", "x", long.upper(), "N=1")])
    assert members == {("a", "b"), ("c", "d")}
    assert run(spark, []) == (set(), set())


def test_ids_that_differ_count_once(spark):
    report, _ = run(spark, [("a", "x", "one", ""), ("a", "x", "two", "")])
    assert report == {("a", 1)}


def test_digests_that_collide_are_told_apart(spark):
    rows = [(f"r{i:02d}", "x", f"text {i % 12}!", f"name: {i % 4}; use: y") for i in range(48)]
    df = spark.createDataFrame(rows, "id string, a string, v string, q string")
    short = lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 1))
    whole, few = (formatting.collapse(df, "id", "a", F.col("v"), F.col("q"), *d) for d in ((), (short,)))
    for a, b in zip(whole, few):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert sum(r["copies"] for r in few[0].collect()) == 48 and few[0].count() == 12

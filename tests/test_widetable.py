import datetime

import pytest
from pyspark.sql import functions as F

from factloom.functions import typed
from factloom.operators import widetable

TYPES = {"dose_mg": "bigint", "otc": "boolean", "date": "date", "form": "text", "made_of": "ref"}


def test_registers_and_types(spark):
    rows = [
        ("1", "e1", "dose_mg", "250 mg", 5, "culture"), ("2", "e1", "dose_mg", "300", 9, "culture"), ("3", "e1", "dose_mg", "301", 9, "culture"), ("2", "e1", "dose_mg", "300", 9, "culture"),
        ("4", "e1", "dose_mg", "~999", 99, "culture"), ("5", "e1", "dose_mg", "7", 99, "dream"), ("6", "e1", "otc", " Yes", None, "culture"), ("7", "e2", "date", "3. Sep 2001", 1, "culture"),
        ("8", "e2", "form", " a b\t", None, "culture"), ("9", "e2", "form", "  ", 9, "culture"), (None, "e2", "made_of", '{"ref": "e9"}', 1, "culture"), ("a", None, "form", "x", 1, "culture"), ("b", "e3", None, "x", 1, "culture"), ("c", "e3", "form", None, 1, "culture"),
        ("d", "e4", "form", "x" * 100_000, 1, "culture"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, e string, a string, v string, vf bigint, tier string, val int")
    got = {r["e"]: r.asDict() for r in widetable.wide_table(df, TYPES).collect()}
    assert got.keys() == {"e1", "e2", "e4"}
    assert got["e1"] == {"e": "e1", "dose_mg": 300, "otc": True, "date": None, "form": None, "made_of": None}
    assert got["e2"] == {"e": "e2", "dose_mg": None, "otc": None, "date": datetime.date(2001, 9, 3), "form": "a b", "made_of": "e9"}
    assert {tuple(r) for r in widetable.cells(widetable.wide_table(df, {"dose_mg": "bigint", "otc": "boolean"})).collect()} == {("e1", "dose_mg", "300"), ("e1", "otc", "true")}


def test_empty(spark):
    df = spark.createDataFrame([], "id string, e string, a string, v string, vf bigint, tier string")
    assert widetable.wide_table(df, TYPES).collect() == [] and widetable.wide_table(df, {}).columns == ["e"]


@pytest.mark.parametrize("v, want", [("1,200", 1200), ("12,00", None), ("75.0", 75), ("75.5", None), ("+5", 5), ("-5", -5), ("007", 7), ("5-6", None), ("<5", None), ("about 5", None), ("9" * 30, None), ("", None), (None, None), ("40 MIN", 40), ("40 mg", None), ("٣", None)])
def test_whole_numbers(spark, v, want):
    assert spark.createDataFrame([(v,)], "v string").select(typed.as_bigint(F.col("v"), F.lit("min"))).first()[0] == want


@pytest.mark.parametrize("v, want", [("2001-02-29", None), ("29.02.2004", "2004-02-29"), ("2004/2/9", "2004-02-09"), ("20040209", "2004-02-09"), ("2004-02-09T10:00:00Z", "2004-02-09"), ("May 2004", None), ("2004", None), ("c. 2004", None), ("9 Mai 2004", None), ("Feb 9, 2004", "2004-02-09"), ("2004-02/09", None)])
def test_dates(spark, v, want):
    got = spark.createDataFrame([(v,)], "v string").select(typed.as_date(F.col("v")).cast("string")).first()[0]
    assert got == want

import hashlib
import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from factloom.functions import canon, signature, text

values = st.recursive(st.none() | st.booleans() | st.integers(-(2**60), 2**60) | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abcXY", max_size=3), x, max_size=3), max_leaves=8)


@settings(max_examples=60, deadline=None)
@given(values)
def test_canonical_json_reads_back_and_is_sorted(v):
    s = canon.canon(v)
    assert json.loads(s) == v and canon.canon(json.loads(s)) == s


def test_canonical_json_in_columns(spark):
    rows = [("a\"b\\c\n\t\x01\x1f", 5), ("x y", None), (None, 1), ("\\u001F", 2), ("ä🌡/", 3)]
    df = spark.createDataFrame(rows, "s string, n bigint")
    got = [r[0] for r in df.select(canon.obj(b=canon.number(F.col("n")), a=canon.text(F.col("s")))).collect()]
    assert got == [canon.canon({"a": s, "b": n}) for s, n in rows]


def test_canonical_of_texts(spark):
    rows = ['{"b": 1, "a": [null, true]}', "{}", "1.5", '{"a":1} x', None, '"\\u001f"']
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    assert [r[0] for r in df.select(canon.canonical(F.col("s"))).collect()] == ['{"a":[null,true],"b":1}', "{}", None, None, None, '"\\u001f"']
    assert df.select(canon.canonical_native(F.col("s"))).first()[0] == '{"a":[null,true],"b":1}'


def test_ids(spark):
    r = spark.createDataFrame([("  Elder \n Bark ", "e:1", '{"ref": "e:2"}')], "n string, e string, v string").select(
        canon.entity_id("name", F.col("n")).alias("i"), canon.fact_key(F.lit("culture"), F.col("e"), F.lit("treats"), F.col("v")).alias("k")
    ).first()
    h = lambda x: hashlib.sha256(canon.canon(x).encode()).hexdigest()
    assert r["i"] == "e:" + h(["ident", "name", "elder bark"])[:24]
    assert r["k"] == "k:" + h(["culture", "e:1", "treats", {"ref": "e:2"}, None])[:32]


def test_words_quotes_and_answers(spark):
    df = spark.createDataFrame([("What treats the Cramps? It’s TONICs, gas gas", '“ quoted "x" ”', "<think>hm</think> It is [1], not [12].", "q" * 250)], "w string, q string, a string, l string")
    r = df.select(text.words(F.col("w")).alias("w"), text.unquoted(F.col("q")).alias("q"), *(c.alias(n) for c, n in zip(text.split_thinking(F.col("a")), "ta")), text.citations(F.col("a")).alias("c"), text.cut_quote(F.col("l")).alias("l")).first()
    assert r["w"] == ["treat", "cramp", "tonic", "gas"] and r["q"] == 'quoted "x"' and (r["t"], r["a"]) == ("hm", "It is [1], not [12].") and r["c"] == [1, 12]
    assert len(r["l"]) == 200 and r["l"].endswith("…")
    assert [x[0] for x in spark.createDataFrame([(5,), (-2,), (2048,), (3_600_000,), (5_250_000_000,)], "n bigint").select(text.size_text(F.col("n"))).collect()] == ["5 B", "0 B", "2048 B", "4 MB", "5.25 GB"]
    assert [x[0] for x in spark.createDataFrame([("dir:abcdefghijkl",), ("tx:abc",), (None,)], "s string").select(text.short_id(F.col("s"))).collect()] == ["abcdefghij", "tx:abc", None]
    assert [x[0] for x in spark.createDataFrame([(1_240_000_000,), (40_000_000,)], "n bigint").select(text.count_text(F.col("n"))).collect()] == ["1.24B", "40M"]


def test_signatures(spark):
    pub, sig = signature.sign(12345678901234567890, "a" * 64)
    rows = [(pub, sig, "a" * 64), (pub, sig, "b" * 64), (pub, sig[:-2] + "00", "a" * 64), ("04ff", sig, "a" * 64), (None, sig, "x"), (pub, "zz", "x")]
    df = spark.createDataFrame(rows, "p string, s string, m string")
    assert [r[0] for r in df.select(signature.verified("p", "s", "m")).collect()] == [True, False, False, False, False, False]


@pytest.mark.parametrize("s", ["", "  ", None])
def test_empty_words(spark, s):
    got = spark.createDataFrame([(s,)], "s string").select(text.words(F.col("s"))).first()[0]
    assert not got


def test_portal_names_and_whole_rows(spark):
    pub = "04ab"
    df = spark.createDataFrame([(pub,)], "p string").select(canon.portal_name(F.col("p")).alias("n"))
    assert df.first()["n"] == "p-" + hashlib.sha256(bytes.fromhex(pub)).hexdigest()[:8]

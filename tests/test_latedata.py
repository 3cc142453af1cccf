import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import latedata


def brute(rows, allowed):
    first = {}
    for i, k, s, w in rows:
        if None not in (i, s, w):
            first[i] = min(first.get(i, (s, w, k or "")), (s, w, k or ""))
    keys = {i: k for i, k, s, w in rows if i in first and (s, w, k or "") == first[i]}
    late = set()
    for i, (s, w, _) in first.items():
        marks = [w2 for j, (s2, w2, _) in first.items() if s2 < s and keys[j] == keys[i]]
        if marks and max(marks) - w > allowed:
            late.add(i)
    counts = {}
    for i, (s, w, _) in first.items():
        if i not in late:
            counts[keys[i], w // 10 * 10] = counts.get((keys[i], w // 10 * 10), 0) + 1
    return late, counts


@pytest.mark.parametrize("block", [3, 16, 1 << 17])
def test_watermark_in_blocks(spark, block):
    rng = random.Random(2)
    rows = [(f"i{n}", rng.choice(["hot", "hot", "a", "b", None]), n if rng.random() < 0.9 else n - 1, n + rng.randrange(-40, 10)) for n in range(200)]
    rows += [(i, k, s + 300, w) for i, k, s, w in rng.sample(rows, 30)] + [(None, "a", 1, 1), ("x", "a", None, 1), ("y", "a", 1, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "i string, k string, s bigint, w bigint, mark string")
    fine, late = latedata.split_late(df, "i", "k", "s", F.col("w"), 20, block)
    want_late, want = brute(rows, 20)
    assert {r["id"] for r in late.collect()} == want_late and want_late
    assert {(r["key"], r["period"]): r["n"] for r in latedata.period_counts(fine, 10).collect()} == want


def test_empty(spark):
    df = spark.createDataFrame([], "i string, k string, s bigint, w bigint")
    assert [x.count() for x in latedata.split_late(df, "i", "k", "s", F.col("w"))] == [0, 0]

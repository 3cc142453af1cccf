import random

import pytest

from factloom.llm import packing


def sizes(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "id bigint, size bigint, bin int, fill int")


@pytest.mark.parametrize("per_task", [20, 90, 100_000])
def test_every_item_once_within_capacity_and_tight(spark, per_task):
    rng = random.Random(1)
    rows = [(i, min(250, int(rng.expovariate(1 / 25)) + 1)) for i in range(600)] + [(1000, 100), (1001, 0), (1002, 230)]
    got = packing.pack(sizes(spark, rows + [(None, 5), (7000, None), (7001, -3)]), "id", "size", 100, per_task).collect()
    per: dict = {}
    fill: dict = {}
    for r in got:
        per[r["id"]] = per.get(r["id"], 0) + r["size"]
        fill[r["bin"]] = fill.get(r["bin"], 0) + r["size"]
        assert r["size"] <= 100
    assert per == dict(rows)
    assert all(f <= 100 for f in fill.values()) and all(fill[r["bin"]] == r["fill"] for r in got)
    pieces = {i: sum(r["id"] == i for r in got) for i in per}
    assert all(pieces[i] == max(1, -(-n // 100)) for i, n in rows)
    least = -(-sum(n for _, n in rows) // 100)
    assert len([f for f in fill.values() if f]) <= 1.02 * least + 2


def test_items_that_never_fit_together_end(spark):
    got = packing.pack(sizes(spark, [(i, 60) for i in range(200)]), "id", "size", 100, 20).collect()
    assert len({r["bin"] for r in got}) == 200


def test_empty_and_repeated(spark):
    assert packing.pack(sizes(spark, []), "id", "size").collect() == []
    got = packing.pack(sizes(spark, [(1, 30), (1, 30)]), "id", "size", 100).collect()
    assert [r["size"] for r in got] == [30, 30]


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "wörter " * 3000)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["tokens"] for r in packing.token_counts(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 3000


def test_packing_is_checked_and_measured(spark):
    docs = spark.createDataFrame([(i, "word " * (i * 40)) for i in range(12)] + [(50, None), (51, ""), (52, "word " * 9000)], "doc_id bigint, text string")
    packed = packing.contexts(docs, 1000)
    assert {(r["whole"], r["fits"]) for r in packing.checked(docs, packed, 1000).collect()} == {(True, True)}
    lost = packing.checked(docs, packed.where("piece <> 3"), 1000).where("not whole").collect()
    assert [r["doc_id"] for r in lost] == [52]
    over = packing.checked(docs, packed.withColumn("context", packed["context"] * 0), 1000).where("fits").count()
    assert over == 0
    f = packing.fill(packed, 1000).first()
    assert f["least"] <= f["contexts"] <= f["least"] + 2 and 0 <= f["unused"] < 0.2


@pytest.mark.parametrize("per_task", [200, 1000])
def test_levels_pack_about_as_well_as_one_task(spark, per_task):
    rng = random.Random(6)
    rows = [(i, min(4096, int(rng.lognormvariate(5.5, 1.0)) + 1)) for i in range(4000)]
    own = packing.pack(sizes(spark, rows), "id", "size", 4096, per_task)
    one = len(packing.best_fit(rows, 4096)[1])
    assert own.select("bin").distinct().count() <= 1.01 * one + 1

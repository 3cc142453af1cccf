import random

import pytest

from factloom.llm import components


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    return {(find(x), x) for x in list(up) if find(x) != x}


def run(spark, edges, cell_edges):
    df = spark.createDataFrame(edges, "u string, v string")
    return {tuple(r) for r in components.components(df, "u", "v", cell_edges).collect()}


@pytest.mark.parametrize("cell_edges", [5, 40, 10_000])
def test_random_graph_with_hub_loops_and_nulls(spark, cell_edges):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(120):03d}", f"n{rng.randrange(120):03d}") for _ in range(70)]
    edges += [("hub", f"h{i}") for i in range(60)] + [("x", "x"), (None, "y"), ("z", None), (None, None)] + [("hub", "h1")] * 5
    assert run(spark, edges, cell_edges) == brute(edges)


def test_chain_in_id_order_shrinks(spark):
    edges = [(f"{i:04d}", f"{i + 1:04d}") for i in range(400)]
    assert run(spark, edges, 60) == {("0000", f"{i:04d}") for i in range(1, 401)}


def test_empty(spark):
    assert run(spark, [], 10) == set()


def test_forests_of_one_cell_merge(spark):
    rng = random.Random(9)
    edges = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(260)] + [("hub", f"h{i}") for i in range(200)]
    df = spark.createDataFrame(edges, "u string, v string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "25")
    try:
        got = {tuple(r) for r in components.components(df, "u", "v", forest=20).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(edges)


def test_a_star_of_a_million_edges(spark):
    star = spark.range(1_000_000).selectExpr("'hub' as u", "concat('z', id) as v")
    got = components.components(star, "u", "v").selectExpr("count(*) as n", "count(distinct member) as m", "min(first) as a", "max(first) as b").first()
    assert tuple(got) == (1_000_000, 1_000_000, "hub", "hub")


def test_blocks_follow_the_width_of_the_cluster():
    cells = lambda n, width: (b := components.blocks_for(n, width)) * (b + 1) // 2
    assert cells(84_000, 18) >= 18 and cells(32_000, 8) >= 8 and cells(500, 18) == 1 and cells(10**9, 18) * components.CELL_EDGES >= 10**9

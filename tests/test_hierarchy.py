import random

import pytest

from factloom import runtime
from factloom.operators import hierarchy, lineage


def brute(rows):
    parent = {}
    for i, p in rows:
        if i is not None:
            p = p or None
            parent[i] = min((x for x in (parent.get(i), p) if x), default=None) if i in parent else p
    out = {}
    for i in parent:
        path, x = [], i
        while x is not None and x in parent and x not in path:
            path.append(x)
            x = parent[x]
        if x is None or x not in parent:
            out[i] = (path[-1], len(path))
        else:
            out[i] = (min(path[path.index(x):]), -1)
    return {(i, *v) for i, v in out.items()}


def forest(seed, n=300):
    rng = random.Random(seed)
    name = lambda k: f"n{k * 7919 % 10007:05d}"
    rows = [(name(k), name(k - 1) if k % 40 else None) for k in range(n)]  # chains
    rows += [(name(1000 + k), name(rng.randrange(n))) for k in range(150)]  # hanging anywhere
    rows += [(name(2000 + k), name(2000 + (k + 1) % 7)) for k in range(7)]  # a circle, and nodes below it
    rows += [(name(2100 + k), name(2000 + k % 7) if k < 5 else name(2100 + k - 5)) for k in range(40)]
    rows += [("self", "self"), ("under", "self"), ("lost", "nowhere"), ("blank", ""), (None, "x"), ("two", "lost"), ("two", "blank"), ("two", None)]
    rows += rng.sample(rows[:300], 50)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("per_task, spread, near", [(100_000, 1, "id"), (60, 12, "id"), (30, 40, "id"), (60, 12, "near"), (25, 30, "near")])
def test_roots_depths_and_circles(spark, per_task, spread, near):
    rows = forest(per_task)
    order = {r: k for k, r in enumerate(dict.fromkeys(r for r in sorted(rows, key=str)))}
    df = spark.createDataFrame([(i, p, order[i, p], 5) for i, p in rows], "id string, parent string, near int, root int")
    got = {tuple(r) for r in hierarchy.hierarchy(df, "id", "parent", [near], per_task, spread).select("id", "root", "depth").collect()}
    assert got == brute(rows)


def test_long_chain_without_order(spark):
    n = 700
    ids = [f"{random.Random(k).random():.12f}" for k in range(n)]
    df = spark.createDataFrame([(ids[k], ids[k - 1] if k else None) for k in range(n)], "id string, parent string")
    got = {r["id"]: (r["root"], r["depth"]) for r in hierarchy.hierarchy(df, "id", "parent", ["id"], 50, 14).collect()}
    assert got == {ids[k]: (ids[0], k + 1) for k in range(n)}


def test_empty(spark):
    assert hierarchy.hierarchy(spark.createDataFrame([], "id string, parent string"), "id", "parent", ["id"]).collect() == []


@pytest.mark.parametrize("per_task, spread", [(100_000, 1), (60, 12), (25, 40)])
def test_descendants_and_paths(spark, per_task, spread):
    rows = forest(9)
    df = spark.createDataFrame(rows, "id string, parent string")
    tree = brute(rows)
    parent = {}
    for i, p in rows:
        if i is not None and p:
            parent[i] = min(p, parent.get(i, p))
    ok = {i for i, _, d in tree if d > 0}
    path, below = {}, dict.fromkeys(ok, 0)
    for i in ok:
        p = [i]
        while parent.get(p[0]) in ok:
            p.insert(0, parent[p[0]])
        path[i] = p
        for x in p[:-1]:
            below[x] += 1
    got = {r["id"]: r["descendants"] for r in lineage.descendants(df, "id", "parent", ["id"], per_task, spread).collect()}
    assert got == below | {i: None for i, _, d in tree if d < 0}
    index = lineage.path_index(df, "id", "parent", ["id"], per_task, spread)
    want = sorted(ok)[::25]
    spelled = {r["id"]: r["path"] for r in lineage.paths(index, spark.createDataFrame([(x,) for x in want], "id string")).collect()}
    assert spelled == {i: path[i] for i in want}


@pytest.mark.parametrize("per_task, spread", [(100_000, 1), (60, 12), (25, 40)])
def test_circles_cut_by_partitions_and_all_paths(spark, per_task, spread):
    rows = forest(9)
    tree = {i: (root, depth) for i, root, depth in brute(rows)}
    parent = {}
    for i, p in rows:
        if i is not None and p:
            parent[i] = min(p, parent.get(i, p))
    index = lineage.path_index(spark.createDataFrame(rows, "id string, parent string"), "id", "parent", ["id"], per_task, spread)
    broken = {r["id"]: (r["segment"], r["above"]) for r in index.where("place < 0").collect()}
    assert broken == {i: (root, None) for i, (root, d) in tree.items() if d < 0}
    want = {}
    for i, (root, d) in tree.items():
        if d > 0:
            p = [i]
            while len(p) < d:
                p.insert(0, parent[p[0]])
            want[i] = p
    assert {r["id"]: r["path"] for r in lineage.all_paths(index).collect()} == want


@pytest.mark.parametrize("per_task, spread", [(100_000, 1), (60, 12), (25, 40)])
def test_intervals_hold_the_descendants(spark, per_task, spread):
    rows = forest(9)
    tree = {i: (root, depth) for i, root, depth in brute(rows)}
    parent = {}
    for i, p in rows:
        if i is not None and p:
            parent[i] = min(p, parent.get(i, p))
    got = {r["id"]: (r["root"], r["first"], r["last"]) for r in lineage.intervals(spark.createDataFrame(rows, "id string, parent string"), "id", "parent", ["id"], per_task, spread).collect()}
    assert {i: v[0] for i, v in got.items()} == {i: r for i, (r, _) in tree.items()}
    below = {i: set() for i, (_, d) in tree.items() if d > 0}
    for i in below:
        x = i
        while tree[x][1] > 1:
            x = parent[x]
            below[x].add(i)
    assert {i for i, v in got.items() if v[1] is None} == set(tree) - set(below)
    for i in below:
        root, lo, hi = got[i]
        assert {x for x, (r, n, _) in got.items() if n is not None and r == root and lo < n <= hi} == below[i]


def test_the_path_of_a_deep_chain_takes_few_jobs(spark):
    n = 50_000
    chain = spark.range(n).selectExpr("lpad(id, 8, '0') as id", "case when id > 0 then lpad(id - 1, 8, '0') end as parent")
    index, _ = runtime.Scratch(spark, "test").write(lineage.path_index(chain, "id", "parent", ["id"], spread=12))
    spark.sparkContext.setJobGroup("deep", "deep")
    got = lineage.paths(index, spark.createDataFrame([(f"{n - 1:08d}",), ("none",)], "id string")).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("deep"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 1 and got[0]["path"] == [f"{k:08d}" for k in range(n)] and 0 < jobs < 100

import random

import pytest

from factloom.operators import changefeed, skew

SCHEMA = "k string, wall bigint, id string, op string, x string, y bigint, _seq int"


def brute(rows, key=0):
    state, seen = {}, set()
    for k, w, i, op, x, y, _ in sorted((r for r in rows if r[0] is not None and r[3] in ("set", "delete")), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        if (k, w, i) in seen:
            continue
        seen.add((k, w, i))
        if op == "delete":
            state.pop(k, None)
        else:
            old = state.get(k, (None, None))
            state[k] = (x if x is not None else old[0], y if y is not None else old[1])
    return {(k, *v) for k, v in state.items()}


def rows_of(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = "hot" if rng.random() < 0.35 else f"k{rng.randrange(30)}"
        rows.append((k, rng.randrange(50), f"{i:04d}", rng.choice(["set", "set", "set", "delete"]), rng.choice([None, "a", "b", ""]), rng.choice([None, 1, 2]), 7))
    rows += rng.sample(rows, 60) + [(None, 1, "z", "set", "q", 1, 7), ("odd", 1, "z", "upsert", "q", 1, 7), ("nul", None, "a", "set", "q", None, 7), ("nul", 0, "b", "set", None, 4, 7)]
    rng.shuffle(rows)
    return rows


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {tuple(r) for r in changefeed.replay_changes(df, "k", ["wall", "id"], "op", ["x", "y"]).select("k", "x", "y").collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_partial_updates_in_any_order(spark, seed):
    rows = rows_of(seed)
    assert run(spark, rows) == brute(rows)


def test_hot_key_is_salted(spark, monkeypatch):
    monkeypatch.setattr(changefeed, "hot_keys", lambda df, key: skew.hot_keys(df, key, 0.1, 10))
    rows = rows_of(4)
    assert run(spark, rows) == brute(rows)


def test_states_merge_in_any_grouping(spark):
    rows = rows_of(5)
    parts = [rows[:150], rows[150:300], rows[300:]]
    states = None
    for p in (parts[2], parts[0], parts[1], parts[0]):
        s = changefeed.replay_states(spark.createDataFrame(p, SCHEMA), "k", ["wall", "id"], "op", ["x", "y"])
        states = s if states is None else changefeed.merge_states(states.unionByName(s), "k", ["x", "y"])
    assert {tuple(r) for r in changefeed.current_rows(states, "k", ["x", "y"]).collect()} == brute(rows)


def test_empty(spark):
    assert run(spark, []) == set()


def test_log(spark):
    tx = [
        ("t1", "p", [5, 0], "promote", '{"decision":{"key":"k1"}}'), ("t2", "p", [6, 0], "retract", '{"keys": ["k1", "k2"]}'), ("t3", "q", [6, 0], "promote", '{ "decision" : {"key" : "k1"} }'),
        ("t4", "p", [1, 0], "promote", '{"decision":{"key":"k2"}}'), ("t3", "q", [6, 0], "promote", '{ "decision" : {"key" : "k1"} }'), (None, "p", [9, 0], "retract", '{"keys":["k1"]}'), ("t5", "p", [9, 0], "retract", "no json"),
    ]
    df = spark.createDataFrame(tx, "id string, portal string, hlc array<bigint>, kind string, payload string")
    assert [tuple(r) for r in changefeed.settled_keys(df).collect()] == [("k1", "t3")]


def test_changes_of_one_sequence_do_not_depend_on_their_order(spark):
    rows = [("k", 5, "set", "x1"), ("k", 5, "set", "x2"), ("d", 7, "set", "y"), ("d", 7, "delete", None), ("d", 3, "set", "z")]
    schema = "k string, w bigint, op string, x string"
    for order in (rows, rows[::-1]):
        got = changefeed.replay_changes(spark.createDataFrame(order, schema), "k", ["w"], "op", ["x"]).collect()
        assert [tuple(r) for r in got] == [("k", "x2")]
        parts = [changefeed.replay_states(spark.createDataFrame([r], schema), "k", ["w"], "op", ["x"]) for r in order]
        merged = parts[0]
        for p in parts[1:]:
            merged = merged.unionByName(p)
        merged = changefeed.merge_states(merged, "k", ["x"])
        assert [tuple(r) for r in changefeed.current_rows(merged, "k", ["x"]).collect()] == [("k", "x2")]


def test_promotes_change_the_columns_that_they_have(spark):
    rows = [("t1", "promote", [1, 0], '{"decision":{"key":"k","support":2,"rule":"auto"}}'), ("t2", "promote", [3, 0], '{"decision":{"key":"k","support":5}}'), ("t2", "promote", [3, 0], '{"decision":{"key":"k","support":5}}'), ("t3", "promote", [1, 0], '{"decision":{"key":"g","support":1,"rule":"auto"}}'), ("t4", "retract", [2, 0], '{"keys":["g"]}'), ("t5", "promote", [4, 0], '{"decision":{"key":"g"}}')]
    tx = spark.createDataFrame([(i, "p", k, h, p) for i, k, h, p in rows], "id string, portal string, kind string, hlc array<bigint>, payload string")
    assert sorted(tuple(r) for r in changefeed.settled_decisions(tx).collect()) == [("g", "t5", None, None), ("k", "t2", 5, "auto")]

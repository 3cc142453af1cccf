import random

from pyspark.sql import functions as F

from factloom.operators import bulk, changefeed, feed, latedata
from factloom.streaming import bulkrun, views
from factloom.streaming.tables import Deltas


def in_files(spark, rows, schema, path, n):
    for k in range(n):
        spark.createDataFrame(rows[len(rows) * k // n : len(rows) * (k + 1) // n], schema).coalesce(1).write.mode("append").parquet(str(path))
    return views.log_stream(spark, str(path), spark.createDataFrame([], schema).schema)


def run(writer, path):
    q = writer.option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_changes_applied_batch_by_batch(spark, tmp_path):
    rng = random.Random(1)
    schema = "k string, w bigint, op string, x string"
    rows = [(f"k{rng.randrange(6)}", rng.randrange(1000), rng.choice(["set", "set", "delete"]), rng.choice(["a", "b", None])) for _ in range(60)]
    rows = list({(k, w): (k, w, o, x) for k, w, o, x in rows}.values())
    rows += rows[:9]
    rng.shuffle(rows)
    stream = in_files(spark, rows, schema, tmp_path / "in", 3)
    state = views.change_table(spark, f"file://{tmp_path}/state", "k", ["x"], compact=2)
    run(views.apply_changes(stream, "k", ["w"], "op", ["x"], state), tmp_path / "cp")
    want = changefeed.replay_changes(spark.createDataFrame(rows, schema), "k", ["w"], "op", ["x"])
    got = changefeed.current_rows(state.read(), "k", ["x"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert state.parts() == [(0, 1), (2, 2)]
    part = spark.read.parquet(f"file://{tmp_path}/state/part.2-2")
    state.write(2, spark.createDataFrame(part.collect(), part.schema))  # a batch that runs again
    again = changefeed.current_rows(state.read(), "k", ["x"])
    assert sorted(map(str, again.collect())) == sorted(map(str, want.collect()))


def test_late_counts_batch_by_batch(spark, tmp_path):
    rng = random.Random(3)
    schema = "id string, k string, s bigint, w bigint"
    rows = [(f"i{n}", rng.choice("ab"), n, n + rng.randrange(-60, 5)) for n in range(90)]
    rows += [(i, k, 90 + n, w) for n, (i, k, s, w) in enumerate(rows[:20])]
    stream = in_files(spark, rows, schema, tmp_path / "in", 3)
    t = views.LateCounts(spark, f"file://{tmp_path}/out", compact=2)
    run(views.late_counts(stream, "id", "k", "s", F.col("w"), t, 20, 10), tmp_path / "cp")
    fine, late = latedata.split_late(spark.createDataFrame(rows, schema), "id", "k", "s", F.col("w"), 20)
    assert sorted(r["id"] for r in t.late.read().collect()) == sorted(r["id"] for r in late.collect()) != []
    key = lambda df: sorted((r["key"], r["period"], r["n"]) for r in df.collect())
    assert key(t.counts.read()) == key(latedata.period_counts(fine, 10))


def test_keyed_state_counts_periods(spark, tmp_path):
    rng = random.Random(4)
    schema = "id string, key string, seq bigint, wall bigint"
    rows = [(f"i{n}", rng.choice("ab"), n, n + rng.randrange(-60, 5)) for n in range(90)]
    stream = in_files(spark, rows, schema, tmp_path / "in", 3)
    out = Deltas(spark, f"file://{tmp_path}/out")
    run(views.tallies(stream, "key", 20, 10).writeStream.outputMode("update").foreachBatch(lambda df, n: out.write(n, df.withColumn("batch", F.lit(n)))), tmp_path / "cp")
    fine, late = latedata.split_late(spark.createDataFrame(rows, schema), "id", "key", "seq", F.col("wall"), 20)
    got = out.read()
    assert sorted(r["id"] for r in got.where("late").collect()) == sorted(r["id"] for r in late.collect()) != []
    last = {(r["key"], r["period"]): r["n"] for r in got.where("not late").groupBy("key", "period").agg(F.max_by("n", "batch").alias("n")).collect()}
    assert last == {(r["key"], r["period"]): r["n"] for r in latedata.period_counts(fine, 10).collect()}


def test_parts_merge_generation_by_generation(spark, tmp_path):
    t = Deltas(spark, f"file://{tmp_path}/t", compact=3)
    for n in range(12):
        t.write(n, spark.createDataFrame([(n,)], "n int").coalesce(1))
        assert sorted(r["n"] for r in t.read().collect()) == list(range(n + 1))
        assert n == 0 or sorted(r["n"] for r in t.read(n).collect()) == list(range(n))
    assert t.parts() == [(0, 8), (9, 9), (10, 10), (11, 11)]


def test_last_writer_and_repeated_rows(spark, tmp_path):
    schema = "id string, k string, w bigint, v string"
    rows = [("1", "a", 5, "x"), ("2", "a", 9, "y"), ("2", "a", 9, "y"), ("3", "a", 7, "z"), ("4", "b", 1, "q")]
    stream = in_files(spark, rows, schema, tmp_path / "in", 3)
    q = views.last_writers(stream, "k", F.struct("w", "id"), F.col("v")).writeStream.outputMode("complete").format("memory").queryName("lww").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("lww").collect()} == {("a", "y"), ("b", "q")}
    q = views.once_each(stream).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 4
    timed = views.once_each(stream, time=F.timestamp_millis("w"), within="1 day")
    q = timed.writeStream.format("memory").queryName("within").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("within").count() == 4 and spark.table("within").columns == ["id", "k", "w", "v"]


def test_leases_close_or_expire(spark, tmp_path):
    schema = "directive string, kind string, wall bigint, expires bigint"
    rows = [("a", "directive", 1000, 5000), ("b", "directive", 1000, 5000), ("a", "assert", 3000, None), ("c", "directive", 2000, 4000), ("c", "assert", 4500, None), ("z", "directive", 90_000, 99_000), ("y", "directive", 95_000, 99_000), ("y2", "directive", 96_000, 99_000)]
    stream = in_files(spark, rows, schema, tmp_path / "in", 4)
    q = views.leases(stream).writeStream.format("memory").queryName("leases").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["directive"], r["state"]) for r in spark.table("leases").collect()} == {("a", "closed"), ("b", "expired"), ("c", "late")}


def test_bulk_run_pauses_and_goes_on(spark, tmp_path):
    schema = "id string, hash string, name string, text string"
    rows = [(f"s{n}", f"h{n}", "n", "bad" if n in (3, 4, 5) else "good") for n in range(8)]
    stream = in_files(spark, rows, schema, tmp_path / "in", 8)
    steps = Deltas(spark, f"file://{tmp_path}/steps")
    work = lambda df: df.select("id", F.when(F.col("text") == "bad", "failed").otherwise("extracted").alias("outcome"), F.lit(2).alias("kept"), F.lit(1).alias("refused"))
    skip = spark.createDataFrame([("s1", "h1")], "source string, hash string").withColumnRenamed("hash", "h").withColumnRenamed("h", "hash")
    control, why = bulkrun.Control(spark, f"file://{tmp_path}/control"), []

    def go():
        q = bulkrun.start(stream, work, steps, str(tmp_path / "cp"), skip, may_run=lambda: why[0] if why else None, control=control)
        try:
            q.awaitTermination(120)
        except Exception as e:  # noqa: BLE001
            return str(e)
        return ""

    why.append("paused by the steward")
    assert "paused by the steward" in go() and bulkrun.status(steps) is None
    why.clear()
    assert "in a row" in go()  # and what was not read before is read first
    t = bulk.totals(steps.read()).first()
    assert (t["skipped"], t["failed"]) == (1, 3) and t["kept"] == 2 * t["extracted"]
    assert go() == ""  # restored from its checkpoint, with failures counted anew
    assert tuple(bulkrun.status(steps).first())[:3] == (4, 1, 3)
    control.cancel()
    spark.createDataFrame([("s9", "h9", "n", "good")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert "cancelled" in go() and tuple(bulkrun.status(steps).first())[:3] == (4, 1, 3)
    left = spark.createDataFrame([("b",), ("a",), ("c",)], "id string")
    done = spark.createDataFrame([("a",)], "id string")
    assert [r["id"] for r in bulk.next_source(left, done, "id").collect()] == ["b"]
    assert [r["id"] for r in bulk.next_source(left, left, "id", 4).collect()] == ["b"] and tuple(bulk.done_count(left, done).first()) == (3, 1)


def test_bulk_totals_and_feeds(spark):
    rows = [("r", 1, "failed"), ("r", 2, "failed"), ("r", 3, "skipped"), ("r", 4, "failed"), ("r", 5, "extracted"), ("r", 6, "failed"), ("q", 1, "failed")]
    steps = spark.createDataFrame(rows, "run string, i bigint, outcome string").withColumns({"kept": F.lit(3), "refused": F.lit(1)})
    assert [r["fails"] for r in bulk.failure_runs(steps, "run", "i").orderBy("run", "i").collect()] == [1, 1, 2, 2, 3, 0, 1]
    assert [tuple(r) for r in bulk.pauses(steps, "run", "i").collect()] == [("r", 4)]
    assert bulk.progress(3, 1, 2, 7) == 0.5 and bulk.progress(9, 0, 0, 7) == 1.0 and bulk.progress(0, 0, 0, 0) == 0.0
    ev = spark.createDataFrame([(n, s) for n, s in enumerate(["passage", "promote", "error", "bulk"])], "seq bigint, step string")
    assert feed.since(ev, "seq", 1).count() == 2 and feed.last(ev, "seq", 2).count() == 2 and feed.work_steps(ev).count() == 2
    shown = "step string, ok boolean, event string, kept boolean, more bigint, accepted bigint, rejected bigint"
    rows = [
        ("refuse", None, None, None, None, None, None), ("verify", True, None, None, None, None, None), ("verify", False, None, None, None, None, None), ("fact", None, None, True, None, None, None), ("fact", None, None, False, None, None, None),
        ("fact", None, None, None, 3, None, None), ("check", None, None, None, None, 0, 2), ("check", None, None, None, None, 1, 2), ("check", None, None, None, None, 0, 0), ("promote", None, None, None, None, None, None),
        ("bulk", None, "done", None, None, None, None), ("bulk", None, "step", None, None, None, None), ("sign", None, None, None, None, None, None),
    ]
    trace = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "seq bigint, " + shown)
    got = {r["seq"]: (r["tone"], r["alarm"], r["nth"]) for r in feed.activity(trace, "seq").collect()}
    assert [got[n][0] for n in range(12)] == ["bad", None, "bad", "good", "bad", None, "bad", "good", "good", "good", "good", None] and 12 not in got
    assert got[0][1:] == (True, 1) and got[11][1:] == (False, 12) and len(feed.activity(trace, "seq", keep=3).collect()) == 3
    assert [r["seq"] for r in feed.backlog(trace, "seq", 2, keep=2).collect()] == [12, 11]
    facts = spark.createDataFrame([("d", i, f"l{i}", None if i % 2 else "no") for i in range(5)], "run string, i bigint, line string, reason string")
    notes = feed.fact_notes(facts, "run", "i", noted=3).orderBy("i").collect()
    assert [(r["line"], r["kept"], r["more"]) for r in notes] == [("l0", False, None), ("l1", True, None), ("l2", False, None), (None, None, 2)]
    r = spark.createDataFrame([("AVX = 1 | NEON = 0 | FMA = 1", 10, 0)], "f string, n int, ms int").select(feed.features(F.col("f")).alias("f"), feed.rate(F.col("n"), F.col("ms")).alias("r")).first()
    assert r["f"] == ["AVX", "FMA"] and r["r"] is None

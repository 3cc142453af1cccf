"""Bulk runs over many sources: what is left to do, totals, and runs of failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_FAILS_IN_A_ROW, KEEP_ERRORS = 3, 20


def queue(listed: DataFrame, done: DataFrame, by: list[str], skip_extracted: bool = True) -> DataFrame:
    """Sources to read: all that are listed, without those whose present content (the columns ``by``) has a result."""
    return listed.join(done.select(*by), by, "left_anti") if skip_extracted else listed


def totals(steps: DataFrame) -> DataFrame:
    """One row: sources extracted, skipped and failed, and facts kept and refused, of steps (outcome, kept, refused)."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    s = lambda c: F.coalesce(F.sum(F.when(F.col("outcome") == "extracted", F.col(c))), F.lit(0)).cast("bigint")
    return steps.agg(n("extracted").alias("extracted"), n("skipped").alias("skipped"), n("failed").alias("failed"), s("kept").alias("kept"), s("refused").alias("refused"))


def failure_runs(steps: DataFrame, run: str, order: str) -> DataFrame:
    """Steps with ``fails``: failures in a row up to each step. A success ends a row of them; a skip does not."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    island = F.sum(F.when(F.col("outcome") == "extracted", 1).otherwise(0)).over(w)
    x = steps.withColumn("_island", island)
    inside = Window.partitionBy(run, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return x.withColumn("fails", F.sum(F.when(F.col("outcome") == "failed", 1).otherwise(0)).over(inside).cast("bigint")).drop("_island")


def pauses(steps: DataFrame, run: str, order: str, most: int = MAX_FAILS_IN_A_ROW) -> DataFrame:
    """(run, at): the first step of each run at which it pauses by itself."""
    return failure_runs(steps, run, order).where(F.col("fails") >= most).groupBy(run).agg(F.min(order).alias("at"))


def progress(next_: int, passage: int, passages: int, total: int) -> float:
    """The share of a run that is done, at most 1."""
    return min(1.0, (next_ + (passage / passages if passages else 0)) / total) if total else 0.0


def next_source(listed: DataFrame, done: DataFrame, order: str, turn: int = 0) -> DataFrame:
    """The source to read next: the first (by ``order``) without a result, else in turn the one at place ``turn`` of all."""
    left = listed.join(done.select("id").distinct(), "id", "left_anti")
    first = left.orderBy(order).limit(1)
    n = listed.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 0)
    place = F.row_number().over(Window.orderBy(order)) - 1
    again = listed.orderBy(order).limit(turn + 1).withColumn("_k", place).join(F.broadcast(n)).where(F.col("_k") == F.pmod(F.lit(turn), F.col("_n"))).drop("_k", "_n")
    none_left = left.agg(F.count(F.lit(1)).alias("_left")).where("_left = 0").select(F.lit(1).alias("_none"))
    return first.unionByName(again.join(F.broadcast(none_left)).drop("_none"))


def done_count(listed: DataFrame, done: DataFrame) -> DataFrame:
    """One row: sources listed, and those of them with a result for their present content."""
    d = done.select("id").distinct().withColumn("_d", F.lit(True))
    return listed.join(d, "id", "left").agg(F.count(F.lit(1)).alias("listed"), F.count_if(F.col("_d")).alias("done"))

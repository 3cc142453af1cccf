"""The feed of trace events: cursors, the last events kept, and what an activity list shows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRACE_KEEP, ACTIVITY_KEEP, BACKLOG = 400, 150, 200
NOTED = 24
# The steps that mean work, and those that the activity list shows.
WORK = ("passage", "passage-done", "bulk", "model")
SHOWN = ("scan", "read", "passage", "passage-done", "fact", "check", "refuse", "promote", "hold", "bulk", "model", "recall", "verify")


def since(events: DataFrame, seq: str, cursor: int) -> DataFrame:
    return events.where(F.col(seq) > cursor)


def backlog(events: DataFrame, seq: str, cursor: int, keep: int = BACKLOG) -> DataFrame:
    """Of what came after a cursor the newest, as a reader that fell behind takes it."""
    return last(since(events, seq, cursor), seq, keep)


def last(events: DataFrame, seq: str, keep: int = TRACE_KEEP) -> DataFrame:
    """The newest events: a top-k, not a sort of all."""
    return events.orderBy(F.desc(seq)).limit(keep)


def work_steps(events: DataFrame, step: str = "step") -> DataFrame:
    return events.where(F.col(step).isin(*WORK))


def tone(step: Column, ok: Column, event: Column, kept: Column, more: Column, accepted: Column, rejected: Column) -> Column:
    """How an event of the activity list reads: good, bad, or null. Details that an event lacks are null."""
    no = lambda c: ~F.coalesce(c.cast("boolean"), F.lit(False))
    fact = F.when(no(more), F.when(no(kept), "bad").otherwise("good"))
    check = F.when((F.coalesce(rejected, F.lit(0)) > 0) & no(accepted), "bad").otherwise("good")
    return (
        F.when((step == "refuse") | ((step == "verify") & no(ok)), "bad").when(step == "fact", fact).when(step == "check", check)
        .when((step == "promote") | ((step == "bulk") & F.coalesce(event == "done", F.lit(False))), "good")
    )


def activity(events: DataFrame, seq: str, step: str = "step", keep: int = ACTIVITY_KEEP) -> DataFrame:
    """The newest shown events: (the columns of ``events``, tone, alarm, nth), nth the running count of shown events.

    Details (ok, event, kept, more, accepted, rejected) are read where ``events`` has them.
    """
    have = lambda c: F.col(c) if c in events.columns else F.lit(None)
    shown = events.where(F.col(step).isin(*SHOWN))
    said = tone(F.col(step), have("ok"), have("event"), have("kept"), have("more"), have("accepted"), have("rejected"))
    newest = last(shown.withColumns({"tone": said, "alarm": F.col(step) == "refuse"}), seq, keep)
    total = shown.agg(F.count(F.lit(1)).alias("_all"))
    back = F.row_number().over(Window.orderBy(F.desc(seq)))
    return newest.withColumn("_back", back).join(F.broadcast(total)).withColumn("nth", F.col("_all") - F.col("_back") + 1).drop("_all", "_back")


def fact_notes(admitted: DataFrame, run: str, order: str, noted: int = NOTED) -> DataFrame:
    """(run, order, line, kept, reason) of the first facts that a run checked, and one row (line null, more) for those beyond.

    ``admitted``: (run, order, line, reason), reason null where a fact was kept.
    """
    n = F.row_number().over(Window.partitionBy(run).orderBy(order))
    x = admitted.select(run, order, "line", "reason").withColumn("_n", n)
    first = x.where(F.col("_n") <= noted).select(run, order, "line", F.col("reason").isNull().alias("kept"), "reason", F.lit(None).cast("bigint").alias("more"))
    size = admitted.groupBy(run).agg(F.count(F.lit(1)).alias("k"), F.max(order).alias(order)).where(F.col("k") > noted)
    return first.unionByName(size.select(run, order, F.lit(None).cast("string").alias("line"), F.lit(None).cast("boolean").alias("kept"), F.lit(None).cast("string").alias("reason"), (F.col("k") - noted).alias("more")))


def rate(tokens, ms):
    """Tokens a second, or null where no time passed."""
    return F.try_divide(tokens, ms / F.lit(1000.0))


def features(c):
    """The names of a ``name = 1 | name = 0`` list that are on."""
    parts = F.transform(F.split(c, r"\|"), lambda x: F.trim(x))
    return F.transform(F.filter(parts, lambda x: x.endswith(" = 1")), lambda x: F.regexp_replace(x, " = 1$", ""))

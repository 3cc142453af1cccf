"""A bulk run as a stream: sources are read in order, batch by batch, and a checkpoint holds how far it came.

Stopping the query pauses the run; starting it again with the same checkpoint goes
on after the last complete batch. A run pauses itself after too many failures in a
row, and when the steward pauses the arbiters or the portal is frozen; what it was
about to read is then read after it is resumed. A cancelled run reads nothing more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import bulk
from factloom.runtime import _path
from factloom.streaming.tables import Deltas


class Paused(RuntimeError):
    """The run paused itself: too many sources failed in a row, or it may not go on now."""


class Cancelled(RuntimeError):
    """The run was cancelled."""


class Control:
    """The state of a run beside its checkpoint: whether it was cancelled, and from which step on failures count."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _has(self, name: str) -> bool:
        path, fs = _path(self.spark, f"{self.root}/{name}")
        return fs.exists(path)

    def cancel(self) -> None:
        path, fs = _path(self.spark, f"{self.root}/cancelled")
        fs.create(path, True).close()

    def cancelled(self) -> bool:
        return self._has("cancelled")

    def resumed(self, step: int) -> None:
        """Failures before this step count no more: the run was resumed after them."""
        path, fs = _path(self.spark, f"{self.root}/resumed-{step:012d}")
        fs.create(path, True).close()

    def counts_from(self) -> int:
        path, fs = _path(self.spark, self.root)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return max((int(n.rpartition("-")[2]) for n in names if n.startswith("resumed-")), default=0)


def status(steps: Deltas) -> DataFrame | None:
    """What a run did so far, as ``bulk.totals``; None before its first step."""
    done = steps.read()
    return None if done is None else bulk.totals(done)


def start(
    stream: DataFrame, extract: Callable[[DataFrame], DataFrame], steps: Deltas, checkpoint: str, skip: DataFrame | None = None, most_fails: int = bulk.MAX_FAILS_IN_A_ROW,
    may_run: Callable[[], str | None] | None = None, control: Control | None = None,
):
    """Run ``extract`` (sources -> (id, outcome, kept, refused)) on each batch of sources (id, hash, name, text).

    ``skip`` (source, hash): sources already extracted with that content. Ends by
    ``Paused`` when the last ``most_fails`` sources failed, or where ``may_run`` gives
    a reason not to go on (paused by the steward, frozen); it is asked before each
    batch, which is then read when the run is started again. Ends by ``Cancelled``
    once ``control`` says so.
    """

    def batch(df: DataFrame, n: int) -> None:
        if control is not None and control.cancelled():
            raise Cancelled("the run was cancelled")
        if may_run is not None and (why := may_run()):
            raise Paused(why)
        todo = df
        skipped = df.sparkSession.createDataFrame([], "id string, outcome string, kept bigint, refused bigint")
        if skip is not None:
            on = (F.col("id") == F.col("source")) & (df["hash"] == skip["hash"])
            todo = df.join(skip, on, "left_anti")
            skipped = df.join(skip, on, "left_semi").select("id", F.lit("skipped").alias("outcome"), F.lit(0).cast("bigint").alias("kept"), F.lit(0).cast("bigint").alias("refused"))
        done = extract(todo).select("id", "outcome", F.col("kept").cast("bigint"), F.col("refused").cast("bigint")).unionByName(skipped)
        done = done.withColumns({"i": F.concat_ws("/", F.lpad(F.lit(str(n)), 12, "0"), "id"), "batch": F.lit(n).cast("bigint")})
        steps.write(n, done)
        since = control.counts_from() if control is not None else 0
        last = steps.read(n + 1).where((F.col("outcome") != "skipped") & (F.col("batch") >= since)).orderBy(F.desc("i")).limit(most_fails).collect()
        if len(last) == most_fails and all(r["outcome"] == "failed" for r in last):
            if control is not None:
                control.resumed(n + 1)  # the next start is a resume, and counts anew
            raise Paused(f"{most_fails} sources failed in a row; the last: {last[0]['id']}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

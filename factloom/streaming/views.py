"""Views of the log that follow it as it grows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.operators import changefeed, latedata
from factloom.streaming.tables import Deltas


def log_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """The log's folder as an unbounded table."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def last_writers(stream: DataFrame, key: str, at: Column, value: Column) -> DataFrame:
    """(key, value): the value of the latest replay key, whatever the order of arrival. For update or complete mode."""
    return stream.groupBy(F.col(key)).agg(F.max_by(value, at).alias("value"))


def once_each(stream: DataFrame, id: str = "id", time: Column | None = None, within: str = "7 days") -> DataFrame:
    """Repeated deliveries dropped.

    With ``time`` (event time), repetitions within so long are dropped, and the state
    ends with the watermark; without it every id is kept for as long as the query lives.
    """
    if time is None:
        return stream.dropDuplicates([id])
    return stream.withColumn("_time", time).withWatermark("_time", within).dropDuplicatesWithinWatermark([id]).drop("_time")


def change_table(spark: SparkSession, root: str, key: str, columns: list[str], compact: int = 16) -> Deltas:
    """The registers of a changed table; ``changefeed.current_rows`` reads them as rows."""
    return Deltas(spark, root, lambda parts: changefeed.merge_states(parts, key, columns), compact)


def apply_changes(stream: DataFrame, key: str, sequence: list, op: Column | str, columns: list[str], state: Deltas) -> DataStreamWriter:
    """Keep the registers of a changed table in ``state`` (``change_table``).

    Each batch is replayed by itself; its registers merge with those of all others
    to the same as a replay of everything, in any order and with repetitions.
    """
    return stream.writeStream.foreachBatch(lambda df, n: state.write(n, changefeed.replay_states(df, key, sequence, op, columns)))


class LateCounts:
    """Where ``late_counts`` keeps its counts, watermarks, the ids counted and the rows dropped."""

    def __init__(self, spark: SparkSession, root: str, compact: int = 16):
        total = lambda by, agg: lambda parts: parts.groupBy(*by).agg(agg)
        self.counts = Deltas(spark, f"{root}/counts", total(["key", "period"], F.sum("n").alias("n")), compact)
        self.marks = Deltas(spark, f"{root}/marks", total(["key"], F.max("wall").alias("wall")), compact)
        self.seen, self.late = Deltas(spark, f"{root}/seen", compact=compact, by="period"), Deltas(spark, f"{root}/late", compact=compact)


#: Periods of one batch up to which the ids seen are read period by period.
MOST_PERIODS = 10_000


def late_counts(stream: DataFrame, id: str, key: str, arrival: str, event_time: Column, tables: LateCounts, allowed_ms: int = latedata.ALLOWED_MS, period_ms: int = latedata.HOUR_MS) -> DataStreamWriter:
    """Counts per key and period, corrected by late rows; rows beyond the cut-off are diverted.

    Batches come in the order of ``arrival``. Copies of a row have its event time, so
    a batch is held against the ids of its own periods only, which are laid out by
    period: its cost follows the batch, however long the stream has run.
    """

    def batch(df: DataFrame, n: int) -> None:
        own = (F.floor(F.col("wall") / F.lit(period_ms)) * F.lit(period_ms)).cast("bigint")
        first = latedata.first_arrivals(df, id, key, arrival, event_time).withColumn("period", own).persist()
        known = tables.seen.read(n)
        new = first
        if known is not None:
            periods = [r["period"] for r in first.select("period").distinct().limit(MOST_PERIODS + 1).collect()]
            if len(periods) <= MOST_PERIODS:
                known = known.where(F.col("period").isin(periods))
            new = first.join(known.select("id"), "id", "left_anti")
        marked = latedata.with_watermark(new, carried=tables.marks.read(n)).persist()
        late = latedata.is_late(allowed_ms)
        tables.counts.write(n, latedata.period_counts(marked.where(~late), period_ms))
        tables.late.write(n, marked.where(late))
        tables.marks.write(n, marked.groupBy("key").agg(F.max("wall").alias("wall")))
        tables.seen.write(n, marked.select("id", own.alias("period")))
        marked.unpersist()
        first.unpersist()

    return stream.writeStream.foreachBatch(batch)


TALLY = "key string, period bigint, n bigint, late boolean, id string"


def _tally(allowed_ms: int, period_ms: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, counts = state.get if state.exists else (None, [])
        count = {int(p): int(n) for p, n in counts}
        touched: set[int] = set()
        late = []
        rows = sorted((int(s), str(i), int(w)) for f in frames for s, i, w in zip(f["seq"], f["id"], f["wall"]))
        for _, i, wall in rows:
            if mark is not None and mark - wall > allowed_ms:
                late.append((key[0], None, None, True, i))
            else:
                p = wall // period_ms * period_ms
                count[p] = count.get(p, 0) + 1
                touched.add(p)
            mark = wall if mark is None else max(mark, wall)
        # a period whose last moment is beyond the cut-off changes no more
        open_ = [(p, n) for p, n in count.items() if mark is None or mark - (p + period_ms - 1) <= allowed_ms]
        state.update((mark, open_))
        yield pd.DataFrame([(key[0], p, count[p], False, None) for p in sorted(touched)] + late, columns=["key", "period", "n", "late", "id"])

    return run


def tallies(stream: DataFrame, key: str = "key", allowed_ms: int = latedata.ALLOWED_MS, period_ms: int = latedata.HOUR_MS) -> DataFrame:
    """Keyed state for counts per period: (key, period, n, late, id) of rows (key, seq, id, wall), each event once.

    The state of a key is its watermark and the counts of the periods that can still
    change, so it is bounded by the lateness allowed. Each batch emits the new count of
    every period it changed, to be upserted (the last of a key and period holds), and a
    row with ``late`` for every event beyond the cut-off. Rows of one key come in the
    order of ``seq`` from batch to batch.
    """
    return stream.groupBy(key).applyInPandasWithState(_tally(allowed_ms, period_ms), TALLY, "mark long, counts array<struct<period:bigint,n:bigint>>", "update", GroupStateTimeout.NoTimeout)


LEASE = "directive string, state string, at timestamp"


def _lease(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    expires, closed = state.get if state.exists else (None, None)
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({"directive": [key[0]], "state": ["expired"], "at": [pd.Timestamp(expires, unit="ms")]})
        return
    for f in frames:
        for kind, wall, ends in sorted(zip(f["kind"], f["wall"], f["expires"]), key=lambda x: x[1]):
            if kind == "directive":
                expires = int(ends)
            elif closed is None or wall < closed:
                closed = int(wall)
    if expires is None:  # closed before it is known
        state.update((expires, closed))
        return
    if closed is not None:
        state.remove()
        yield pd.DataFrame({"directive": [key[0]], "state": ["closed" if closed < expires else "late"], "at": [pd.Timestamp(closed, unit="ms")]})
        return
    state.update((expires, closed))
    state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))


def leases(stream: DataFrame, watermark: str = "0 seconds") -> DataFrame:
    """(directive, state, at) of rows (directive, kind, wall, expires): closed in time, closed late, or expired without a result.

    A lease is decided once, by its first close or when event time passes its end.
    """
    timed = stream.withColumn("time", F.timestamp_millis("wall")).withWatermark("time", watermark)
    return timed.groupBy("directive").applyInPandasWithState(_lease, LEASE, "expires long, closed long", "append", GroupStateTimeout.EventTimeTimeout)

"""Event-time counts corrected by late rows, up to a cut-off.

The watermark of a key (a portal) is the highest event time among its rows that
arrived so far; a row more than the allowed lateness below the watermark it meets
is dropped from the counts and reported. This is a running maximum in arrival
order. So that no task takes a whole key, arrivals are cut into blocks: each
block's maximum is carried into the later blocks of its key, and within a block
the maximum runs over its rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALLOWED_MS, HOUR_MS = 7_200_000, 3_600_000
#: Arrival numbers in a block: the most rows of one key that one task orders.
BLOCK = 1 << 17


def first_arrivals(events: DataFrame, id: str, key: str, arrival: str, event_time: Column) -> DataFrame:
    """One row an event: copies arrive at the lowest arrival number among them.

    Rows with a null id, arrival number or event time are no events. Copies that
    differ count as the one that arrived first, the smallest key among equals.
    """
    rows = events.select(F.col(id).cast("string").alias("id"), F.col(key).cast("string").alias("key"), F.col(arrival).cast("bigint").alias("seq"), event_time.cast("bigint").alias("wall"))
    return rows.where("id is not null and seq is not null and wall is not null").groupBy("id").agg(
        F.min(F.struct("seq", "wall", "key")).alias("x")
    ).select("id", "x.key", "x.seq", "x.wall")


def with_watermark(arrivals: DataFrame, block: int = BLOCK, carried: DataFrame | None = None) -> DataFrame:
    """Adds ``mark``: the highest ``wall`` of the same key among rows of a lower ``seq`` (null: none).

    ``carried`` (key, wall): marks from earlier batches. A null key is a key of its own.
    """
    rows = arrivals.withColumn("blk", F.floor(F.col("seq") / F.lit(block)))
    blocks = rows.groupBy("key", "blk").agg(F.max("wall").alias("top"))
    before = Window.partitionBy("key").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("key", "blk", F.max("top").over(before).alias("carry"))
    if carried is not None:
        c = carried.select(F.col("key").alias("ck"), F.col("wall").alias("cw"))
        blocks = blocks.join(c, F.col("key").eqNullSafe(F.col("ck")), "left").select("key", "blk", F.greatest("carry", "cw").alias("carry"))
    inside = Window.partitionBy("key", "blk").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.max("wall").over(inside))
    b = blocks.select(F.col("key").alias("bk"), F.col("blk").alias("bb"), "carry")
    return rows.join(b, F.col("key").eqNullSafe(F.col("bk")) & (F.col("blk") == F.col("bb")), "left").select(
        "id", "key", "seq", "wall", F.greatest("own", "carry").alias("mark")
    )


def is_late(allowed_ms: int = ALLOWED_MS) -> Column:
    return F.coalesce(F.col("mark") - F.col("wall") > F.lit(allowed_ms), F.lit(False))


def split_late(events: DataFrame, id: str, key: str, arrival: str, event_time: Column, allowed_ms: int = ALLOWED_MS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and rows beyond the cut-off; the latter raise the watermark too.

    Equal arrival numbers do not see each other. An empty table gives two empty ones.
    """
    marked = with_watermark(first_arrivals(events, id, key, arrival, event_time), block)
    return marked.where(~is_late(allowed_ms)), marked.where(is_late(allowed_ms))


def period_counts(in_time: DataFrame, period_ms: int = HOUR_MS) -> DataFrame:
    """Events per key and period of event time: (key, period, n); period is its first ms."""
    return in_time.groupBy("key", (F.floor(F.col("wall") / F.lit(period_ms)) * F.lit(period_ms)).cast("bigint").alias("period")).agg(F.count(F.lit(1)).alias("n"))


def tx_split(tx: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    return split_late(tx, "id", "portal", "seq", F.get("hlc", F.lit(0)), block=block)

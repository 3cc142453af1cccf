"""Hot keys: found in one pass with bounded state, and joined without one task taking them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys tracked by the frequent-items sketch, and the most hot keys it may name.
TRACKED, MOST_HOT = 4096, 64
#: A key with more than this share of all rows is hot.
SHARE = 1 / 64


def hot_keys(df: DataFrame, key: str, share: float = SHARE, least: int = 100_000) -> list[str]:
    """Values of ``key`` (a string column) that hold more than ``share`` of the rows, and at least ``least`` rows.

    One pass over all rows with a frequent-items sketch of fixed size; at most 64
    values come back whatever the input. The answer only steers salting: a wrong
    answer costs time and never changes a result.
    """
    row = df.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {MOST_HOT}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")
    ).first()
    if not row or not row["n"]:
        return []
    return [x["item"] for x in row["top"] if x["count"] >= max(least, share * row["n"])]


def is_hot(key: str, hot: list[str]) -> Column:
    return F.coalesce(F.col(key).isin(hot), F.lit(False)) if hot else F.lit(False)


def lookup(df: DataFrame, unique: DataFrame, key: str, hot: list[str], how: str = "left") -> DataFrame:
    """Join ``df`` with ``unique`` (one row a key) where ``hot`` keys hold a large share of ``df``.

    The rows of hot keys meet at most 64 rows of ``unique``, which are broadcast;
    all others are joined by shuffle. Only left and inner joins.
    """
    if not hot:
        return df.join(unique, key, how)
    cold = df.where(~is_hot(key, hot)).join(unique, key, how)
    warm = df.where(is_hot(key, hot)).join(F.broadcast(unique.where(is_hot(key, hot))), key, how)
    return cold.unionByName(warm)

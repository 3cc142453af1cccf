"""Parent-child links to roots, depths and circles.

A weighted disjoint-set forest: within a partition, links are followed and
compressed, which leaves each node with the steps to its exit, the first ancestor
that is not in the partition. Only exits matter to other partitions, so the next
level holds them alone, in fewer and wider partitions, until one task holds what
is left; then roots, depths and circles are handed down again, exit by exit.
Where partitions are cut along the chains (``near``), a level keeps a few links of
each partition. Links without such an order do not shrink; they are then resolved
by doubling the steps that each link spans.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from factloom import runtime
from factloom.operators.skew import hot_keys, lookup

#: Links that one task may hold.
PER_TASK = 250_000
#: Fewer partitions at each level.
NARROW = 8


def _out(spread: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("exit", f.dataType) if f.name == "parent" else T.StructField(f.name, f.dataType) for f in spread.schema])


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follow the links of one partition to their exits.

    In: id, parent, w (steps to the parent), least (smallest id from id up to
    before the parent), top (last node before the parent), and any others, which
    are passed on. Out: the same with exit for parent. In a circle, or below one, exit is null, w is -1 and top is
    the smallest id on the circle.
    """
    ids: list = []
    parent, w, least, top = [], [], [], []
    rest: list[pa.RecordBatch] = []
    for b in batches:
        rest.append(b.select(b.schema.names[5:]))
        ids += b.column(0).to_pylist()
        parent += b.column(1).to_pylist()
        w += b.column(2).to_pylist()
        least += b.column(3).to_pylist()
        top += b.column(4).to_pylist()
    at = {x: i for i, x in enumerate(ids)}
    up = [at.get(p, -1) if p is not None else -1 for p in parent]
    n, done, trail_of = len(ids), bytearray(len(ids)), [-1] * len(ids)
    for start in range(n):
        if done[start]:
            continue
        trail, i = [], start
        while i >= 0 and not done[i] and trail_of[i] != start:
            trail_of[i] = start
            trail.append(i)
            i = up[i]
        if i >= 0 and not done[i]:  # met its own trail: a circle
            loop = trail[trail.index(i):]
            small = min(least[j] for j in loop)
            for j in loop:
                w[j], top[j], parent[j], done[j] = -1, small, None, 1
            trail = trail[: len(trail) - len(loop)]
        for j in reversed(trail):
            k = up[j]
            if k >= 0:
                parent[j], top[j] = parent[k], top[k]
                w[j] = -1 if w[k] < 0 else w[j] + w[k]
                if least[k] < least[j]:
                    least[j] = least[k]
            done[j] = 1
    i = 0
    for b in rest:
        j = slice(i, i + b.num_rows)
        own = [pa.array(x[j], t) for x, t in ((ids, pa.string()), (parent, pa.string()), (w, pa.int64()), (least, pa.string()), (top, pa.string()))]
        yield pa.RecordBatch.from_arrays(own + b.columns, names=["id", "exit", "w", "least", "top", *b.schema.names])
        i += b.num_rows


def _handed_down(local: DataFrame, above: DataFrame, per_task: int) -> DataFrame:
    """(id, root, depth) of a level from those of its exits."""
    hot = hot_keys(local.where("exit is not null"), "exit", least=per_task)
    a = above.select(F.col("id").alias("exit"), F.col("root").alias("r"), F.col("depth").alias("d"))
    j = lookup(local, a, "exit", hot)
    return j.select(
        "id",
        F.when(F.col("w") < 0, F.col("top")).otherwise(F.coalesce("r", "top")).alias("root"),
        F.when(F.col("w") < 0, -1).when(F.col("r").isNull(), F.col("w")).when(F.col("d") < 0, -1).otherwise(F.col("w") + F.col("d")).cast("bigint").alias("depth"),
    )


def _doubled(links: DataFrame, rows: int, scratch: runtime.Scratch) -> DataFrame:
    """(id, root, depth) by doubling: each round a link spans as many steps again."""
    cur, at = scratch.write(links.select("id", F.col("parent").alias("exit"), "w", "least", "top"))
    for _ in range(math.ceil(math.log2(max(2, rows))) + 1):
        nxt = cur.select(F.col("id").alias("exit"), F.col("exit").alias("e2"), F.col("w").alias("w2"), F.col("least").alias("l2"), F.col("top").alias("t2"))
        new, to = scratch.write(
            cur.join(nxt, "exit", "left").select(
                "id", F.when(F.col("w2").isNull(), F.col("exit")).otherwise(F.col("e2")).alias("exit"),
                (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), F.least("least", "l2").alias("least"), F.coalesce("t2", "top").alias("top"),
            )
        )
        scratch.drop(at)
        cur, at = new, to
        if cur.where("exit is not null").join(cur.select(F.col("id").alias("exit")), "exit", "left_semi").isEmpty():
            break
    on = cur.select(F.col("id").alias("exit"), F.col("least").alias("circle"))
    return cur.join(on, "exit", "left").select("id", F.coalesce("circle", "top").alias("root"), F.when(F.col("circle").isNull(), F.col("w")).otherwise(-1).cast("bigint").alias("depth"))


def _solve(links: DataFrame, near: list[str], rows: int, parts: int, scratch: runtime.Scratch, per_task: int) -> DataFrame:
    if parts > 1:
        spread = links.repartitionByRange(parts, *near)
    else:
        spread = links.coalesce(1) if rows <= per_task else links.repartition(1)
    if parts <= 1:
        spread = spread.select("id", "parent", "w", "least", "top")
        return spread.mapInArrow(_compress, _out(spread)).select("id", F.col("top").alias("root"), F.col("w").alias("depth"))
    spread = spread.select("id", "parent", "w", "least", "top", *(c for c in near if c != "id"))
    local, _ = scratch.write(spread.mapInArrow(_compress, _out(spread)))
    exits = local.where("exit is not null").select(F.col("exit").alias("id")).distinct()
    kept, _ = scratch.write(local.where("w > 0").join(exits, "id", "left_semi").withColumnRenamed("exit", "parent"))
    circles = local.where("w < 0").join(exits, "id", "left_semi").select("id", F.col("top").alias("root"), F.lit(-1).cast("bigint").alias("depth"))
    left = kept.count()
    if left == 0:
        above = circles
    else:
        if left <= per_task:
            above = _solve(kept, near, left, 1, scratch, per_task)
        elif left > rows / 2:
            above = _doubled(kept, left, scratch)
        else:
            above = _solve(kept, near, left, max(2, min(parts // NARROW, math.ceil(left / per_task * 2))), scratch, per_task)
        # a kept link whose exit lies in a circle found at this level
        c = circles.select(F.col("id").alias("exit"), F.col("root").alias("cr"))
        above = _under_circles(above, kept, c).unionByName(circles)
    above, _ = scratch.write(above)
    return _handed_down(local, above, per_task)


def _under_circles(above: DataFrame, kept: DataFrame, circles: DataFrame) -> DataFrame:
    """Nodes whose root, seen without the circles, hangs below a circle."""
    tops = kept.select("top", F.col("parent").alias("exit")).distinct().join(circles, "exit").select(F.col("top").alias("root"), "cr").dropDuplicates(["root"])
    return above.join(tops, "root", "left").select(
        "id", F.coalesce("cr", "root").alias("root"), F.when(F.col("cr").isNull(), F.col("depth")).otherwise(-1).cast("bigint").alias("depth")
    )


def parent_links(nodes: DataFrame, id: str, parent: str, near: list[str], per_task: int, spread: int | None) -> tuple[DataFrame, list[str], int, int]:
    """One link a node (id, parent, near columns, w, least, top), the names of the near columns, rows and partitions."""
    marks = [f"near{i}" for i in range(len(near))]
    n = nodes.select(F.col(id).cast("string").alias("id"), F.nullif(F.col(parent).cast("string"), F.lit("")).alias("parent"), *(F.col(c).alias(m) for c, m in zip(near, marks)))
    first = F.min(F.struct(F.col("parent").isNull().alias("no"), "parent", *marks))
    links = n.where("id is not null").groupBy("id").agg(first.alias("x")).select("id", "x.parent", *(f"x.{m}" for m in marks))
    links = links.withColumns({"w": F.lit(1).cast("bigint"), "least": F.col("id"), "top": F.col("id")})
    rows = nodes.count()
    return links, marks, rows, spread or max(runtime.shuffle_partitions(nodes.sparkSession), math.ceil(2 * rows / per_task))


def hierarchy(nodes: DataFrame, id: str, parent: str, near: list[str], per_task: int = PER_TASK, spread: int | None = None) -> DataFrame:
    """(id, root, depth) of every distinct id of a table of parent links.

    A node whose parent is null, empty or not in the table is a root of depth 1.
    Where following parents ends in a circle (a node that is its own parent
    included), root is the smallest id on it and depth -1. Rows with a null id
    are left out; copies of an id that differ count as the one with the smallest
    parent, a missing one last. ``near``: columns along which parent and child
    mostly lie close together; they steer the partitions and never the result.
    """
    links, marks, rows, parts = parent_links(nodes, id, parent, near, per_task, spread)
    return _solve(links, [*marks, "id"], rows, parts, runtime.Scratch(nodes.sparkSession, "hierarchy"), per_task)


NEAR = ["portal", "wall", "counter"]


def tx_links(tx: DataFrame) -> DataFrame:
    return tx.select("id", "prev", "portal", F.get("hlc", F.lit(0)).alias("wall"), F.get("hlc", F.lit(1)).alias("counter"))


def tx_hierarchy(tx: DataFrame, **how) -> DataFrame:
    """Trees of the log: a portal's transactions in the order of their clocks lie close together."""
    return hierarchy(tx_links(tx), "id", "prev", NEAR, **how)

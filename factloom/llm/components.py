"""Pairwise matches consolidated into groups.

Two-dimensional grid: vertices are hashed into blocks, and each pair of blocks is
a cell that holds the edges between them, so a vertex with a third of all edges is
spread over a row and a column of cells. There are as many cells as the cluster has
shuffle tasks, more where a cell would overflow, and fewer only as edges run out. A round runs union-find within every
cell, which leaves each vertex one representative per cell; these are exchanged by
vertex. A vertex that represents nothing is retired below its best representative,
and the remaining edges link representatives only. When no edges are left, the
parents are stable and are handed down round by round, last first.

Representatives are ranked by a hash that changes from round to round, so long
chains shrink by a constant factor a round whatever the order of their ids. A cell
that a hub makes larger than others is worked off in sub-cells of a bounded number of
vertices, each with a forest of its own; a vertex meets its representatives of all
(sub-)cells in the exchange, so these forests merge there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import runtime
from factloom.operators.skew import hot_keys, lookup

#: Edges that a cell may hold on average, and below which a further cell is not worth its task.
CELL_EDGES, LEAST_EDGES = 200_000, 4_000
#: Vertices of one forest in a task's memory.
FOREST = 400_000
MOST_ROUNDS = 200
#: Rows from which a join looks for hot keys.
HOT_FROM = 1_000_000


def _union_find(most: int = FOREST):
    """Edges (u, v, rank of u, rank of v) of one cell -> (v, root): the lowest-ranked vertex joined to v in its sub-cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict = {}
        names: list = []
        rank: list = []
        up: list = []

        def forest() -> Iterator[pa.RecordBatch]:
            for k in range(len(up)):
                i = k
                while up[i] != i:
                    i = up[i]
                while up[k] != i:
                    up[k], k = i, up[k]
            for k in range(0, len(up), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[k : k + 50_000], pa.string()), pa.array([names[i] for i in up[k : k + 50_000]], pa.string())], names=["v", "root"])
            for x in (at, names, rank, up):
                x.clear()

        for b in batches:
            for u, v, ru, rv in zip(*(c.to_pylist() for c in b.columns)):
                i = at.get(u)
                if i is None:
                    i = at[u] = len(up)
                    names.append(u)
                    rank.append((ru, u))
                    up.append(i)
                j = at.get(v)
                if j is None:
                    j = at[v] = len(up)
                    names.append(v)
                    rank.append((rv, v))
                    up.append(j)
                while up[i] != i:
                    up[i] = i = up[up[i]]
                while up[j] != j:
                    up[j] = j = up[up[j]]
                if i != j:
                    if rank[i] < rank[j]:
                        up[j] = i
                    else:
                        up[i] = j
            if len(up) >= most:
                yield from forest()
        yield from forest()

    return run


def _rank(c: str, seed: int) -> Column:
    return F.xxhash64(F.col(c), F.lit(seed))


def blocks_for(edges: int, width: int, cell_edges: int = CELL_EDGES, least: int = LEAST_EDGES) -> int:
    """The blocks of vertices for so many edges: enough for a cell a task, and for no cell to overflow."""
    cells = max(math.ceil(edges / cell_edges), min(width, math.ceil(edges / least)))
    return max(1, math.ceil((math.sqrt(8 * cells + 1) - 1) / 2))


def components(edges: DataFrame, u: str, v: str, cell_edges: int = CELL_EDGES, rows: int | None = None, least: int = LEAST_EDGES, forest: int = FOREST) -> DataFrame:
    """(first, member): the members of each group, its smallest id left out of ``member``.

    Edges count in both directions; edges with a null end, loops and repetitions
    add nothing. An empty table gives an empty one. Ids are compared by bytes.
    ``rows``: given where ``edges`` is a written table, with at most so many rows.
    """
    width = runtime.shuffle_partitions(edges.sparkSession)
    spark = edges.sparkSession
    scratch = runtime.Scratch(spark, "components")
    cur = edges.select(F.col(u).cast("string").alias("u"), F.col(v).cast("string").alias("v")).where("u is not null and v is not null and u <> v")
    where, n = None, rows
    if rows is None:
        cur, where, n = scratch.write_counted(cur)
    retired: list[tuple[DataFrame, int]] = []
    for seed in range(MOST_ROUNDS):
        if n == 0:
            break
        blocks = blocks_for(n, width, cell_edges, least)
        a, b = F.pmod(_rank("u", -1 - seed), F.lit(blocks)), F.pmod(_rank("v", -1 - seed), F.lit(blocks))
        lo, hi = F.least(a, b), F.greatest(a, b)
        cell = (hi * (hi + 1) / 2 + lo).cast("int")
        gridded = cur.select("u", "v", _rank("u", seed).alias("ru"), _rank("v", seed).alias("rv"), cell.alias("cell"))
        gridded = gridded.repartitionById(blocks * (blocks + 1) // 2, F.col("cell")).drop("cell")
        local = gridded.mapInArrow(_union_find(forest), "v string, root string")
        if blocks == 1 and 2 * n <= forest:  # one forest holds all edges that are left
            own, _, k = scratch.write_counted(local.where("v <> root").select("v", F.col("root").alias("up")))
            retired.append((own, k))
            break
        best = F.struct(_rank("root", seed).alias("r"), F.col("root").alias("root"))
        met = local.groupBy("v").agg(F.min(best).alias("best"), F.collect_set("root").alias("roots"))
        met, _, k = scratch.write_counted(met.select("v", F.col("best.root").alias("up"), "roots"))
        retired.append((met.where(~F.array_contains("roots", F.col("v"))).select("v", "up"), k))
        nxt = met.where(F.size("roots") > 1).select("up", F.explode("roots").alias("u")).where("u <> up").select("u", F.col("up").alias("v")).distinct()
        nxt, nxt_at, n = scratch.write_counted(nxt)
        if where:
            scratch.drop(where)
        cur, where = nxt, nxt_at
    else:
        raise RuntimeError(f"components: not stable after {MOST_ROUNDS} rounds")
    if not retired:
        return spark.createDataFrame([], "first string, member string")
    labels, size = retired.pop()
    for own, k in reversed(retired):
        above = labels.select(F.col("v").alias("up"), F.col("up").alias("root"))
        hot = hot_keys(own, "up") if k > HOT_FROM else []
        down = lookup(own, above, "up", hot).select("v", F.coalesce("root", "up").alias("up"))
        labels, _, size = scratch.write_counted(down.unionByName(labels))
    labels = labels.withColumnRenamed("up", "root")
    firsts = labels.groupBy("root").agg(F.min("v").alias("m")).select("root", F.least("m", "root").alias("first"))
    if size > HOT_FROM:
        firsts, _ = scratch.write(firsts)
    members = lookup(labels, firsts, "root", hot_keys(labels, "root") if size > HOT_FROM else []).select("first", F.col("v").alias("member"))
    return members.unionByName(firsts.select("first", F.col("root").alias("member"))).where("first <> member")

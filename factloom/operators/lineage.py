"""Paths and descendants of hierarchies, over the partition-local forests that ``hierarchy`` compresses.

Paths are kept as segments (``path_index``). A segment is the part of a tree that one
partition holds below one top; ``above`` is the node that it hangs from. From a node,
the path runs through its segment up to the top, then on from ``above``. ``all_paths``
spells every path, which in a chain of n nodes is n * n / 2 ids; ``paths`` spells
those asked for, climbing segment by segment.

Descendants are counted bottom-up: sizes within segments, then the sizes of whole
segments up the tree of segments, which is the same problem on fewer nodes, then
within segments again with what hangs from each node. ``intervals`` numbers the nodes
so that the descendants of each are one range of numbers: all of them, in linear space.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom import runtime
from factloom.operators.hierarchy import PER_TASK, _compress, _out, _solve, parent_links


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, parent, w: local distance to the exit, weight) of one partition -> (id, total): weights of its local subtree."""
    ids: list = []
    parent, w, weight = [], [], []
    for b in batches:
        for own, c in zip((ids, parent, w, weight), b.columns):
            own += c.to_pylist()
    at = {x: i for i, x in enumerate(ids)}
    for i in sorted((i for i in range(len(ids)) if w[i] > 0), key=w.__getitem__, reverse=True):
        up = at.get(parent[i]) if parent[i] is not None else None
        if up is not None:
            weight[up] += weight[i]
    for i in range(0, len(ids), 50_000):
        j = slice(i, i + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(ids[j], pa.string()), pa.array(weight[j], pa.int64())], names=["id", "total"])


def segments(links: DataFrame, near: list[str], parts: int, scratch: runtime.Scratch) -> DataFrame:
    """(id, parent, part, segment, above, w): the segment of each node; of circles, and what hangs below them, w is -1."""
    base = links.select("id", "parent", "w", "least", "top", F.col("parent").alias("link"), *(c for c in near if c != "id"))
    spread = base.repartitionByRange(parts, *near) if parts > 1 else base.coalesce(1)
    spread = spread.select("id", "parent", "w", "least", "top", "link", F.spark_partition_id().alias("part"))
    local, _ = scratch.write(spread.mapInArrow(_compress, _out(spread)))
    return local.select("id", F.col("link").alias("parent"), "part", F.col("top").alias("segment"), F.col("exit").alias("above"), "w")


def _totals(links: DataFrame, near: list[str], rows: int, parts: int, scratch: runtime.Scratch, per_task: int) -> DataFrame:
    """(id, total): weights of each node's whole subtree; null within and below circles."""
    seg = segments(links, near, parts, scratch)
    s = seg.join(links.select("id", "weight"), "id")
    spread = lambda df: df.repartitionById(parts, F.col("part")).select("id", "parent", "w", "weight")
    sums, _ = scratch.write(spread(s).mapInArrow(_sums, "id string, total bigint"))
    broken = seg.where("w < 0").select("id", F.lit(None).cast("bigint").alias("total"))
    tops = seg.where("w = 1 and above is not null").select("id", "above")
    of = seg.select(F.col("id").alias("above"), F.col("segment").alias("parent"), F.col("w").alias("aw"))
    hung = tops.join(of, "above").join(sums, "id")  # an exit that is in the table
    n = 0
    if parts > 1:
        hung, _, n = scratch.write_counted(hung)
    if n == 0:
        return seg.where("w > 0").select("id").join(sums, "id").unionByName(broken)
    # the tree of segments: the tops that hang somewhere, and the tops they hang from; below a circle a top is its own parent
    roots = seg.where("w = 1").select(F.col("id").alias("parent")).join(hung.select("parent").distinct(), "parent", "left_semi").join(hung.select(F.col("id").alias("parent")), "parent", "left_anti")
    up = hung.select("id", F.when(F.col("aw") > 0, F.col("parent")).otherwise(F.col("id")).alias("parent"), F.col("total").alias("weight"))
    up = up.unionByName(roots.join(sums.select(F.col("id").alias("parent"), F.col("total").alias("weight")), "parent").select(F.col("parent").alias("id"), F.lit(None).cast("string").alias("parent"), "weight"))
    up = up.withColumns({"w": F.lit(1).cast("bigint"), "least": F.col("id"), "top": F.col("id")})
    up, _, m = scratch.write_counted(up)
    if m > per_task and m > rows / 2:
        above = _doubled_sums(up, m, scratch)
    else:
        above = _totals(up, ["id"], m, 1 if m <= per_task else max(2, math.ceil(2 * m / per_task)), scratch, per_task)
    ext = hung.where("aw > 0").join(above.select("id", F.col("total").alias("whole")), "id").groupBy(F.col("above").alias("id")).agg(F.sum("whole").alias("ext"))
    again = s.join(ext, "id", "left").withColumn("weight", F.col("weight") + F.coalesce("ext", F.lit(0)))
    whole, _ = scratch.write(spread(again).mapInArrow(_sums, "id string, total bigint"))
    lost = above.where("total is null").select(F.col("id").alias("segment"), F.lit(True).alias("lost"))
    own = seg.where("w > 0").select("id", "segment").join(lost, "segment", "left").join(whole, "id")
    return own.select("id", F.when(F.col("lost").isNull(), F.col("total")).alias("total")).unionByName(broken)


def _doubled_sums(links: DataFrame, rows: int, scratch: runtime.Scratch) -> DataFrame:
    """The same by doubling, for links without an order: each round a node passes what it gathered twice as far up."""
    cur, _ = scratch.write(links.select("id", F.col("parent").alias("up"), F.col("weight").alias("total")))
    for _ in range(math.ceil(math.log2(max(2, rows))) + 1):
        gain = cur.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("total").alias("gain"))
        nxt = cur.select(F.col("id").alias("up"), F.col("up").alias("up2"))
        cur, _, _ = scratch.write_counted(cur.join(gain, "id", "left").join(nxt, "up", "left").select("id", F.col("up2").alias("up"), (F.col("total") + F.coalesce("gain", F.lit(0))).alias("total")))
        if cur.where("up is not null").isEmpty():
            break
    return cur.select("id", F.when(F.col("up").isNull(), F.col("total")).alias("total"))


def descendants(nodes: DataFrame, id: str, parent: str, near: list[str], per_task: int = PER_TASK, spread: int | None = None) -> DataFrame:
    """(id, descendants): how many nodes lie below each; null within circles and below them, where it has no end.

    Nodes and parents are read as ``hierarchy`` reads them; its rules for nulls,
    repeated ids and missing parents hold here.
    """
    links, marks, rows, parts = parent_links(nodes, id, parent, near, per_task, spread)
    out = _totals(links.withColumn("weight", F.lit(1).cast("bigint")), [*marks, "id"], rows, parts, runtime.Scratch(nodes.sparkSession, "lineage"), per_task)
    return out.select("id", (F.col("total") - 1).alias("descendants"))


def path_index(nodes: DataFrame, id: str, parent: str, near: list[str], per_task: int = PER_TASK, spread: int | None = None) -> DataFrame:
    """(id, segment, above, place): every node's place in its segment, counted from the top (1), and where the segment hangs.

    In circles, and below them, segment is the smallest id on the circle, above is
    null and place is -1, whichever partitions the circle runs through.
    """
    links, marks, rows, parts = parent_links(nodes, id, parent, near, per_task, spread)
    scratch = runtime.Scratch(nodes.sparkSession, "lineage")
    links, _ = scratch.write(links)
    seg = segments(links, [*marks, "id"], parts, scratch)
    circles = _solve(links, [*marks, "id"], rows, parts, scratch, per_task).where("depth < 0").select("id", F.col("root").alias("circle"))
    known = F.col("circle").isNull()
    return seg.join(circles, "id", "left").select(
        "id", "parent", F.coalesce("circle", "segment").alias("segment"), F.when(known, F.col("above")).alias("above"), F.when(known, F.col("w")).otherwise(-1).cast("bigint").alias("place")
    )


def _local_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole segments -> (id, path): the ids down to each wanted node.

    In: (id, parent, place, wanted, segment, head), a row a node, and for a segment
    that hangs from another one a row without id whose ``head`` is the path down to
    what it hangs from.
    """
    up, place, of, head, wanted = {}, {}, {}, {}, []
    for b in batches:
        for i, p, w, k, g, h in zip(*(c.to_pylist() for c in b.columns)):
            if i is None:
                head[g] = h
                continue
            up[i], place[i], of[i] = p, w, g
            if k:
                wanted.append(i)
    kind = pa.list_(pa.string())
    ids, out, held = [], [], 0
    for i in wanted:
        path = [i]
        while len(path) < place[i]:
            path.append(up[path[-1]])
        path = head.get(of[i], []) + path[::-1]
        ids.append(i)
        out.append(path)
        held += len(path)
        if held >= 200_000:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, kind)], names=["id", "path"])
            ids, out, held = [], [], 0
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, kind)], names=["id", "path"])


def _spelled(idx: DataFrame, wanted: DataFrame | None, scratch: runtime.Scratch) -> DataFrame:
    """(id, path) of the wanted nodes (None: of all) of an index without circles, which holds all segments above theirs.

    First the paths down to the nodes that segments hang from, joined by doubling up
    the tree of segments; then each path is spelled once, where its segment is.
    """
    width = runtime.shuffle_partitions(idx.sparkSession)
    kind = "id string, path array<string>"
    none = F.lit(None).cast("array<string>")

    def marked(ids: DataFrame) -> DataFrame:
        mark = ids.select("id").distinct().withColumn("wanted", F.lit(True))
        return idx.join(mark, "id", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))

    def local(rows: DataFrame, heads: DataFrame | None) -> DataFrame:
        rows = rows.select("id", "parent", "place", "wanted", "segment", none.alias("head"))
        if heads is not None:
            rows = rows.unionByName(heads.select(*(F.lit(None).cast(t).alias(c) for c, t in (("id", "string"), ("parent", "string"), ("place", "bigint"), ("wanted", "boolean"))), "segment", "head"))
        return rows.repartition(width, "segment").mapInArrow(_local_paths, kind)

    hang = idx.where("place = 1 and above is not null").select("segment", "above")
    down, _ = scratch.write(local(marked(hang.select(F.col("above").alias("id"))), None))
    over = idx.select(F.col("id").alias("above"), F.col("segment").alias("up")).join(down.select(F.col("id").alias("above"), "path"), "above")
    cur, _, n = scratch.write_counted(hang.join(over, "above").select("segment", "up", "path"))
    empty = F.array().cast("array<string>")
    for _ in range(math.ceil(math.log2(max(2, n))) + 2):
        if cur.where("up is not null").isEmpty():
            break
        nxt = cur.select(F.col("segment").alias("up"), F.col("up").alias("up2"), F.col("path").alias("head"))
        cur, _ = scratch.write(cur.join(nxt, "up", "left").select("segment", F.col("up2").alias("up"), F.concat(F.coalesce("head", empty), "path").alias("path")))
    else:
        raise RuntimeError("paths: segments hang from one another without end")
    heads = cur.select("segment", F.col("path").alias("head"))
    return local(idx.withColumn("wanted", F.lit(True)) if wanted is None else marked(wanted), heads)


def all_paths(index: DataFrame) -> DataFrame:
    """(id, path): the ids from the root down to every node of a path index; nodes in and below circles have none.

    Paths are spelled within segments, then those of the nodes that segments hang
    from are joined by doubling up the tree of segments. The output has as many ids
    as all depths together, which is n * n / 2 for one chain.
    """
    scratch = runtime.Scratch(index.sparkSession, "paths")
    return _spelled(scratch.write(index.where("place > 0"))[0], None, scratch)


def paths(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, path): the ids from the root down to each wanted node (id); those in or below circles, or unknown, have none.

    The segments above are found one by one, all nodes at once, so a path takes as
    many steps as it crosses partitions.
    """
    scratch = runtime.Scratch(index.sparkSession, "paths")
    idx, _ = scratch.write(index.where("place > 0"))
    hang = idx.where("place = 1 and above is not null").select("segment", "above").join(idx.select(F.col("id").alias("above"), F.col("segment").alias("up")), "above").select("segment", "up")
    hang, _, segments = scratch.write_counted(hang)
    frontier, _, n = scratch.write_counted(idx.join(wanted.select("id").distinct(), "id", "left_semi").select("segment").distinct())
    seen = frontier
    for _ in range(segments + 2):
        if not n:
            break
        frontier, _, n = scratch.write_counted(hang.join(frontier, "segment").select(F.col("up").alias("segment")).distinct().join(seen, "segment", "left_anti"))
        seen = seen.unionByName(frontier)
    else:
        raise RuntimeError("paths: segments hang from one another without end")
    own, _ = scratch.write(idx.join(seen, "segment", "left_semi"))
    return _spelled(own, wanted, scratch)


def intervals(nodes: DataFrame, id: str, parent: str, near: list[str], per_task: int = PER_TASK, spread: int | None = None) -> DataFrame:
    """(id, root, first, last): numbers from 1 in each tree, such that the descendants of a node are the nodes of its root with first < number <= last.

    A node's number is ``first``; children follow their parent in the order of their
    ids. Nodes in and below circles have none: root is the smallest id on the circle,
    first and last are null. The rules of ``hierarchy`` for nulls, repeated ids and
    missing parents hold.
    """
    links, marks, rows, parts = parent_links(nodes, id, parent, near, per_task, spread)
    scratch = runtime.Scratch(nodes.sparkSession, "intervals")
    links, links_at = scratch.write(links)
    order = [*marks, "id"]
    sizing = runtime.Scratch(nodes.sparkSession, "sizes")
    size, _ = scratch.write(_totals(links.withColumn("weight", F.lit(1).cast("bigint")), order, rows, parts, sizing, per_task).select("id", F.col("total").alias("size")))
    sizing.drop(sizing.base)
    own = links.join(size, "id").withColumn("up", F.col("parent"))
    # sums over the siblings before, in ranges of siblings, so that one task does not take all children of a node
    width = max(parts, runtime.shuffle_partitions(nodes.sparkSession))
    cut, cut_at = scratch.write(own.select("id", "up", "parent", "size", *marks).repartitionByRange(width, "up", "id").withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy("up", "range").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut.groupBy("up", "range").agg(F.sum("size").alias("sum")).withColumn("earlier", F.sum("sum").over(Window.partitionBy("up").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    ranges = ranges.where("up is not null").select("up", "range", "earlier")
    offset = F.coalesce(F.sum("size").over(before), F.lit(0)) + F.coalesce("earlier", F.lit(0))
    placed = cut.join(F.broadcast(ranges) if rows <= per_task else ranges, ["up", "range"], "left")
    known = links.select(F.col("id").alias("up"), F.lit(True).alias("inner"))
    placed = placed.withColumn("offset", offset).join(known, "up", "left")
    weighted = placed.select("id", "parent", F.when(F.col("inner") & F.col("size").isNotNull(), 1 + F.col("offset")).otherwise(1).cast("bigint").alias("w"), *marks, "size")
    weighted, _ = scratch.write(weighted)
    scratch.drop(cut_at, links_at)
    weighted = weighted.withColumns({"least": F.col("id"), "top": F.col("id")})
    first = _solve(weighted.drop("size"), order, rows, parts, scratch, per_task)
    done = first.join(weighted.select("id", "size"), "id")
    good = F.col("depth") > 0
    return done.select("id", "root", F.when(good, F.col("depth")).alias("first"), F.when(good, F.col("depth") + F.col("size") - 1).alias("last"))

"""Texts measured in tokens, packed into contexts of fixed capacity.

Hierarchical residual packing: each partition packs its items by best fit, longest
first. Bins that are nearly full, or that no other item could join, are done; the
others are the items of the next level, whose partitions each hold the underfull
bins of several, until one task holds them all or packing them again gains nothing.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import runtime

CAPACITY = 4096
#: The vocabulary of a public tokenizer (ranks in tiktoken's format), and how it splits text.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items that a task packs, the share of the capacity at which a bin is done, and the least gain of a level.
PER_TASK, NEARLY, GAIN = 100_000, 0.995, 0.01
MOST_LEVELS = 40

_encodings: dict = {}


def encoding(path: str = VOCABULARY):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, tokens) of every text; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(path)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["id", "tokens"])

    return docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id bigint, tokens bigint").select(F.col("id").alias(id), "tokens")


def pieces(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, size): an item over the capacity is cut into full pieces and a rest, any other is one piece."""
    count = F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(capacity))).cast("int")
    own = sizes.where("id is not null and size is not null and size >= 0")
    return own.select("id", "size", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece")).select(
        "id", "piece", F.least(F.lit(capacity), F.col("size") - F.col("piece").cast("bigint") * F.lit(capacity)).alias("size")
    )


def best_fit(items: list[tuple[int, int]], capacity: int) -> tuple[list[int], list[int]]:
    """The bin of each item, and the fill of each bin: longest first, into the bin that it fills best."""
    bins: list[int] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, out = 0, [0] * len(items)
    for k in sorted(range(len(items)), key=lambda i: (-items[i][1], items[i][0])):
        size = items[k][1]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append(0)
        bins[b] += size
        out[k] = b
        if room - size:
            free[room - size].append(b)
            mask |= 1 << (room - size)
    return out, bins


def _packed(capacity: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        items.sort()
        where, fills = best_fit(items, capacity)
        base = (level << 56) + (TaskContext.get().partitionId() << 28)
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in items], pa.int64()), pa.array([base + b for b in where], pa.int64()), pa.array([fills[b] for b in where], pa.int64())], names=["item", "bin", "fill"]
        )

    return run


def pack(sizes: DataFrame, id: str, size: str, capacity: int = CAPACITY, per_task: int = PER_TASK) -> DataFrame:
    """(id, piece, size, bin, fill): every item in a bin, none split that fits into one.

    Rows with a null id or size, or a negative size, are left out; items of size 0
    take no room. An id given several times is several items. An empty table gives
    an empty one. ``fill`` is the sum of the sizes in the bin.
    """
    spark = sizes.sparkSession
    scratch = runtime.Scratch(spark, "packing")
    rows = pieces(sizes.select(F.col(id).alias("id"), F.col(size).cast("bigint").alias("size")), capacity)
    parts, _ = scratch.write(rows.withColumn("item", F.monotonically_increasing_id()))
    level, items, levels, gained = 1, parts.select("item", "size"), [], True
    n, smallest = items.agg(F.count(F.lit(1)), F.min("size")).first()
    while n:
        width = max(1, math.ceil(n / per_task))
        spread = items.repartition(width, F.xxhash64("item", F.lit(level)))
        packed, _ = scratch.write(spread.mapInArrow(_packed(capacity, level), "item bigint, bin bigint, fill bigint"))
        levels.append(packed)
        rest = packed.where((F.col("fill") < F.lit(math.floor(NEARLY * capacity))) & (F.col("fill") + F.lit(smallest) <= F.lit(capacity)))
        items = rest.select(F.col("bin").alias("item"), F.col("fill").alias("size")).distinct()
        had, bins = n, packed.agg(F.count_distinct("bin")).first()[0]
        n, smallest = items.agg(F.count(F.lit(1)), F.min("size")).first()
        again = bins <= had * (1 - GAIN)
        if width == 1 or level == MOST_LEVELS or not (again or gained):
            break
        gained, level = again, level + 1
    if not levels:
        return parts.select(F.col("id").alias(id), "piece", "size", F.lit(None).cast("bigint").alias("bin"), F.lit(None).cast("bigint").alias("fill"))
    top = levels.pop()
    for own in reversed(levels):
        t = top.select(F.col("item").alias("bin"), F.col("bin").alias("b2"), F.col("fill").alias("f2"))
        top, _ = scratch.write(own.join(t, "bin", "left").select("item", F.coalesce("b2", "bin").alias("bin"), F.coalesce("f2", "fill").alias("fill")))
    return parts.join(top, "item").select(F.col("id").alias(id), "piece", "size", "bin", "fill")


def contexts(docs: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, tokens, context, filled): all texts of ``documents`` in contexts of ``capacity`` tokens."""
    packed = pack(token_counts(docs, path=path), "doc_id", "tokens", capacity)
    return packed.select("doc_id", "piece", F.col("size").alias("tokens"), F.col("bin").alias("context"), F.col("fill").alias("filled"))


def checked(docs: DataFrame, packed: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, whole, fits) of every text: its pieces are there once and hold all of its tokens; it is cut only where it must be, and no context of its runs over."""
    bins = packed.groupBy("context").agg(F.sum("tokens").alias("load"))
    p = packed.join(bins, "context", "left").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("k"), F.count_distinct("piece").alias("different"), F.max("piece").alias("last"), F.sum("tokens").alias("sum"), F.max("load").alias("load"), F.min(F.col("load") == F.col("filled")).alias("said")
    )
    whole = (F.col("k") == F.col("different")) & (F.col("last") == F.col("k") - 1) & (F.col("sum") == F.col("tokens"))
    fits = (F.col("load") <= capacity) & F.col("said") & (F.col("k") == F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(capacity))))
    no = F.lit(False)
    return token_counts(docs, path=path).join(p, "doc_id", "left").select("doc_id", F.coalesce(whole, no).alias("whole"), F.coalesce(fits, no).alias("fits"))


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: (pieces, tokens, contexts, least, unused): contexts used, the fewest that any packing needs, and the share of their room left unused."""
    bins = packed.groupBy("context").agg(F.count(F.lit(1)).alias("k"), F.sum("tokens").alias("load"))
    one = bins.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("load"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("contexts"))
    return one.select("pieces", "tokens", "contexts", F.ceil(F.col("tokens") / F.lit(capacity)).alias("least"), F.try_subtract(F.lit(1.0), F.try_divide(F.col("tokens"), F.col("contexts") * F.lit(capacity))).alias("unused"))

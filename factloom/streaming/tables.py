"""Tables kept by micro-batches: each batch writes its own part once, whatever is tried again."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.runtime import _path

_PART = re.compile(r"part\.(\d+)-(\d+)$")


def union(parts: DataFrame) -> DataFrame:
    return parts


class Deltas:
    """A table as the merge of what its batches wrote.

    Batch ``b`` writes ``part.b-b``, so its cost follows the batch and not the table.
    Before it does, ``compact`` neighbouring parts of one generation are merged into
    one of the next, so a row is rewritten once a generation: the number of parts, and
    the rewrites of a row, grow with the logarithm of the batches. A part counts once
    its _SUCCESS file is there, and hides the parts that it covers; those are removed
    a batch later, when nothing reads them. A batch that runs again replaces its part;
    ``merge`` must be associative. ``by``: a column that parts are laid out by, for
    reads of some of its values.
    """

    def __init__(self, spark: SparkSession, root: str, merge: Callable[[DataFrame], DataFrame] = union, compact: int = 16, by: str | None = None):
        self.spark, self.root, self.merge, self.compact, self.by = spark, root.rstrip("/"), merge, compact, by

    def _all(self) -> list[tuple[int, int]]:
        """(first, last) batch of every part that is whole."""
        path, fs = _path(self.spark, self.root)
        if not fs.exists(path):
            return []
        found = [(m, s.getPath().getName()) for s in fs.listStatus(path) if (m := _PART.match(s.getPath().getName()))]
        return sorted((int(m[1]), int(m[2])) for m, name in found if fs.exists(_path(self.spark, f"{self.root}/{name}/_SUCCESS")[0]))

    def parts(self, before: int | None = None) -> list[tuple[int, int]]:
        """The parts that make up the table, or made it up before a batch."""
        out: list[tuple[int, int]] = []
        for lo, hi in sorted(self._all(), key=lambda p: p[0] - p[1]):
            if (before is None or hi < before) and not any(a <= lo and hi <= b for a, b in out):
                out.append((lo, hi))
        return sorted(out)

    def _read(self, parts: list[tuple[int, int]]) -> DataFrame:
        out = None
        for lo, hi in parts:
            one = self.spark.read.parquet(f"{self.root}/part.{lo}-{hi}")
            out = one if out is None else out.unionByName(one)
        return self.merge(out)

    def read(self, before: int | None = None) -> DataFrame | None:
        """The table, or as it was before a batch; None where nothing is written."""
        parts = self.parts(before)
        return self._read(parts) if parts else None

    def _generation(self, part: tuple[int, int]) -> int:
        size, g = part[1] - part[0] + 1, 0
        while size >= self.compact:
            size, g = size // self.compact, g + 1
        return g

    def _put(self, df: DataFrame, name: str) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(self.by) if self.by else writer).parquet(f"{self.root}/{name}")

    def _tidy(self, batch: int) -> None:
        """Remove what earlier merges cover, then merge the parts of one generation that are enough."""
        parts = self.parts(batch)
        for lo, hi in self._all():
            if hi < batch and (lo, hi) not in parts:
                path, fs = _path(self.spark, f"{self.root}/part.{lo}-{hi}")
                fs.delete(path, True)
        while True:
            run: list[tuple[int, int]] = []
            for p in reversed(self.parts(batch)):
                if run and self._generation(p) != self._generation(run[0]):
                    break
                run.insert(0, p)
            if len(run) < self.compact:
                return
            self._put(self._read(run), f"part.{run[0][0]}-{run[-1][1]}")

    def write(self, batch: int, df: DataFrame) -> None:
        self._tidy(batch)
        self._put(df, f"part.{batch}-{batch}")

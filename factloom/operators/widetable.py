"""Attribute-value rows into one row per entity with typed columns.

RDD ``combineByKey`` with slot registers: an entity's combiner has one register
per attribute, holding the row that stands so far. Merging two registers keeps
the one that comes first in the cell order, which is associative and commutative,
so duplicates and hot entities shrink on the map side before the shuffle.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from factloom import runtime
from factloom.functions.typed import canonical

#: Column types of attrs.vtype.
COLUMN = {"text": T.StringType(), "ref": T.StringType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "date": T.DateType()}
#: Most attributes of a wide table.
MOST_ATTRIBUTES = 5_000


def attribute_types(attrs: DataFrame, only: list[str] | None = None) -> dict[str, str]:
    """Attribute -> vtype of the schema table, which is small by its nature (checked)."""
    rows = runtime.bounded(attrs.where("a is not null").select("a", "vtype").distinct(), MOST_ATTRIBUTES, "the attribute schema")
    got = {r["a"]: r["vtype"] if r["vtype"] in COLUMN else "text" for r in sorted(rows, key=lambda r: (r["a"], r["vtype"] or ""), reverse=True)}
    return {a: got[a] for a in (only if only is not None else sorted(got)) if a in got}


def _holds(a: tuple | None, b: tuple | None) -> tuple | None:
    """Of two cells (vf, id, value), the one with the later vf, then the smaller id, then the smaller value; a null vf is earliest."""
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if b[0] is None or (a[0] is not None and a[0] > b[0]) else b
    return a if a[1:] <= b[1:] else b


def wide_table(datoms: DataFrame, types: dict[str, str], tier: str = "culture") -> DataFrame:
    """One row per entity with a typed column per attribute of ``types``.

    Rows count whose tier is ``tier`` and whose v is a value of the attribute's
    type; an entity without any has no row. Where several remain for a cell, the
    largest vf holds (null: smallest), then the smallest id (null: smallest).
    Rows with a null e or a are left out; an empty table gives an empty one.
    Extra columns of the input are not read.
    """
    spark = datoms.sparkSession
    slots = {a: i for i, a in enumerate(types)}
    schema = T.StructType([T.StructField("e", T.StringType()), *(T.StructField(a, COLUMN[t]) for a, t in types.items())])
    if not types:
        return spark.createDataFrame([], schema)
    own = datoms.where((F.col("tier") == tier) & F.col("a").isin(*types) & F.col("e").isNotNull())
    # written once, so that values are read once and their number sizes the shuffle
    rows, _, n = runtime.Scratch(spark, "wide").write_counted(
        own.select("e", "a", "vf", F.coalesce("id", F.lit("")).alias("id"), canonical(F.col("v"), F.col("a"), types).alias("val")).where("val is not null")
    )
    parts = runtime.shuffle_partitions(spark, n)
    width, kinds = len(types), list(types.values())

    def create(cell: tuple) -> list:
        out = [None] * width
        out[cell[0]] = cell[1]
        return out

    def add(have: list, cell: tuple) -> list:
        have[cell[0]] = _holds(have[cell[0]], cell[1])
        return have

    def merge(x: list, y: list) -> list:
        return [_holds(p, q) for p, q in zip(x, y)]

    read = {"bigint": int, "boolean": "true".__eq__, "date": datetime.date.fromisoformat}

    def encode(row: tuple) -> tuple:
        return (row[0], *(None if r is None else read.get(k, str)(r[2]) for r, k in zip(row[1], kinds)))

    keyed = rows.rdd.map(lambda r: (r[0], (slots[r[1]], (r[2], r[3], r[4]))))
    wide = keyed.combineByKey(create, add, merge, parts).map(encode)
    return spark.createDataFrame(wide, schema, verifySchema=False)


def cells(wide: DataFrame) -> DataFrame:
    """The filled cells of a wide table: (e, a, val), val as text."""
    names = [c for c in wide.columns if c != "e"]
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.col(f"`{a}`").cast("string").alias("val")) for a in names))
    return wide.select("e", F.explode(pairs).alias("c")).select("e", "c.a", "c.val").where("val is not null")

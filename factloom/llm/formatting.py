"""Records that differ in formatting only, collapsed and counted.

Merkle-style hashing from the leaves: a field's label and value are normalised
and hashed, the digests of a node without order are sorted and hashed, and the
record's digest covers its attribute, its text and the field node. Records are
grouped by root digest; a group is confirmed when the smallest and the largest
canonical form in it are equal, which compares the whole structure of all members.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import runtime
from factloom.operators.skew import hot_keys, lookup

#: White space, punctuation, control characters, and marks of plain-text mark-up.
IGNORED = r"[\s\p{Z}\p{P}\p{C}`~^|]+"
FIELD_ENDS, LABEL_ENDS = r"[;|\r\n]+", r"[:=]"


def leaf(c: Column) -> Column:
    """A text without what formatting may change: case, white space and punctuation."""
    return F.regexp_replace(F.lower(F.upper(c)), IGNORED, "")


def fields(c: Column) -> Column:
    """The labelled fields of a text as a sorted set of ``label U+0001 value``; empty ones are none."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), FIELD_ENDS), lambda f: F.split(f, LABEL_ENDS, 2))
    named = F.transform(
        parts, lambda p: F.when(F.size(p) > 1, F.concat(leaf(p[0]), F.lit("\u0001"), leaf(F.get(p, F.lit(1))))).otherwise(F.concat(F.lit("\u0001"), leaf(p[0])))
    )
    return F.array_sort(F.array_distinct(F.filter(named, lambda f: f != "\u0001")))


def sha256(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def digested(records: DataFrame, id: str, kind: str, text: Column, labelled: Column, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(id, digest, canon), one row an id; rows of one id that differ count as the one with the smallest canonical form.

    A null kind, text or field set is an empty one. Rows with a null id are left out.
    """
    r = records.where(F.col(id).isNotNull()).select(
        F.col(id).cast("string").alias("id"), F.coalesce(F.col(kind), F.lit("")).alias("kind"), leaf(F.coalesce(text, F.lit(""))).alias("body"), fields(labelled).alias("fields")
    )
    node = F.sha2(F.concat_ws("", F.array_sort(F.transform("fields", lambda f: F.sha2(f, 256)))), 256)
    root = digest(F.concat_ws("\u0002", "kind", F.sha2("body", 256), node))
    canon = F.concat_ws("\u0002", "kind", "body", F.concat_ws("\u0003", "fields"))
    return r.select("id", canon.alias("canon"), root.alias("digest")).groupBy("id").agg(F.min(F.struct("canon", "digest")).alias("x")).select("id", "x.digest", "x.canon")


def collapse(records: DataFrame, id: str, kind: str, text: Column, labelled: Column, digest: Callable[[Column], Column] = sha256) -> tuple[DataFrame, DataFrame]:
    """Groups (id_first, copies) and members (id_first, id_other) of records equal but for formatting.

    ``copies`` counts all members, so a record without a copy has 1. Empty tables give empty ones.
    ``digest`` gives the binary root digest of a record; one that collides costs time, not results.
    """
    scratch = runtime.Scratch(records.sparkSession, "formatting")
    rows, _ = scratch.write(digested(records, id, kind, text, labelled, digest))
    groups = rows.groupBy("digest").agg(F.min("id").alias("id_first"), F.count(F.lit(1)).alias("copies"), (F.min("canon") == F.max("canon")).alias("same"))
    groups, _ = scratch.write(groups)
    several = groups.where("copies > 1 and same").select(F.hex("digest").alias("k"), "id_first")
    keyed = rows.select("id", F.hex("digest").alias("k"))
    members = lookup(keyed, several, "k", hot_keys(keyed, "k"), "inner").select("id_first", F.col("id").alias("id_other"))
    report = groups.where("same").select("id_first", "copies")
    if not groups.where("not same").isEmpty():  # digests that collide: grouped by the whole structure
        odd = rows.join(groups.where("not same").select("digest"), "digest", "left_semi")
        exact = odd.groupBy("canon").agg(F.min("id").alias("id_first"), F.count(F.lit(1)).alias("copies"))
        report = report.unionByName(exact.select("id_first", "copies"))
        members = members.unionByName(odd.join(exact.where("copies > 1"), "canon").select("id_first", F.col("id").alias("id_other")))
    return report, members.where("id_first <> id_other")


def datom_records(datoms: DataFrame) -> DataFrame:
    return datoms.where(F.col("a").isin("defined_as", "caution"))


def datom_copies(datoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    return collapse(datom_records(datoms), "id", "a", F.col("v"), F.col("quote.text"))

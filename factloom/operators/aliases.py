"""Entities that are one because an identity attribute says so.

A value of an identity attribute names an entity id of its own (``canon.entity_id``);
an entity with that value is the same. Each identity is a star of the entities that
have its value, and most entities have one, so one aggregate settles them; only
identities that share an entity are left to be joined, by propagating the smallest
id and jumping along it until nothing changes. A hot identity is aggregated where
its rows are read, and the skew join of adaptive execution splits its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from factloom import runtime
from factloom.functions import canon

MOST_ROUNDS = 100


def identity_links(facts: DataFrame, schema: DataFrame) -> DataFrame:
    """(e, i): entities and the ids that their identity attributes name, where these differ."""
    own = [r["a"] for r in runtime.bounded(schema.where("uniq = 'identity' and a is not null").select("a").distinct(), 1000, "the identity attributes")]
    named = facts.where(F.col("a").isin(own) & F.col("e").isNotNull() & F.col("v").isNotNull())
    return named.select("e", canon.entity_id(F.col("a"), F.col("v")).alias("i")).where("e <> i")


def _joined(edges: DataFrame, scratch: runtime.Scratch) -> DataFrame:
    """(v, l): the smallest id of each component of the edges (u, v)."""
    both, _ = scratch.write(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels, _ = scratch.write(both.groupBy("u").agg(F.least("u", F.min("v")).alias("l")).withColumnRenamed("u", "v"))
    for _ in range(MOST_ROUNDS):
        near = both.join(labels, "v").groupBy(F.col("u").alias("v")).agg(F.min("l").alias("m"))
        met = labels.join(near, "v").select("v", F.least("l", "m").alias("l"), F.col("l").alias("before"))
        up = labels.select(F.col("v").alias("l"), F.col("l").alias("up"))
        seen = Observation()
        out = met.join(up, "l", "left").select("v", F.least("l", F.coalesce("up", "l")).alias("l"), "before")
        labels, _ = scratch.write(out.observe(seen, F.count_if(F.col("l") != F.col("before")).alias("moved")).select("v", "l"))
        if not seen.get["moved"]:
            return labels
    raise RuntimeError(f"aliases: not stable after {MOST_ROUNDS} rounds")


def representatives(links: DataFrame) -> DataFrame:
    """(e, rep): the smallest id of each group of ids that links (e, i) join, for the ids that are not their own.

    Links with a null end add nothing; an empty table gives an empty one.
    """
    scratch = runtime.Scratch(links.sparkSession, "aliases")
    own = links.select("e", "i").where("e is not null and i is not null and e <> i")
    stars = own.groupBy("i").agg(F.least("i", F.min("e")).alias("r"))
    # what each id is joined to, as an entity and as an identity
    met = own.join(stars, "i").select("e", "r").unionByName(stars.select(F.col("i").alias("e"), "r"))
    seen = Observation()
    held = met.groupBy("e").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    held, _ = scratch.write(held.observe(seen, F.count_if(F.col("lo") != F.col("hi")).alias("several")))
    mapped = held.select("e", F.col("lo").alias("rep"))
    if seen.get["several"]:  # stars that share an id
        edges = met.join(held.where("lo <> hi").select("e", "lo"), "e").select(F.col("r").alias("u"), F.col("lo").alias("v")).where("u <> v")
        top = _joined(edges, scratch).select(F.col("v").alias("rep"), F.col("l").alias("top"))
        mapped = mapped.join(top, "rep", "left").select("e", F.coalesce("top", "rep").alias("rep"))
    return mapped.where("e <> rep")

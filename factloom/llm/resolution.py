"""Spellings of one person or organisation, linked.

Merge-and-rematch resolution: each entity starts as a profile with its spellings.
Profiles of one scope (an institute; for bodies, the kind of body) whose surnames or
houses are close and whose given names fit are compared; those that match are merged,
and the merged profile has the spellings, initials and scopes of all, hence more that
it can match. Merged profiles enter blocking again until a round merges nothing.
Profiles with full given names are matched first; one with initials only joins the
one full profile that fits it, and none where several do. Profiles without a scope
join the one profile of any scope that fits best, and after each of these joins all
is matched again.

Which words are close, and which given names fit, is found once, on the different
words: merging brings no new ones. So a block holds the different spellings of one
surname and given name, however many rows have them, and what a pair of profiles
was judged is kept until one of them changes.

Spellings that may be of one make closed blocks, which know nothing of each other. The
profiles of a block of usual size are merged by one task, all rounds of it
(``settling``); only blocks with more profiles take their rounds together as tables
(``Matching``), with four plans or more a round. Both ways give the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from factloom import runtime
from factloom.functions.typed import ref_of
from factloom.llm import settling, spelling
from factloom.llm.components import components

MOST_ROUNDS = 60
#: Merged pairs that one cell of the components may hold; a round has few.
CELL = 200_000
#: Profiles of a block that one task merges, and profiles a task is given in all.
BLOCK, PER_TASK = 500, 20_000


def _met(x: DataFrame, y: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``x`` joined with ``y`` by shuffle, never by broadcast.

    A plan takes the size of its tables from compressed files and doesn't see rows
    that Python makes of them: a list of words of a few 100 KB has 50 times as many
    keys, which a broadcast would gather on the driver.
    """
    return x.join(y.hint("merge"), on, how)


def _word_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield f.assign(key=[spelling.keys(w) for w in f["w"]]).explode("key", ignore_index=True)[["w", "key"]]


def _close(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield f[[spelling.close(u, v) for u, v in zip(f["w"], f["w2"])]]


def _given_keys(lists: spelling.Lists):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for g in f["g"]:
                if len(g) > 1:
                    own, every = spelling.given_keys(g, lists)
                    out += [(g, k, True) for k in own] + [(g, k, False) for k in every]
                    out += [(g, f"={i}", False) for i in spelling.initials(g, lists)]
                else:
                    out += [(g, f"={g}", True), (g, f"={g}", False)]
            yield pd.DataFrame(out, columns=["g", "key", "own"])

    return run


def _fitting(lists: spelling.Lists):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[[spelling.fits(g, h, lists) for g, h in zip(f["g"], f["g2"])]]

    return run


def _judged(kind: str, lists: spelling.Lists) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        said = settling.judge(kind, lists)
        for f in frames:
            out = [said(fa, fb) for fa, fb in zip(f["fa"], f["fb"])]
            yield pd.DataFrame({"a": f["a"], "b": f["b"], "fit": out, "full_a": f["full_a"], "full_b": f["full_b"]})

    return run


def _atom(form: Column, kind: str) -> tuple[Column, Column]:
    """Surname and first given name of a person's spelling, house and kind of a body's."""
    w, g = (F.split(form, r"\|")[i] for i in (0, 1))
    return w, F.split(g, " ")[0] if kind == "person" else g


def blocks(profiles: DataFrame, kind: str, near: DataFrame) -> DataFrame:
    """(block, cid, scopes, forms): the closed blocks of ``profiles``, within which all spellings that may be of one are."""
    keys = F.array_distinct(F.transform("forms", lambda x: F.concat_ws("|", *_atom(x, kind))))
    keyed = profiles.withColumn("keys", keys)
    linked = near.select(F.concat_ws("|", "w", "g").alias("u"), F.concat_ws("|", "w2", "g2").alias("v")).where("u < v")
    own = keyed.select(F.col("keys")[0].alias("u"), F.explode("keys").alias("v")).where("u <> v")
    first = components(linked.unionByName(own), "u", "v", least=CELL).select(F.col("member").alias("key"), F.col("first").alias("block"))
    placed = _met(keyed.withColumn("key", F.col("keys")[0]), first, "key", "left")
    return placed.select(F.coalesce("block", "key").alias("block"), "cid", "scopes", "forms")


def _full(forms: str) -> Column:
    return F.exists(forms, lambda x: F.length(F.split(F.split(x, r"\|")[1], " ")[0]) > 1)


def vocabulary(forms: DataFrame, kind: str, scratch: runtime.Scratch, lists: spelling.Lists) -> DataFrame:
    """(w, g, w2, g2): the surnames with given names (houses with kinds) of ``forms`` (form) that may be of one, in both directions."""
    w, g = _atom(F.col("form"), kind)
    names, _ = scratch.write(forms.select(w.alias("w"), g.alias("g")).distinct())
    # close words share a key; the keys are hashed, as each pair of words is held against the rule
    keyed = names.select("w").distinct().mapInPandas(_word_keys, "w string, key string").select("w", F.xxhash64("key").alias("key"))
    near = _met(keyed, keyed.withColumnRenamed("w", "w2"), "key").where("w <= w2").select("w", "w2").distinct().mapInPandas(_close, "w string, w2 string")
    near, _ = scratch.write(near.unionByName(near.where("w < w2").select(F.col("w2").alias("w"), F.col("w").alias("w2"))))
    if kind != "person":  # of one kind of body
        pairs = _met(_met(names, near, "w"), names.select(F.col("w").alias("w2"), "g"), ["w2", "g"])
        return scratch.write(pairs.select("w", "g", "w2", F.col("g").alias("g2")))[0]
    pairs = _met(_met(names, near, "w"), names.select(F.col("w").alias("w2"), F.col("g").alias("g2")), "w2")
    keyed = names.select("g").distinct().mapInPandas(_given_keys(lists), "g string, key string, own boolean")
    fit = _met(keyed.where("own").select("g", "key"), keyed.where("not own").select(F.col("g").alias("g2"), "key"), "key").select("g", "g2").distinct()
    fit = fit.mapInPandas(_fitting(lists), "g string, g2 string")
    fit, _ = scratch.write(fit.unionByName(fit.select(F.col("g2").alias("g"), F.col("g").alias("g2"))).distinct())
    return scratch.write(_met(pairs, fit, ["g", "g2"]).select("w", "g", "w2", "g2"))[0]


class Matching:
    """Profiles of one kind while they are merged: (cid, scopes, forms, fresh), what pairs were judged, and the pairs merged."""

    def __init__(self, profiles: DataFrame, kind: str, near: DataFrame, scratch: runtime.Scratch, lists: spelling.Lists):
        self.kind, self.near, self.scratch, self.lists = kind, near, scratch, lists
        self.profiles, _ = scratch.write(profiles.withColumn("fresh", F.lit(True)))
        self.judged: DataFrame | None = None
        self.edges: list[DataFrame] = []

    def _atoms(self, profiles: DataFrame) -> DataFrame:
        """(cid, fresh, w, g) of each profile's spellings."""
        w, g = _atom(F.col("form"), self.kind)
        x = profiles.select("cid", "fresh", "scopes", F.explode("forms").alias("form"))
        return x.select("cid", "fresh", "scopes", w.alias("w"), g.alias("g")).distinct()

    def _judge(self, pairs: DataFrame) -> DataFrame:
        p = self.profiles.select("cid", "forms")
        both = _met(_met(pairs, p.select(F.col("cid").alias("a"), F.col("forms").alias("fa")), "a"), p.select(F.col("cid").alias("b"), F.col("forms").alias("fb")), "b")
        both = both.select("a", "b", "fa", "fb", _full("fa").alias("full_a"), _full("fb").alias("full_b"))
        return both.mapInPandas(_judged(self.kind, self.lists), "a string, b string, fit int, full_a boolean, full_b boolean").where("fit > 0")

    @staticmethod
    def _other(y: DataFrame) -> DataFrame:
        return y.select(F.col("cid").alias("d"), F.col("w").alias("w2"), F.col("g").alias("g2"), *(["scope"] if "scope" in y.columns else []))

    _ends = staticmethod(lambda joined: joined.where("cid <> d").select(F.least("cid", "d").alias("a"), F.greatest("cid", "d").alias("b")).distinct())

    def compare(self) -> tuple[DataFrame, int]:
        """(a, b, fit, full_a, full_b) of the profiles that share a scope and fit, and how many of these pairs are one for sure.

        Only pairs of which one is fresh are judged; the others are as before.
        """
        atoms = self._atoms(self.profiles)
        atoms = atoms.select("cid", "fresh", F.explode("scopes").alias("scope"), "w", "g")
        joined = _met(_met(atoms.where("fresh"), self.near, ["w", "g"]), self._other(atoms), ["scope", "w2", "g2"])
        judged = self._judge(self._ends(joined))
        if self.judged is not None:
            same = self.profiles.where("not fresh").select("cid")
            judged = judged.unionByName(_met(_met(self.judged, same.withColumnRenamed("cid", "a"), "a", "left_semi"), same.withColumnRenamed("cid", "b"), "b", "left_semi"))
        seen = Observation()
        self.judged, _ = self.scratch.write(judged.observe(seen, F.count_if(F.col("fit") == 2).alias("sure")))
        return self.judged, seen.get["sure"]

    def merge(self, edges: DataFrame, n: int) -> None:
        """Merge the profiles that the written edges (a, b) join; merged ones are marked to enter blocking again."""
        self.edges.append(edges)
        to = components(edges, "a", "b", rows=n, least=CELL).select(F.col("member").alias("cid"), F.col("first").alias("into"))
        into = to.select(F.col("into").alias("cid"), F.lit(True).alias("first")).distinct()
        p = _met(_met(self.profiles, to, "cid", "left"), into, "cid", "left")
        p = p.select(F.coalesce("into", "cid").alias("cid"), "scopes", "forms", (F.col("into").isNotNull() | F.col("first").isNotNull()).alias("moved"))
        kept = p.where("not moved").select("cid", "scopes", "forms", F.lit(False).alias("fresh"))
        gathered = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
        new = p.where("moved").groupBy("cid").agg(gathered("scopes").alias("scopes"), gathered("forms").alias("forms"), F.lit(True).alias("fresh"))
        self.profiles, _ = self.scratch.write(kept.unionByName(new))

    def rest(self) -> None:
        """Mark all profiles as compared."""
        self.profiles = self.profiles.withColumn("fresh", F.lit(False))

    def within_scopes(self) -> None:
        for _ in range(MOST_ROUNDS):
            judged, sure = self.compare()
            edges, n = judged.where("fit = 2").select("a", "b"), sure
            if not n and self.kind == "person":
                edges, _, n = self.scratch.write_counted(_weak_edges(judged))
            if not n:
                return self.rest()
            self.merge(edges, n)
        raise RuntimeError("resolution: still merging after the last round")

    def across_scopes(self) -> bool:
        """Join profiles without a scope to the one profile of any scope that fits them best, and to one another; whether any joined."""
        loose = self.profiles.where(F.size("scopes") == 0).select("cid")
        atoms = self._atoms(self.profiles)
        joined = _met(_met(atoms.where(F.size("scopes") == 0), self.near, ["w", "g"]), self._other(atoms), ["w2", "g2"])
        judged, _ = self.scratch.write(self._judge(self._ends(joined)))
        s = self.profiles.select(F.col("cid").alias("y"), (F.size("scopes") > 0).alias("scoped"))
        ends = judged.select(F.col("a").alias("x"), F.col("b").alias("y"), "fit").unionByName(judged.select(F.col("b").alias("x"), F.col("a").alias("y"), "fit"))
        scoped = _met(_met(ends, loose.withColumnRenamed("cid", "x"), "x", "left_semi"), s, "y").where("scoped")
        best = scoped.groupBy("x", "fit").agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("y")).groupBy("x").agg(F.max(F.struct("fit", "n", "y")).alias("t")).select("x", "t.n", "t.y")
        edges = best.where("n = 1").select(F.col("x").alias("a"), F.col("y").alias("b"))
        free = _met(loose, best.select(F.col("x").alias("cid")), "cid", "left_anti")
        alone = _met(_met(judged, free.withColumnRenamed("cid", "a"), "a", "left_semi"), free.withColumnRenamed("cid", "b"), "b", "left_semi")
        edges = edges.unionByName(alone.where("fit = 2").select("a", "b")).unionByName(_weak_edges(alone))
        edges, _, n = self.scratch.write_counted(edges)
        if n:
            self.merge(edges, n)
        return n > 0

    def run(self) -> None:
        self.within_scopes()
        if self.kind == "person":
            for _ in range(MOST_ROUNDS):
                if not self.across_scopes():
                    return
                self.within_scopes()
            raise RuntimeError("resolution: still merging after the last round")

    def clusters(self, members: DataFrame) -> DataFrame:
        """(e, cid) after all merges, from the (e, cid) at their start."""
        if not self.edges:
            return members
        every = self.edges[0]
        for more in self.edges[1:]:
            every = every.unionByName(more)
        to = components(every, "a", "b", least=CELL).select(F.col("member").alias("cid"), F.col("first").alias("into"))
        return _met(members, to, "cid", "left").select("e", F.coalesce("into", "cid").alias("cid"))


def _weak_edges(judged: DataFrame) -> DataFrame:
    """Edges of profiles with initials only: to the one full profile that fits, or among themselves where none does."""
    weak = judged.where("fit = 1")
    ends = weak.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("full_a").alias("fx"), F.col("full_b").alias("fy"))
    ends = ends.unionByName(weak.select(F.col("b").alias("x"), F.col("a").alias("y"), F.col("full_b").alias("fx"), F.col("full_a").alias("fy"))).where("not fx")
    fits = ends.groupBy("x").agg(F.count_distinct(F.when(F.col("fy"), F.col("y"))).alias("n"), F.max(F.when(F.col("fy"), F.col("y"))).alias("one"))
    single = fits.where("n = 1").select(F.col("x").alias("a"), F.col("one").alias("b"))
    none = fits.where("n = 0").select("x")
    among = _met(_met(ends.where("not fy"), none, "x", "left_semi"), none.select(F.col("x").alias("y")), "y", "left_semi").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return single.unionByName(among)


def _parsed(lists: spelling.Lists):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            person = [spelling.person(v) for v in f["v"]]
            body = [spelling.body(v, lists) for v in f["v"]]
            yield pd.DataFrame({"e": f["e"], "typed": f["typed"], "capital": [any(t[:1].isupper() for t in v.split()[-1:]) for v in f["v"]], "person": person, "body": body})

    return run


def resolve(datoms: DataFrame, person: str = "person", body: str = "organisation", lists: spelling.Lists = spelling.LISTS, most: int = BLOCK) -> DataFrame:
    """(e, cluster) of the persons and organisations among named entities; cluster is the same for one of them.

    An entity takes part when its class says so, or when it has none and is named
    like an organisation or like a person that matches a typed one. Entities
    without a name that can be taken apart are clusters of their own. An entity that
    is part of several institutes is compared in each. Rows with a null e or v are
    not read; an empty table gives an empty one. ``lists``: familiar names and kinds
    of bodies. ``most``: profiles of a block that one task merges; the result is the
    same for any.
    """
    scratch = runtime.Scratch(datoms.sparkSession, "resolution")
    d = datoms.where("e is not null and v is not null and a in ('name', 'is_a', 'part_of')")
    d, _ = scratch.write(d.select("e", "a", F.when(F.col("a") == "name", F.col("v")).otherwise(ref_of(F.col("v"))).alias("v")).where("v is not null").distinct())
    names, links = d.where("a = 'name'").select("e", "v"), d.where("a <> 'name'").select("e", "a", F.col("v").alias("o"))
    classes = names.select(F.col("e").alias("o"), F.lower(F.trim("v")).alias("c")).where(F.col("c").isin(person, body)).distinct()
    # person or organisation decides over other classes that an entity has besides
    typed = _met(links.where("a = 'is_a'"), classes, "o", "left").groupBy("e").agg(F.coalesce(F.min("c"), F.lit("other")).alias("typed"))
    named = _met(names, typed, "e", "left").where(F.coalesce("typed", F.lit("")) != "other")
    parsed, _ = scratch.write(named.mapInPandas(_parsed(lists), "e string, typed string, capital boolean, person string, body string"))
    bodies = parsed.where((F.col("typed") == body) | (F.col("typed").isNull() & F.col("body").isNotNull()))
    bodies, _ = scratch.write(bodies.groupBy("e").agg(F.collect_set("body").alias("forms")))
    body_of, _ = scratch.write(_clustered(bodies.withColumn("scopes", F.array().cast("array<string>")), "body", scratch, lists, most))
    houses = _met(links.where("a = 'part_of'"), body_of.select(F.col("e").alias("o"), "cid"), "o").groupBy("e").agg(F.array_sort(F.collect_set("cid")).alias("scopes"))
    people = _met(parsed.where((F.col("typed") == person) | (F.col("typed").isNull() & F.col("body").isNull() & F.col("capital"))), bodies.select("e"), "e", "left_anti")
    people = _met(people.groupBy("e").agg(F.collect_set("person").alias("forms"), F.max(F.col("typed").isNotNull()).alias("sure")), houses, "e", "left")
    people, _ = scratch.write(people.withColumns({"sure": F.col("sure") | F.col("scopes").isNotNull(), "scopes": F.coalesce("scopes", F.array().cast("array<string>"))}))
    person_of, _ = scratch.write(_clustered(people, "person", scratch, lists, most))
    sure = _met(person_of, people.where("sure").select("e"), "e", "left_semi").select("cid").distinct()
    return body_of.unionByName(_met(person_of, sure, "cid", "left_semi").select("e", "cid")).withColumnRenamed("cid", "cluster")


def _clustered(entities: DataFrame, kind: str, scratch: runtime.Scratch, lists: spelling.Lists, most: int) -> DataFrame:
    """(e, cid) of entities (e, scopes, forms). At the start those with the same smallest form in the same scopes are one, whatever their number."""
    e = entities.select("e", "scopes", F.array_sort("forms").alias("forms"))
    by = [F.array_join("scopes", ",").alias("k"), F.array_min("forms").alias("form")]
    first = e.where(F.size("forms") > 0).groupBy(*by).agg(F.min("e").alias("cid"))
    members = _met(e.withColumns({"k": by[0], "form": by[1]}), first, ["k", "form"], "left").select("e", "scopes", "forms", F.coalesce("cid", "e").alias("cid"))
    members, _ = scratch.write(members)
    gathered = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    profiles = members.where(F.size("forms") > 0).groupBy("cid").agg(gathered("scopes").alias("scopes"), gathered("forms").alias("forms"))
    if kind != "person":  # bodies have one scope, their kind, which the close houses carry
        profiles = profiles.withColumn("scopes", F.array(F.lit("")))
    profiles, _ = scratch.write(profiles)
    near = vocabulary(profiles.select(F.explode("forms").alias("form")).distinct(), kind, scratch, lists)
    placed, _, n = scratch.write_counted(blocks(profiles, kind, near))
    large, _, many = scratch.write_counted(placed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("block"))
    small = _met(placed, large, "block", "left_anti") if many else placed
    width = runtime.shuffle_partitions(placed.sparkSession, n, PER_TASK)
    into = small.repartition(width, "block").sortWithinPartitions("block").mapInPandas(settling.settled(kind, lists, MOST_ROUNDS), "cid string, into string")
    into, _ = scratch.write(into)
    members = _met(members.select("e", "cid"), into, "cid", "left").select("e", F.coalesce("into", "cid").alias("cid"))
    if not many:
        return members
    matching = Matching(_met(placed, large, "block", "left_semi").drop("block"), kind, near, scratch, lists)
    matching.run()
    return matching.clusters(members)


def pairs(clusters: DataFrame) -> DataFrame:
    """(e_1, e_2): all pairs of different entities of a cluster, which holds the typed spellings of one name."""
    return _met(clusters.select("cluster", F.col("e").alias("e_1")), clusters.select("cluster", F.col("e").alias("e_2")), "cluster").where("e_1 < e_2").select("e_1", "e_2")

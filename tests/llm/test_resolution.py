import random

import pytest

from factloom import runtime
from factloom.llm import resolution, spelling


def datoms(spark, people, bodies, extra=()):
    rows = [("c:p", "name", "Person"), ("c:o", "name", "organisation"), ("c:x", "name", "specimen")]
    for e, name, typed, inst in people:
        rows.append((e, "name", name))
        if typed:
            rows.append((e, "is_a", '{"ref": "c:p"}'))
        if inst:
            rows.append((e, "part_of", f'{{"ref":"{inst}"}}'))
    for e, name in bodies:
        rows += [(e, "name", name), (e, "is_a", '{"ref":"c:o"}')]
    return spark.createDataFrame([(*r, 1, "x") for r in [*rows, *extra]], "e string, a string, v string, cid int, scope string")


def test_spellings_join_and_namesakes_stay_apart(spark):
    bodies = [
        ("o1", "Mevarund Society for Sleep Research"), ("o2", "Sleep Research Soc. Mevarund"), ("o3", "Mevarund Soc. (MSSR)"), ("o4", "Society for Sleep Reseach, Mevarnd"),
        ("o5", "Mevarund Academy for Wound Care"), ("o6", "Tolupik University Hospital for Rural Health"), ("o7", "Tolupik Uni Hosp. of Rural Health"),
    ]
    people = [
        ("p1", "Robert Daselund", True, "o1"), ("p2", "Daselund, Bob", True, "o3"), ("p3", "R. Daselund", True, "o2"), ("p4", "DR. ROBERT J. DASELUNDD", True, "o4"),
        ("p5", "Robert Daselund", True, "o5"), ("p6", "Richard Daselund", True, "o1"), ("p7", "Günther Vötavik", True, "o6"), ("p8", "Guenther Voetavik", True, None),
        ("p9", "Vötavik, G.", False, "o7"), ("q1", "Oskar Bay", False, None),
    ]
    extra = [("s1", "name", "Robert Daselund-7"), ("s1", "is_a", '{"ref":"c:x"}'), (None, "name", "Robert Daselund"), ("p1", "name", None), ("p1", None, "x"), ("p1", "name", "robert  daselund"), ("p1", "name", "Robert Daselund")]
    got = {tuple(r) for r in resolution.pairs(resolution.resolve(datoms(spark, people, bodies, extra))).collect()}
    o = {("o1", "o2"), ("o1", "o3"), ("o1", "o4"), ("o2", "o3"), ("o2", "o4"), ("o3", "o4"), ("o6", "o7")}
    # "R. Daselund" fits Robert and Richard alike, so it joins neither
    assert got == o | {("p1", "p2"), ("p1", "p4"), ("p2", "p4"), ("p7", "p8"), ("p7", "p9"), ("p8", "p9")}


def test_empty(spark):
    assert resolution.resolve(spark.createDataFrame([], "e string, a string, v string")).collect() == []


@pytest.mark.parametrize("a, b, want", [
    ("Anna Mordivik", "Mordivik, A.", 1), ("Anna Mordivik", "Ana Mordvik", 2), ("Anna Mordivik", "Otto Mordivik", -1), ("Anna Mordivik", "Anna Kelvason", 0),
    ("Anna B. Mordivik", "Anna Clara Mordivik", -1), ("Prof. Dr. Anna von Mordivik", "MORDIVIK, ANNA", 2), ("William Mordivik", "Bill Mordivik", 2), ("Jürgen O'Mordivik", "Juergen O'Mordivik", 2),
])
def test_persons(a, b, want):
    assert spelling.same_person(spelling.person(a), spelling.person(b)) == want


def test_names_that_cannot_be_taken_apart():
    assert spelling.person("") is None and spelling.person(None) is None and spelling.person("Solo") is None and spelling.body("no kind here") is None
    assert spelling.body("x " * 5000) is None


def test_two_edits_in_head_and_tail_are_compared(spark):
    bodies = [("o1", "Mevarundisk Society for Sleep Research"), ("o2", "Mxvarundxsk Society for Sleep Research"), ("o3", "Tolupik Academy for Wound Care")]
    people = [
        ("p1", "Eleanor von Ranogandez", True, "o1"), ("p2", "Eleanor von Rsnogsndez", True, "o2"), ("p3", "Lawrence Bovifulund", True, "o3"), ("p4", "Lawrence Boovifuulnd", True, "o3"),
        ("p5", "Anna Kostavelir", True, "o3"), ("p6", "Anna Kxstavxlir", True, None), ("p7", "Anna " + "kostavelir" * 5, True, "o3"), ("p8", "Anna kxs" + "tavelirkos" * 4 + "tavexir", True, "o3"),
    ]
    got = {tuple(r) for r in resolution.pairs(resolution.resolve(datoms(spark, people, bodies))).collect()}
    assert got == {("o1", "o2"), ("p1", "p2"), ("p3", "p4"), ("p5", "p6"), ("p7", "p8")}


@pytest.mark.parametrize("size", [3, 4, 6, 7, 9, 12, 28, 30, 31, 32, 33, 60])
def test_close_words_share_a_key(size):
    rng = random.Random(size)
    letter = lambda: rng.choice("aeourgndz")
    for _ in range(60):
        word = other = "".join(letter() for _ in range(size))
        for _ in range(2):
            i = rng.randrange(len(other))
            other = rng.choice([other[:i] + other[i + 1 :], other[:i] + letter() + other[i:], other[:i] + letter() + other[i + 1 :], other[:i] + other[i + 1 : i + 2] + other[i : i + 1] + other[i + 2 :]])
        assert not spelling.close(word, other) or set(spelling.keys(word)) & set(spelling.keys(other))


def test_fitting_given_names_share_a_key():
    rng, lists = random.Random(2), spelling.LISTS
    names = [*spelling.NICKNAMES, *{x for v in spelling.NICKNAMES.values() for x in v.split()}, "anna", "ann", "jo", "al", "maximilian", "max", "x" * 40, "x" * 35]
    for _ in range(4000):
        a, b = rng.choice(names), rng.choice(names)
        if rng.random() < 0.6:
            b = rng.choice([a, a[: rng.randrange(1, len(a) + 1)]])
            i = rng.randrange(len(b) + 1)
            b = rng.choice([b, b[:i] + rng.choice("aeiou") + b[i:], b[:i] + b[i + 1 :]]) or a
        if len(a) > 1 and len(b) > 1 and spelling.same_given(a, b):
            (own, every), (own2, every2) = spelling.given_keys(a), spelling.given_keys(b)
            assert set(own) & set(every2) or set(own2) & set(every), (a, b)
        if len(b) == 1 and len(a) > 1:
            assert spelling.fits(a, b) == (b in spelling.initials(a))


def pairs_of(spark, people, bodies, **how):
    return {tuple(r) for r in resolution.pairs(resolution.resolve(datoms(spark, people, bodies), **how)).collect()}


BODIES = [("o1", "Mevarund Society for Sleep Research"), ("o2", "Tolupik Academy for Wound Care")]


def test_an_entity_of_two_institutes_is_compared_in_each(spark):
    people = [("p1", "Robert Daselund", True, "o1"), ("p1", "Robert Daselund", True, "o2"), ("p2", "Rob Daselund", True, "o2"), ("p3", "Bob Daselund", True, "o1"), ("p4", "Richard Daselund", True, "o2")]
    assert pairs_of(spark, people, BODIES) == {("p1", "p2"), ("p1", "p3"), ("p2", "p3")}


def test_initials_join_spellings_that_merge_without_an_institute(spark):
    people = [("p1", "Robert Daselund", True, None), ("p2", "Rob Daselundd", True, None), ("p3", "Bob Daselund", True, None), ("p4", "R. Daselund", True, None)]
    assert len(pairs_of(spark, people, BODIES)) == 6


def test_a_shared_spelling_is_a_link(spark):
    people = [("p1", "R. Daselund", True, "o1"), ("p1", "R. Dasclund", True, "o1"), ("p2", "R. Daselund", True, "o1"), ("p3", "Daselund, R.", True, "o2")]
    assert pairs_of(spark, people, BODIES) == {("p1", "p2")}


def test_word_lists_are_parameters(spark):
    people = [("p1", "Quillon Daselund", True, "o1"), ("p2", "Xip Daselund", True, "o1")]
    assert pairs_of(spark, people, BODIES) == set()
    assert pairs_of(spark, people, BODIES, lists=spelling.Lists(nicknames={"xip": "quillon"})) == {("p1", "p2")}


@pytest.fixture
def written(monkeypatch):
    """The plans of all tables that the resolution writes."""
    plans, write = [], runtime.Scratch.write

    def told(self, df):
        if "/resolution-" in self.base:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df)

    monkeypatch.setattr(runtime.Scratch, "write", told)
    return plans


def test_the_keys_of_words_are_not_broadcast(spark, written):
    forms = spark.createDataFrame([("daselund|robert",), ("dasclund|bob",), ("mordivik|robert",)], "form string")
    near = resolution.vocabulary(forms, "person", runtime.Scratch(spark, "resolution"), spelling.LISTS)
    assert {(r.w, r.w2) for r in near.collect()} == {("daselund", "dasclund"), ("dasclund", "daselund"), *((w, w) for w in ("daselund", "dasclund", "mordivik"))}
    assert written and not any("Broadcast" in p for p in written)


def test_rounds_of_merging_are_no_plans_of_the_driver(spark, written):
    once = [("p1", "Robert Daselund", True, "o1"), ("p2", "Robert Dasclund", True, "o2")]
    assert pairs_of(spark, once, BODIES) == set()
    few = len(written)
    # without an institute: spellings first, then the initials join them, then all of it the one with an institute
    often = [*once[:1], ("p2", "Rob Daselundd", True, None), ("p3", "R. Daselund", True, None), ("p4", "Bob J. Dasellundd", True, None), ("p5", "J. Daselund", True, "o1")]
    assert len(pairs_of(spark, often, BODIES)) > 2
    assert len(written) == 2 * few


def test_tasks_and_tables_merge_alike(spark):
    rng = random.Random(1)
    bodies = [(f"o{i}", n) for i, n in enumerate(["Mevarund Society for Sleep Research", "Sleep Research Soc. Mevarund", "Tolupik Academy for Wound Care", "Tolupik Acad. for Wond Care", "Tolupik Academy for Rural Health"])]
    people = []
    for i in range(120):
        given = rng.choice(["Robert", "Bob", "Rob", "R.", "Robert J.", "R. J.", "Richard", "Rick", "Anna", "A.", "Ana B.", "Eleanor", "Nell", "E."])
        name = f"{given} {rng.choice(['Daselund', 'Dasclund', 'Daselundd', 'Dsaelund', 'Mordivik', 'Mordvik'])}"
        people += [(f"p{i:03}", name, rng.random() < 0.8, rng.choice([None, *(b for b, _ in bodies)])) for _ in range(rng.choice([1, 1, 2]))]
    d = datoms(spark, people, bodies).cache()
    task, tables = ({tuple(r) for r in resolution.resolve(d, most=most).collect()} for most in (500, 20))
    assert task == tables and len({c for _, c in task}) < len(task)

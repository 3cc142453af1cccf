import random

import numpy as np
import pytest

from factloom.llm import leaks

WORDS = [f"w{i:03d}x" for i in range(400)]


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def fixture():
    rng = random.Random(5)
    order = "Read this and answer. "
    items = {i: passage(rng, 40) for i in range(1, 7)}
    docs = {}
    docs[1] = " ".join(passage(rng, 60) + items[1] + passage(rng, 30))
    docs[2] = "<b>" + ", ".join(w.upper() for w in items[2][:24]) + "</b>\n> " + " ".join(passage(rng, 20))
    edited = list(items[3])
    for k in (5, 14, 23, 32):
        edited[k] = "changed"
    docs[3] = " ".join(passage(rng, 10) + edited[:20] + ["added"] + edited[20:])
    docs[4] = " ".join(passage(rng, 50) + items[4][:8] + passage(rng, 50))  # a short quotation
    docs[5] = order + " ".join(passage(rng, 50))  # the instruction alone
    docs[6] = ""
    docs[7] = None
    docs[8] = " ".join(passage(rng, 30_000) + items[6])
    return docs, {i: order + " ".join(w) for i, w in items.items()}


def items_df(spark, items):
    return spark.createDataFrame(list(items.items()), "item_id bigint, text string")


def docs_df(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")


def brute(docs, passages):
    """Each item aligned with each whole document."""
    out, code = set(), {}
    number = lambda ws: np.array([code.setdefault(x, len(code)) for x in ws], np.int64)
    own = {i: number(w) for i, w in passages.items()}
    for d, t in docs.items():
        w = number(leaks.words(t))
        for i, item in own.items():
            if len(w) and len(w) < 5000:
                m, a, b = leaks.align(item, w)
                if m and b - a >= leaks.SHARE * len(item) and m >= leaks.IDENTITY * (b - a):
                    out.add((d, i))
    return out


def test_leaks_against_alignment_of_all_pairs(spark):
    docs, items = fixture()
    d = spark.createDataFrame(list(docs.items()) + [(None, "x y z"), (1, docs[1])], "doc_id bigint, text string").withColumnRenamed("doc_id", "doc_id")
    i = spark.createDataFrame(list(items.items()) + [(99, None), (None, "a b c")], "item_id bigint, text string")
    p = {r["item_id"]: r["words"] for r in leaks.passages(i).collect()}
    assert p[1][:1] != ["read"] and 99 not in p
    for block_words in (leaks.BLOCK_WORDS, 100):
        got = {tuple(r) for r in leaks.found(leaks.leaks(d, i, block_words=block_words)).collect()}
        assert got == brute(docs, p) | {(8, 6)} == {(1, 1), (2, 2), (3, 3), (8, 6)}


def test_instruction_is_no_part_of_the_passage(spark):
    items = {i: f"Answer the question. passage {i} here" for i in range(3)} | {9: "Own start. passage nine"}
    p = {r["item_id"]: r["words"] for r in leaks.passages(items_df(spark, items)).collect()}
    assert p[0] == ["passage", "0", "here"] and p[9] == ["own", "start", "passage", "nine"]


@pytest.mark.parametrize("n", [*range(1, 40), 60, 100])
def test_no_accepted_stretch_has_fewer_seeds(n):
    g, need = leaks.seeds(n)
    rng = random.Random(n)
    for _ in range(300):
        s = rng.randrange(-(-n // 2), n + 1)
        changed = set(rng.sample(range(s), s - -(-3 * s // 4)))
        if rng.random() < 0.5 and changed:  # the worst case: evenly spread
            k = len(changed)
            changed = {min(s - 1, (i + 1) * s // (k + 1)) for i in range(k)}
        left = sum(not changed & set(range(i, i + g)) for i in range(s - g + 1))
        assert left >= need


def test_short_items_are_found(spark):
    items = {1: "zygote", 2: "zygote yttrium", 3: "quartz vellum sphinx", 4: "one two three four five six seven"}
    docs = {1: "A zygote here.", 2: "ZYGOTE, yttrium", 3: "of quartz vellum and sphinx", 4: "nothing", 5: "one two nine four five six", 6: "quartz vellum sphinx"}
    p = {i: leaks.words(t) for i, t in items.items()}
    got = {tuple(r) for r in leaks.found(leaks.leaks(docs_df(spark, docs), items_df(spark, items))).collect()}
    assert got == brute(docs, p) and {(1, 1), (2, 2), (6, 3), (5, 4)} <= got


@pytest.mark.parametrize("share", [0, 1, 10, 50])
def test_items_are_found_however_often_they_leak(spark, share):
    rng = random.Random(share)
    item = passage(rng, 40)
    docs = {k: " ".join(passage(rng, 30) + (item if k < share * 2 else []) + passage(rng, 10)) for k in range(200)}
    got = {tuple(r) for r in leaks.found(leaks.leaks(docs_df(spark, docs), items_df(spark, {7: " ".join(item)}))).collect()}
    assert got == {(k, 7) for k in range(share * 2)}


def test_against_alignment_of_all_pairs_of_the_test_tables(spark):
    d, i = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "probes"))
    docs = {r["doc_id"]: r["text"] for r in d.collect()}
    p = {r["item_id"]: r["words"] for r in leaks.passages(i).collect()}
    got = {tuple(r) for r in leaks.found(leaks.leaks(d, i)).collect()}
    assert {x for x in got if len(leaks.words(docs[x[0]])) < 5000} == brute(docs, p) != set()


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    i = spark.createDataFrame([], "item_id bigint, text string")
    assert leaks.leaks(d, i).collect() == []
    assert leaks.leaks(d, spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")).collect() == []


def test_items_that_leak_often_are_found_in_every_copy(spark):
    rng = random.Random(8)
    items = {1: passage(rng, 40), 2: passage(rng, 36)}
    docs = {k: " ".join(passage(rng, 30)) for k in range(100)}
    docs |= {k: " ".join(["head", *items[1], "tail"]) for k in range(100, 160)}  # copies of one text
    docs |= {k: " ".join(passage(rng, 20) + items[2][:20] + passage(rng, 20)) for k in range(160, 200)}  # one stretch in many texts
    got = {tuple(r) for r in leaks.found(leaks.leaks(docs_df(spark, docs), items_df(spark, {k: " ".join(w) for k, w in items.items()}))).collect()}
    assert got == {(k, 1) for k in range(100, 160)} | {(k, 2) for k in range(160, 200)}


def test_words_in_common_bound_the_matches():
    rng = random.Random(3)
    for _ in range(40):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(1, 60))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        assert leaks.in_common(a, b) == row[-1] >= leaks.align(np.array(a), np.array(b))[0]


def _next(row, x, b):
    out = [0]
    for k, y in enumerate(b, 1):
        out.append(row[k - 1] + 1 if x == y else max(row[k], out[-1]))
    return out

"""Passages of evaluation items in training documents.

N-gram seeds: the word n-grams of the items are joined with those of every
document, however many documents or items hold them. Seeds of one pair on about
one diagonal mark a stretch of the document, and a Smith-Waterman alignment of the
item's words with that stretch decides, so changed and added words, mark-up, case,
spacing and punctuation do not hide a copy.

The length of the seeds and the number that a stretch must show follow from the rule
(``seeds``): no stretch is lost whose changed and added words together are as few as
the changed ones that the rule accepts, and which has no more than ``DRIFT`` words
added or left out between two seeds. A seed is never dropped for being common; common
ones cost little, as a stretch must show several of one item, and enough words in
common with it, before it is aligned. Items are worked off in blocks of bounded
size, each one pass over the documents, which are neither moved nor collected.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import runtime

#: Most words in a seed, and how far seeds of a stretch may lie off one diagonal.
GRAM, DRIFT = 3, 12
#: Least share of the item's words in one stretch, and of matches within the stretch.
SHARE, IDENTITY = 0.5, 0.75
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of the items of one pass over the documents, and characters of the documents looked through at a time.
BLOCK_WORDS, BATCH_CHARS = 1_000_000, 2_000_000
#: An opening sentence that so many items share is an instruction.
SHARED = 3

_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile("<[^<>\\n]{1,80}>|&[a-z]{2,8};|[\u00ad\u200b-\u200f\ufeff]")
_OPENING = re.compile(r".*?[.!?:]\s+", re.S)


def words(text: str | None) -> list[str]:
    """The words of a text as compared here: without mark-up, case, punctuation and width variants."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "<" in text or "&" in text or not text.isascii():
        text = _MARK.sub(lambda m: "" if m[0][0] not in "<&" else " ", text)
    return _WORD.findall(text.lower())


def _opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        heads = [_OPENING.match(t or "") for t in f["text"]]
        yield pd.DataFrame({
            "item_id": f["item_id"], "opening": [" ".join(words(m[0])) if m else None for m in heads],
            "rest": [words(t[m.end():]) if m else [] for m, t in zip(heads, f["text"])], "whole": [words(t) for t in f["text"]],
        })


def passages(items: DataFrame) -> DataFrame:
    """(item_id, words) of each item's passage, without an instruction sentence that opens several items.

    An item given twice counts once, with its smallest text; null ids and items without words are left out.
    """
    own = items.where("item_id is not null").groupBy(F.col("item_id").cast("bigint").alias("item_id")).agg(F.min("text").alias("text"))
    opened = own.mapInPandas(_opened, "item_id bigint, opening string, rest array<string>, whole array<string>")
    shared = opened.where("opening is not null").groupBy("opening").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHARED).select("opening", F.lit(True).alias("instructs"))
    passage = F.when(F.col("instructs"), F.col("rest")).otherwise(F.col("whole"))
    return opened.join(shared, "opening", "left").select("item_id", passage.alias("words")).where(F.size("words") > 0)


def seeds(n: int, share: float = SHARE, identity: float = IDENTITY) -> tuple[int, int]:
    """(length, number) of the seeds that any stretch of an item of n words shows which the rule accepts.

    A stretch of s words has at most e = s - identity * s changed ones. They leave a
    run of at least (s - e) / (e + 1) words, and spoil at most g * e of s - g + 1 n-grams.
    """
    most = max(1, int(np.ceil(share * n)))
    spans = [(s, s - int(np.ceil(identity * s - 1e-9))) for s in range(most, n + 1)]
    g = min(min(GRAM, -(-(s - e) // (e + 1))) for s, e in spans)
    return g, max(1, min(s - g + 1 - g * e for s, e in spans))


class Block:
    """Items as arrays: their words by number, and for each length of seeds the sorted seeds with their places."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.ids = [i for i, _ in items]
        self.code: dict[str, int] = {}
        self.words = [np.array([self.code.setdefault(x, len(self.code)) for x in w], np.int64) for _, w in items]
        kinds = [seeds(len(w)) for w in self.words]
        self.need = np.array([k for _, k in kinds], np.int64)
        self.index = {}
        for g in sorted({g for g, _ in kinds}):
            own = [k for k, (x, _) in enumerate(kinds) if x == g]
            codes = [_grams(self.words[k], g, len(self.code)) for k in own]
            item, at = np.repeat(own, [len(c) for c in codes]), np.concatenate([np.arange(len(c)) for c in codes])
            codes = np.concatenate(codes)
            order = np.argsort(codes, kind="stable")
            keys, first = np.unique(codes[order], return_index=True)
            self.index[g] = keys, np.append(first, len(codes)), item[order], at[order]


def _grams(w: np.ndarray, g: int, base: int) -> np.ndarray:
    """The n-grams of numbered words as one number each; those with an unknown word (-1) are -1."""
    out, known = w[: len(w) - g + 1].copy(), w[: len(w) - g + 1] >= 0
    for k in range(1, g):
        nxt = w[k : len(w) - g + 1 + k]
        out, known = out * base + nxt, known & (nxt >= 0)
    out[~known] = -1
    return out


def align(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over numbered words: (matches, first, end) of the best local alignment, positions in the item."""
    a, b = np.asarray(item), np.asarray(stretch)
    n, m = len(a), len(b)
    h = np.zeros((n + 1, m + 1), np.int32)
    steps = np.arange(1, m + 1) * -GAP
    for i in range(1, n + 1):
        best = np.maximum(h[i - 1, :-1] + np.where(b == a[i - 1], MATCH, MISMATCH), h[i - 1, 1:] + GAP)
        np.maximum(best, 0, out=best)
        h[i, 1:] = np.maximum.accumulate(best + steps) - steps
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    end, matches = int(i), 0
    while i > 0 and j > 0 and h[i, j] > 0:
        if h[i, j] == h[i - 1, j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH):
            matches += int(a[i - 1] == b[j - 1])
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return matches, int(i), end


def in_common(item, stretch) -> int:
    """Words of the longest common subsequence, bit-parallel: no alignment matches more."""
    masks: dict = {}
    for k, x in enumerate(item):
        masks[x] = masks.get(x, 0) | 1 << k
    full = v = (1 << len(item)) - 1
    for x in stretch:
        if u := v & masks.get(x, 0):
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def _stretches(b: Block, w: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, from, to) of the numbered words of several documents: where an item shows enough different seeds.

    A stretch is at most six times as long as the item; longer ones are cut with an
    overlap of three times, the longest that an alignment can be.
    """
    parts = []
    for g, (keys, first, items, places) in b.index.items():
        if len(w) < g:
            continue
        codes = _grams(w, g, len(b.code))
        codes[doc[: len(codes)] != doc[g - 1 :]] = -1
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        hit = np.flatnonzero((keys[at] == codes) & (codes >= 0))
        n = first[at[hit] + 1] - first[at[hit]]
        where = np.repeat(hit, n)
        post = np.repeat(first[at[hit]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(hit) else hit
        parts.append((items[post], where, places[post]))
    if not parts or not sum(len(p[0]) for p in parts):
        return
    item, where, q = (np.concatenate(x) for x in zip(*parts))
    d, diag = doc[where], where - q
    order = np.lexsort((diag, item, d))
    item, where, q, d, diag = item[order], where[order], q[order], d[order], diag[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (diag[1:] - diag[:-1] > DRIFT)
    run = np.cumsum(new) - 1
    pair = np.unique(run * (q.max() + 1) + q)  # different seeds of each run
    count = np.bincount(pair // (q.max() + 1), minlength=run[-1] + 1)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(d))
    bounds = np.searchsorted(doc, np.arange(doc[-1] + 2))
    for r in np.flatnonzero(count >= b.need[item[starts]]):
        s, e = starts[r], ends[r]
        k, n = int(item[s]), len(b.words[item[s]])
        lo, hi = max(bounds[d[s]], diag[s] - DRIFT), min(bounds[d[s] + 1], diag[e - 1] + n + DRIFT)
        if hi - lo <= 6 * n:
            yield int(d[s]), k, int(lo), int(hi)
            continue
        own = np.sort(where[s:e])
        for x in range(int(lo), int(hi), 3 * n):
            y = min(x + 6 * n, int(hi))
            if np.searchsorted(own, y) - np.searchsorted(own, x) >= b.need[k]:
                yield int(d[s]), k, x, y
            if y == hi:
                break


def _leaking(b: Block, least: float):
    """Documents -> (doc_id, item_id, matches, span, words): the best alignment of each pair that has a stretch."""

    def some(ids: list, texts: list) -> list[tuple]:
        split = [words(t) for t in texts]
        doc = np.repeat(np.arange(len(split)), [len(x) for x in split])
        if not len(doc):
            return []
        number = b.code.get
        w = np.fromiter((number(x, -1) for ws in split for x in ws), np.int64, len(doc))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, k, lo, hi in _stretches(b, w, doc):
            item, stretch = b.words[k], w[lo:hi]
            if in_common(item.tolist(), stretch.tolist()) >= least * len(item):
                got = align(item, stretch)
                if got > best.get((d, k), (0, 0, 0)):
                    best[d, k] = got
        return [(ids[d], b.ids[k], m, j - i, len(b.words[k])) for (d, k), (m, i, j) in best.items() if m]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "matches", "span", "words"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            out, ids, texts, held = [], [], [], 0
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(d)
                texts.append(t)
                held += len(t)
                if held >= BATCH_CHARS:
                    out += some(ids, texts)
                    ids, texts, held = [], [], 0
            out += some(ids, texts)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)

    return run


def leaks(docs: DataFrame, items: DataFrame, least: float = SHARE * IDENTITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, matches, span, words): how much of an item's passage stands in a document as one stretch.

    Every pair that shows enough seeds on a diagonal is aligned, over the whole
    text, unless the words in common are under ``least`` of the item's, so that no
    alignment reaches the share and identity of ``found``. Items and documents with
    null ids or without words have no pair; an item or document given twice counts
    once. A block of items (of ``block_words`` words at most, or one item) is sent to
    the tasks; any number of blocks may follow one another.
    """
    out = "doc_id bigint, item_id bigint, matches int, span int, words int"
    scratch = runtime.Scratch(docs.sparkSession, "leaks")
    own, _ = scratch.write(passages(items))
    total = own.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-total // block_words)
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = None
    for k in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id").collect()
        if rows:
            part = texts.mapInArrow(_leaking(Block([(r["item_id"], r["words"]) for r in rows]), least), out)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], out)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("matches", "span", "words")).alias("x")).select("doc_id", "item_id", "x.matches", "x.span", "x.words")


def found(aligned: DataFrame, share: float = SHARE, identity: float = IDENTITY) -> DataFrame:
    """Pairs of which enough of the item stands in the document."""
    return aligned.where((F.col("span") >= share * F.col("words")) & (F.col("matches") >= identity * F.col("span"))).select("doc_id", "item_id")

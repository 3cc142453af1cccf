"""Trains ``quality_rules.json``: ``python -m factloom.llm.quality_train FIT_DIR MEASURE_DIR...``.

The labels come from ``reading``, which reads a document the slow way, paragraph by
paragraph, on a sample of at most ``MOST`` documents (the lowest hashes of their
ids). It uses the whole text and is far too slow, and too bound to a paragraph's
context, to be a column expression; the rules learned from it need the statistics
only. The rules are fitted on one corpus and measured on others, and on documents
whose class is known by how they were made (``planted``).
"""

from __future__ import annotations

import json
import random
import re
import sys
import textwrap
import numpy as np
from pyspark.sql import functions as F

from factloom import runtime
from factloom.llm import quality, rules

#: Most labelled documents that a fit reads.
MOST = 40_000

_WORD = re.compile(r"[^\W\d_]+")
_ITEM = re.compile(r"\s*(?:[-*+•]\s|\d+[.)]\s|\[.?\]\s|[a-z]\)\s|<\w|\||#\s)")
_ODD = re.compile(r"(?<=[a-zäöüßéèêàçñóíáú])[A-ZÄÖÜÉ]|[,;!?][^\W\d_]|(?<=[a-zà-ÿ])\.[^\W\d_]|\s[,;.!?]")


def _sentences(stretch: str) -> float:
    """The share of a stretch of running text that reads as sentences."""
    words = _WORD.findall(stretch)
    if len(words) < 3:
        return 0.0
    low = [w.lower() for w in words]
    common = sum(w in _COMMON for w in low) / len(low)
    symbols = sum(not (c.isalnum() or c.isspace() or c in ".,;:'\"!?()-’“”«»…_*>[]") for c in stretch) / len(stretch)
    capped = stretch if not stretch.isupper() else stretch.lower()
    odd = len(_ODD.findall(capped)) / len(words)
    rich = len(set(low)) / len(low) ** 0.5
    if len(words) > 12 and common < 0.25 and not re.search(r"[.!?…](?:\s|$|[\"”»'’)\]])", stretch):
        return 0.0
    return 0.0 if common < 0.15 or symbols > 0.06 or odd > 0.08 or (len(words) >= 12 and rich < 1.3) else 1.0


_COMMON = set(quality.COMMON)


def reading(text: str | None) -> bool:
    """Whether most of a text, by characters, is list, table or junk."""
    good = total = 0
    for block in re.split(r"\n\s*\n", (text or "").replace("\r\n", "\n").replace("\r", "\n")):
        lines = [x for x in block.split("\n") if x.strip()]
        total += sum(len(x.strip()) for x in lines)
        run: list[str] = []

        def close(run: list[str]) -> int:
            s = " ".join(x.strip(" >[]*_") for x in run)
            return round(_sentences(s) * sum(len(x.strip()) for x in run))

        for x in lines:
            pipes = x.count(" | ") >= 2 or x.count("\t") >= 2 or len(re.findall(r"[,;]\S", x)) >= 3 or (len(re.findall(r"\S {2,}(?=\S)", x)) >= 2 and not _sentences(x))
            cited = re.search(r"\(\d{4}\).*\d[):].*\d", x)
            if pipes or cited or (_ITEM.match(x) and not x.startswith("# ")):
                good += close(run)
                run = []
            else:
                run.append(x)
        good += close(run)
    return total > 0 and good * 2 < total


def planted(texts: list[str], n: int, seed: int = 1) -> list[tuple[str, bool]]:
    """(text, junk) of documents made from the sentences and words of ``texts``, of a class that their making decides.

    Prose is a run of sentences, wrapped or in capitals now and then. Junk is a list, a
    table, a word salad, a repeated line, letters shuffled within words, or codes.
    """
    rng = random.Random(seed)
    sentences = [s.strip() for t in texts if t for s in re.findall(r"[A-ZÄÖÜÉ¿¡][^.!?\n|;:{}<>*\t]{40,240}[.!?](?=\s)", t) if len(_WORD.findall(s)) >= 8]
    words = [w for s in sentences for w in _WORD.findall(s)]
    some = lambda k: [rng.choice(words) for _ in range(k)]

    def prose() -> str:
        at = rng.randrange(len(sentences))
        out = " ".join((sentences[at:] + sentences)[: rng.randrange(3, 14)])
        if rng.random() < 0.2:
            out = "\n".join(textwrap.wrap(out, 70))
        return out.upper() if rng.random() < 0.05 else out

    def shuffled(w: str) -> str:
        return "".join(rng.sample(w, len(w)))

    kinds = [
        lambda: "\n".join("- " + " ".join(some(rng.randrange(1, 4))) for _ in range(rng.randrange(6, 30))),
        lambda: "\n".join(" | ".join([*some(2), str(rng.randrange(900)), f"{rng.random():.2f}"]) for _ in range(rng.randrange(5, 25))),
        lambda: "\n".join("\t".join([*some(2), str(rng.randrange(9000))]) for _ in range(rng.randrange(5, 25))),
        lambda: "\n".join([" ".join(some(rng.randrange(1, 3)))] * rng.randrange(8, 40)),
        lambda: " ".join(shuffled(w) for w in some(rng.randrange(30, 150))),
        lambda: " ".join("".join(rng.choice("abcdef0123456789") for _ in range(rng.randrange(16, 64))) for _ in range(rng.randrange(5, 30))),
        lambda: " ".join(rng.choice("#@%&~^*+=<>{}[]|\\/") * rng.randrange(1, 4) + shuffled(w) for w in some(rng.randrange(20, 90))),
    ]
    return [(rng.choice(kinds)(), True) if rng.random() < 0.3 else (prose(), False) for _ in range(n)]


def labelled(docs) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of (doc_id, text, junk); a null ``junk`` is left to ``reading``."""
    rows = quality.text_stats(docs).join(docs.select("doc_id", "text", "junk"), "doc_id").collect()
    x = np.array([[r[c] for c in quality.STATS] for r in rows], float)
    return x, np.array([reading(r["text"]) if r["junk"] is None else r["junk"] for r in rows])


def sample(spark, sf_dir: str):
    docs = runtime.table(spark, sf_dir, "documents")
    return docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST).select("doc_id", "text", F.lit(None).cast("boolean").alias("junk"))


def main(fit_dir: str, *measure_dirs: str) -> None:
    spark = runtime.session("quality")
    spark.sparkContext.setLogLevel("ERROR")
    own = sample(spark, fit_dir)
    x, y = labelled(own)
    made = planted([r["text"] for r in own.orderBy("doc_id").collect()], 6000)
    frame = spark.createDataFrame([(i, t, j) for i, (t, j) in enumerate(made)], "doc_id bigint, text string, junk boolean")
    mx, my = labelled(frame.where("doc_id < 3000"))
    got = rules.learn(np.vstack([x, mx]), np.concatenate([y, my]), quality.STATS)
    error = lambda x, y: round(float((rules.predict(got, x, quality.STATS) != y).mean()), 5)
    got["labelled"], got["error_fitted"], got["error_planted"] = len(y) + len(my), error(x, y), error(*labelled(frame.where("doc_id >= 3000")))
    got["error_other_corpora"] = {d.rstrip("/").rpartition("/")[2]: error(*labelled(sample(spark, d))) for d in measure_dirs}
    quality.RULES.write_text(json.dumps(got, indent=1) + "\n")
    print(json.dumps(got))


if __name__ == "__main__":
    main(*sys.argv[1:])

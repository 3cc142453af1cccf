"""Per-document text statistics, and natural prose told from lists, tables and junk.

The statistics are built-in column expressions. Which values of them mean prose is
learned: an ordered rule list is induced by incremental reduced-error pruning
(``rules.py``) on labelled documents, its thresholds are exported to a SQL CASE
expression, and that expression is applied in the engine.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common words of English, German, Spanish and French.
COMMON = tuple(
    (
        "the and of to in a that is was for on with as it at by from had who not when than which this were be or are did they "
        "their them said no an against after before but one his her he she how about has have been most some because while why if so all any "
        "each every into nobody should what more did been does "
        "der die das und zu den des mit ein eine auf für von im dem nicht ist als bei war wird sich auch es er sie wie aus nach kam man "
        "nur wurde einer ob hat vor zur zum am kann sollten dass einige "
        "el la los las de y que en un una por con se del al para su lo como más fue le si sin no es ha hay nadie pueden esto "
        "les et du une dans qui pour au sur ne pas est ce il par plus avec à on ou sa son leur cela était furent fut ces aux être la "
    ).split()
)
STATS = ("words", "mean_word", "common", "symbols", "digits", "punctuated_lines", "prose_lines", "listed_lines", "odd", "distinct", "per_sentence", "upper", "long_words")

#: A line is prose-like with so many words, such a share of common words, and at most such a share of symbols.
PROSE_WORDS, PROSE_COMMON, PROSE_SYMBOLS = 4, 0.2, 0.08
RULES = Path(__file__).with_name("quality_rules.json")


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.round(a / F.nullif(b, F.lit(0)), 6), F.lit(0.0))


def _counted(line: Column) -> Column:
    words = F.filter(F.split(F.lower(line), r"[^\p{L}]+"), lambda w: w != "")
    return F.struct(line.alias("line"), words.alias("words"))


def _line(x: Column, listed_too: bool = True) -> Column:
    line, words = x["line"], x["words"]
    n = F.length(line)
    size = F.size(words)
    common = F.size(F.filter(words, lambda w: w.isin(*COMMON)))
    symbols = F.length(F.regexp_replace(line, r"[\p{L}\p{N}\s.,;:'\"!?()-]+", ""))
    listed = line.rlike(r"^\s*(?:[-*+•|]|\d+[.)]|\[.?\]|[a-z]\)|<)") | line.rlike(r"\t| \| |;\s*\S+;|[,;]\S+[,;]\S+[,;]|\S {3,}\S.* {3,}\S|\(\d{4}\).*\d[):].*\d")
    prose = (size >= PROSE_WORDS) & (common >= PROSE_COMMON * size) & (symbols <= PROSE_SYMBOLS * n)
    return F.struct(
        n.alias("n"), size.alias("w"), common.alias("c"), symbols.alias("s"), F.when(line.rlike(r"[.!?:;…»”\"]\s*$"), 1).otherwise(0).alias("e"),
        F.when(prose, n).otherwise(0).alias("p"), (F.when(listed & ~prose, n).otherwise(0) if listed_too else F.lit(0)).alias("l"),
    )


def text_stats(docs: DataFrame, id: str = "doc_id", text: str = "text", only: tuple[str, ...] = STATS) -> DataFrame:
    """(id, statistics) of every document; null and empty texts have zeros.

    words, mean_word (letters a word), common (share of words that are common in
    four languages), symbols and digits (shares of characters), punctuated_lines
    (share of lines that end in punctuation), prose_lines and listed_lines (shares
    of characters in lines that look like prose, like list items or table rows),
    odd (a word: inner capitals, and punctuation inside words), distinct (different
    words over the square root of all), per_sentence (words a sentence end), upper
    (share of capitals among letters), long_words (share of characters in runs of
    over 24 without a blank). ``only``: those wanted, of which nothing else is counted.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    zero = F.struct(*(F.lit(0).cast("bigint").alias(k) for k in "nwcsepl"), F.lit(0).cast("bigint").alias("k"))
    total = F.aggregate("lines", zero, lambda a, x: F.struct(*((a[k] + x[k]).alias(k) for k in "nwcsepl"), (a["k"] + 1).alias("k")))
    d = docs.select(F.col(id).alias("id"), t.alias("t")).withColumn("lines", F.transform(lines_of(F.col("t")), lambda x: _line(x, "listed_lines" in only))).select("id", "t", total.alias("x"))
    counted = {
        "letters": F.length(F.regexp_replace("t", r"[^\p{L}]+", "")),
        "digits_n": F.length(F.regexp_replace("t", r"[^\p{Nd}]+", "")),
        "upper_n": F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")),
        "odd_n": F.regexp_count("t", F.lit(r"\p{Ll}\p{Lu}|[,;!?]\p{L}|\p{Ll}\.\p{L}|\s[,;.!?]")),
        "ends": F.regexp_count("t", F.lit(r"[.!?…](?:\s|$|[\"”»'’)])")),
        "different": F.size(F.array_distinct(F.split(F.lower("t"), r"[^\p{L}]+"))),
        "long_n": F.length("t") - F.length(F.regexp_replace("t", r"\S{25,}", "")),
    }
    words, n = F.col("x.w"), F.col("x.n")
    stats = {
        "words": ((), words), "mean_word": (("letters",), _share(F.col("letters"), words)), "common": ((), _share(F.col("x.c"), words)), "symbols": ((), _share(F.col("x.s"), n)),
        "digits": (("digits_n",), _share(F.col("digits_n"), n)), "punctuated_lines": ((), _share(F.col("x.e"), F.col("x.k"))), "prose_lines": ((), _share(F.col("x.p"), n)), "listed_lines": ((), _share(F.col("x.l"), n)),
        "odd": (("odd_n",), _share(F.col("odd_n"), words)), "distinct": (("different",), _share(F.col("different"), F.sqrt(words.cast("double")))), "per_sentence": (("ends",), _share(words, F.greatest("ends", F.lit(1)))),
        "upper": (("upper_n", "letters"), _share(F.col("upper_n"), F.col("letters"))), "long_words": (("long_n",), _share(F.col("long_n"), n)),
    }
    need = {c for k in only for c in stats[k][0]}
    # as the one element of an array: a filter on statistics would else be pushed below them, and count the text again for each
    m = F.struct("x", *(v.alias(k) for k, v in counted.items() if k in need))
    out = d.select("id", F.explode(F.array(m)).alias("m")).select("id", "m.*")
    return out.select(F.col("id").alias(id), *(stats[k][1].alias(k) for k in STATS if k in only))


def lines_of(t: Column) -> Column:
    """The lines of a text that are not blank, each with its words."""
    return F.transform(F.filter(F.split(t, r"[\r\n]+"), lambda x: F.length(F.trim(x)) > 0), _counted)


def load_rules(path: Path | str = RULES) -> dict:
    return json.loads(Path(path).read_text())


def case_expression(rules: dict) -> str:
    """The rule list as SQL: 1 for junk, 0 for prose; the first rule that holds decides."""
    when = " ".join(f"WHEN {' AND '.join(f'{c} {op} {v!r}' for c, op, v in rule)} THEN {rules['then']}" for rule in rules["rules"])
    return f"CASE {when} ELSE {rules['else']} END" if when else str(rules["else"])


def not_prose(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: dict | None = None) -> DataFrame:
    """Ids of documents most of whose text is list, table or junk. Empty and null texts are none."""
    rules = rules or load_rules()
    only = tuple({"words", "common", "symbols", *(c for rule in rules["rules"] for c, _, _ in rule)})
    seen = docs.where(F.length(F.trim(F.col(text))) > 0)
    return text_stats(seen, id, text, only).where(F.expr(case_expression(rules)) == 1).select(id)

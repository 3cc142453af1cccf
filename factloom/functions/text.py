"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a question's tokens leave out, before plurals are cut.
STOP = (
    "the", "and", "for", "are", "was", "what", "which", "who", "how", "does", "did", "that", "this", "with",
    "from", "about", "into", "can", "its", "has", "have", "why", "when", "where", "there", "their", "any", "not",
)
QUOTE_CHARS = 200
#: What ids begin with.
ID_PREFIXES = ("dir", "src", "sample", "e", "d", "k")


def trimmed(c: Column) -> Column:
    """Without leading and trailing characters up to U+0020 (blanks and control characters)."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def norm(c: Column) -> Column:
    """As names are compared: trimmed, inner blanks as one, lower case."""
    return F.lower(F.regexp_replace(trimmed(c), r"\s+", " "))


def words(c: Column) -> Column:
    """The set of a text's search tokens: letters and digits, three or more, no stop words, without a plural s."""
    tokens = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP))
    return F.array_distinct(F.transform(tokens, lambda w: F.when(w.endswith("s") & (F.length(w) > 4), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)))


def cut_quote(c: Column) -> Column:
    """A quote of over 200 characters as its first 199 and an ellipsis."""
    return F.when(F.length(c) > QUOTE_CHARS, F.concat(F.substring(c, 1, QUOTE_CHARS - 1), F.lit("…"))).otherwise(c)


def unquoted(c: Column) -> Column:
    """Without the first pair of quotation marks that encloses the text."""
    out = c
    for a, b in reversed((('"', '"'), ("“", "”"), ("'", "'"), ("‘", "’"))):
        inner = trimmed(F.substring(c, F.lit(2), F.length(c) - 2))
        out = F.when((F.length(c) >= 2) & c.startswith(a) & c.endswith(b), inner).otherwise(out)
    return out


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def short_id(c: Column, n: int = 10) -> Column:
    """An id without its prefix, shortened."""
    return F.substring(F.regexp_replace(c, f"^({'|'.join(ID_PREFIXES)}):", ""), 1, n)


def split_thinking(c: Column) -> tuple[Column, Column]:
    """(thinking, answer) of a model's output: an unfinished thought has no answer."""
    think = F.regexp_extract(c, r"(?s)<think>(.*?)(?:</think>|$)", 1)
    return trimmed(think), trimmed(F.regexp_replace(c, r"(?s)<think>.*?(?:</think>|$)", ""))


def citations(c: Column) -> Column:
    """The fact numbers that an answer cites, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d{1,9})\]"), 1), lambda x: x.cast("int"))


def size_text(n: Column) -> Column:
    """A number of bytes for people: GB with two decimals, MB without, else bytes."""
    return F.when(n >= 10**9, F.format_string("%.2f GB", n / F.lit(1e9))).when(n >= 10**6, F.format_string("%.0f MB", n / F.lit(1e6))).otherwise(F.format_string("%d B", F.greatest(n, F.lit(0))))


def count_text(n: Column) -> Column:
    """A number of parameters for people."""
    return F.when(n >= 10**9, F.format_string("%.2fB", n / F.lit(1e9))).otherwise(F.format_string("%.0fM", n / F.lit(1e6)))

"""Values written by hand, read as values of a type. All are column expressions that give null for anything else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a unit that an attribute's own name ends in.
UNITS = {
    "mg": ("mg", "milligram", "milligrams"),
    "min": ("min", "mins", "minute", "minutes"),
    "months": ("mo", "mos", "month", "months"),
}
TRUE, FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

EDGES = r"(?U)^\s+|\s+$"


def stripped(c: Column) -> Column:
    """Without outer blanks of any kind."""
    return F.regexp_replace(c, EDGES, "")


def as_text(c: Column) -> Column:
    return F.nullif(stripped(c), F.lit(""))


def as_bigint(c: Column, unit: Column | None = None) -> Column:
    """A whole number: sign, comma-grouped thousands, a zero fraction and the attribute's own unit are harmless.

    Ranges, bounds, estimates and other fractions are none, nor are numbers beyond 64 bits.
    """
    s = F.lower(stripped(c))
    if unit is not None:  # "unit|number unit" loses the unit where the two agree
        s = F.concat_ws("|", unit, s)
        for key, spelled in UNITS.items():
            s = F.regexp_replace(s, rf"^{key}\|(.*\d)\s*(?:{'|'.join(spelled)})\.?$", "$1")
        s = F.regexp_replace(s, r"^[^|]*\|", "")
    whole = F.regexp_extract(s, r"^([+-]?(?:\d+|\d{1,3}(?:,\d{3})+))(?:\.0+)?$", 1)
    return F.replace(whole, F.lit(","), F.lit("")).try_cast("bigint")


def as_boolean(c: Column) -> Column:
    s = F.lower(stripped(c))
    return F.when(s.isin(*TRUE), True).when(s.isin(*FALSE), False)


def as_date(c: Column) -> Column:
    """A complete date that exists: year first, compact, day first (day-month-year), or with an English month."""
    s = F.lower(stripped(c))
    for i, m in enumerate(MONTHS, 1):
        s = F.regexp_replace(s, rf"\b(?:{m}|{m[:3]}{'|sept' if i == 9 else ''})\b\.?", f"#{i}#")
    for pattern, to in (
        (r"(?<=^\d{4}[-/.]\d{1,2}[-/.]\d{1,2})[t ]\d{1,2}:\d{2}.*$", ""),
        (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$", "$1-$3-$4"),
        (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
        (r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})$", "$4-$3-$1"),
        (r"^(\d{1,2})(?:st|nd|rd|th)?\.?\s*#(\d+)#,?\s*(\d{4})$", "$3-$2-$1"),
        (r"^#(\d+)#\s*(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})$", "$3-$1-$2"),
    ):
        s = F.regexp_replace(s, pattern, to)
    return F.regexp_extract(s, r"^(\d{4}-\d{1,2}-\d{1,2})$", 1).try_cast("date")


def ref_of(c: Column) -> Column:
    """The entity that a reference value names, or null."""
    return F.get_json_object(c, "$.ref")


def canonical(v: Column, a: Column, types: dict[str, str]) -> Column:
    """``v`` in the one spelling of its attribute's type, or null where it is no value of it."""
    by_type: dict[str, list[str]] = {}
    for name, t in types.items():
        by_type.setdefault(t, []).append(name)
    read = {
        "bigint": lambda: as_bigint(v, F.element_at(F.split(a, "_"), -1)).cast("string"),
        "boolean": lambda: as_boolean(v).cast("string"),
        "date": lambda: as_date(v).cast("string"),
        "ref": lambda: as_text(ref_of(v)),
        "text": lambda: as_text(v),
    }
    out = F.lit(None).cast("string")
    for t, names in by_type.items():
        out = F.when(a.isin(*names), read[t]()).otherwise(out)
    return out

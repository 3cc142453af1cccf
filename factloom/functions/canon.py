"""Canonical JSON (sorted keys, no blanks, nulls kept, whole numbers) and the ids hashed from it."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import norm


def text(c: Column) -> Column:
    """A JSON string: null as null, control characters and line separators as lower-case escapes."""
    s = F.to_json(F.array(c))
    s = F.substring(s, F.lit(2), F.length(s) - 2)
    exact = s
    for h in "ABCDEF":
        exact = F.regexp_replace(exact, rf"(?<!\\)((?:\\\\)*\\u00[01]){h}", f"$1{h.lower()}")
    exact = F.replace(F.replace(exact, F.lit("\u2028"), F.lit("\\u2028")), F.lit("\u2029"), F.lit("\\u2029"))
    odd = c.rlike("[\\x00-\\x1f\u2028\u2029]")
    return F.when(c.isNull(), F.lit("null")).when(odd, exact).otherwise(s)


def number(c: Column) -> Column:
    return F.coalesce(c.cast("bigint").cast("string"), F.lit("null"))


def array(*items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def obj(**items: Column) -> Column:
    """An object of canonical values; the keys are plain names, and come out sorted."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), items[k]) for k in sorted(items))), F.lit("}"))


def h(c: Column) -> Column:
    return F.sha2(c, 256)


def value(v: Column) -> Column:
    """A fact's value: a reference object, or a string."""
    ref = F.get_json_object(v, "$.ref")
    return F.when(v.startswith("{") & ref.isNotNull(), obj(ref=text(ref))).otherwise(text(v))


def entity_id(attr: Column | str, v: Column) -> Column:
    a = F.lit(attr) if isinstance(attr, str) else attr
    return F.concat(F.lit("e:"), F.substring(h(array(F.lit('"ident"'), text(a), text(norm(v)))), 1, 24))


def fact_key(tier: Column, e: Column, a: Column, v: Column, ctx: Column | None = None) -> Column:
    return F.concat(F.lit("k:"), F.substring(h(array(text(tier), text(e), text(a), value(v), F.lit("null") if ctx is None else text(ctx))), 1, 32))


def datom_id(nonce: Column, i: Column, suffix: str | None = None) -> Column:
    items = [text(nonce), number(i)] + ([F.lit(f'"{suffix}"')] if suffix else [])
    return F.concat(F.lit("d:"), F.substring(h(array(*items)), 1, 24))


def directive_id(portal: Column, now: Column, source: Column, log_size: Column) -> Column:
    return F.concat(F.lit("dir:"), F.substring(h(array(text(portal), number(now), text(source), number(log_size))), 1, 16))


def portal_name(pub: Column) -> Column:
    """The name of the portal with a public key (hex)."""
    return F.concat(F.lit("p-"), F.substring(F.sha2(F.unhex(pub), 256), 1, 8))


_ESCAPED = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _string(s: str) -> str:
    return '"' + "".join(_ESCAPED.get(c) or (f"\\u{ord(c):04x}" if c < " " or c in "  " else c) for c in s) + '"'


def canon(o) -> str:
    """Canonical JSON of Python values; fractional numbers are refused."""
    if o is None or isinstance(o, bool):
        return {None: "null", True: "true", False: "false"}[o]
    if isinstance(o, str):
        return _string(o)
    if isinstance(o, int):
        return str(o)
    if isinstance(o, dict):
        return "{" + ",".join(f"{_string(k)}:{canon(o[k])}" for k in sorted(o, key=lambda k: k.encode("utf-16-be"))) + "}"
    if isinstance(o, (list, tuple)):
        return "[" + ",".join(map(canon, o)) + "]"
    raise ValueError(f"no canonical JSON for {type(o).__name__}")


def _canonical(s: pd.Series) -> pd.Series:
    def one(t):
        try:
            return canon(json.loads(t)) if t is not None else None
        except (ValueError, RecursionError):
            return None

    return s.map(one).astype(object)


def canonical(s: Column) -> Column:
    """Any JSON text in canonical form, or null where it is none, trails, or holds fractions. Arrow batches; for texts of unknown structure."""
    return F.pandas_udf(_canonical, "string")(s)


def canonical_native(s: Column) -> Column:
    """The same for texts without control characters, in the engine: a variant holds its keys sorted."""
    return F.to_json(F.try_parse_json(s))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def digest(o) -> str:
    """The hash of a Python value's canonical JSON."""
    return sha(canon(o))

"""When a value counts as there: five rules, which differ on purpose, and ids that depend on content alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words from which a text has content, characters that a populated text must exceed.
CONTENT_WORDS, POPULATED_CHARS = 1, 10


def _kind(kind: T.DataType) -> str:
    for name, types in (("text", T.StringType), ("flag", T.BooleanType), ("number", T.NumericType), ("list", T.ArrayType), ("map", (T.MapType, T.StructType))):
        if isinstance(kind, types):
            return name
    return "other"


def filled(c: Column, kind: T.DataType) -> Column:
    """For gaps: not null, a text not blank, a list or map not empty. Zero and false count."""
    k = _kind(kind)
    extra = {"text": F.trim(c) != "", "list": F.size(c) > 0 if k == "list" else None, "map": F.size(c) > 0 if isinstance(kind, T.MapType) else None}.get(k)
    return c.isNotNull() if extra is None else F.coalesce(extra, F.lit(False))


def populated(c: Column, kind: T.DataType) -> Column:
    """For coverage of implementations: true, a number above 0, a list with something true in it, a text of more than 10 characters, a map with entries; nothing else."""
    k = _kind(kind)
    if k == "list":
        inner = kind.elementType
        some = {"text": lambda x: x != "", "flag": lambda x: x, "number": lambda x: x != 0}.get(_kind(inner), lambda x: x.isNotNull())
        return F.coalesce(F.exists(c, lambda x: F.coalesce(some(x), F.lit(False))), F.lit(False))
    rule = {"flag": c, "number": c > 0 if k == "number" else None, "text": F.length(F.trim(c)) > POPULATED_CHARS, "map": F.size(c) > 0 if isinstance(kind, T.MapType) else c.isNotNull()}.get(k)
    return F.lit(False) if rule is None else F.coalesce(rule, F.lit(False))


def content(c: Column, kind: T.DataType, words: int = CONTENT_WORDS) -> Column:
    """For what enrichment returns: a text, or anything else as text, of so many words; a list with an element of one word; a map with entries."""
    k = _kind(kind)
    many = lambda x: F.size(F.filter(F.split(x.cast("string"), r"\s+"), lambda w: w != ""))
    if k == "list":
        return F.coalesce(F.exists(c, lambda x: F.coalesce(many(x) >= 1, F.lit(False))), F.lit(False))
    if k == "map":
        return F.coalesce(F.size(c) > 0, F.lit(False)) if isinstance(kind, T.MapType) else c.isNotNull()
    return F.coalesce(many(c) >= words, F.lit(False))


def complete(c: Column, kind: T.DataType) -> Column:
    """For completeness: neither null nor an empty text nor an empty list; blanks count."""
    k = _kind(kind)
    if k in ("text", "list"):
        return F.coalesce(c != "" if k == "text" else F.size(c) > 0, F.lit(False))
    return c.isNotNull()


#: By what they are used for; exports use the rule of gaps.
RULES = {"gap": filled, "export": filled, "coverage": populated, "content": content, "completeness": complete}


def row_id(*keys: str) -> Column:
    """An id of a row that depends on its key columns alone, the same in each run; null differs from empty."""
    parts = (F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k in keys)
    return F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256)

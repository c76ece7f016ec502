"""Regex matches with positions, from built-in functions alone.

Positions count code points from 0, the end is exclusive. Patterns must never match the
empty string. They are Java patterns; (?U) makes classes and boundaries follow Unicode.
A null text has no matches, an empty one neither; repeated and long texts are nothing special.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string>"
#: Put around matches; a text that holds it is searched with another control character in its place.
_MARK, _OTHER = "\x01", "\x02"


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once for each row: it is a lambda's variable there, not an expression that is put in at each use."""
    return F.transform(F.array(value), then)[0]


def holds_any(*parts: str) -> Callable[[Column], Column]:
    """A test for texts that hold one of the parts."""

    def test(text: Column) -> Column:
        found = [F.contains(text, F.lit(p)) for p in parts]
        out = found[0]
        for f in found[1:]:
            out = out | f
        return out

    return test


def spans_of(text: Column, pattern: Column | str, holds: str | Callable[[Column], Column] | None = None) -> Column:
    """array<struct<start, end, text>> of all non-overlapping matches, leftmost first; null text gives none.

    The text is searched once: matches are marked by a replacement, and the pieces between
    the marks give the places. holds: what every match holds, or a test that every text with
    a match passes; other texts are not searched.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    marked = F.contains(text, F.lit(_MARK))
    searched = F.regexp_replace(F.when(marked, F.translate(text, _MARK, _OTHER)).otherwise(text), p, F.lit(f"{_MARK}$0{_MARK}"))
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        end = (acc["at"] + F.length(piece)).cast("int")
        own = F.when(marked, F.substring(text, acc["at"] + 1, F.length(piece))).otherwise(piece)
        out = F.when(acc["match"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"), own.alias("text"))))).otherwise(acc["out"])
        return F.struct(end.alias("at"), (~acc["match"]).alias("match"), out.alias("out"))

    none = F.array().cast(f"array<{SPAN}>")
    walked = bound(searched, lambda m: F.when(F.contains(m, F.lit(_MARK)), F.aggregate(F.split(m, _MARK, -1), start, step, lambda acc: acc["out"])).otherwise(none))
    test = F.lit(True) if holds is None else holds_any(holds)(text) if isinstance(holds, str) else holds(text)
    return F.when(F.coalesce(test & text.isNotNull(), F.lit(False)), walked).otherwise(none)


def left_of(text: Column, start: Column, width: int) -> Column:
    """Up to width characters before start."""
    return F.substring(text, F.greatest(start - width, F.lit(0)) + 1, F.least(start, F.lit(width)))


def right_of(text: Column, end: Column, width: int) -> Column:
    """Up to width characters from end on."""
    return F.substring(text, end + 1, F.lit(width))


def words_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\b\w+\b"), F.lit(0))


def escaped(text: Column) -> Column:
    """text as a literal inside a pattern."""
    return F.regexp_replace(text, r"([^\p{L}\p{N}\s])", r"\\$1")


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")

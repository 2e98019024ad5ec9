"""Season notations.

A season is a struct ``(start, end, key)``: ``2024/25``, ``2024-2025`` and ``24/25`` all give
``(2024, 2025, "2024/25")``. Seasons may span one or two years.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

_ANY = r"^(\d{4}|\d{2})[\s\u00a0]*[/\-][\s\u00a0]*(\d{4}|\d{2})$"
_STRICT = r"^(\d{4})(?:/(\d{2})|[/\-](\d{4}))$"
_IN_LABEL = r"(\d{4}\s*[/\-]\s*\d{2,4}|\d{2}\s*[/\-]\s*\d{2})"
_AT_END = r"(\d{4}(?:/\d{2}|[/\-]\d{4}))\s*$"


def clean(c: Column) -> Column:
    """Trim ordinary and no-break white space on both sides."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r\u00a0"))


def _group(c: Column, pattern: str, index: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, index), F.lit(""))


def _season(start: Column, end: Column) -> Column:
    key = F.concat(start.cast("string"), F.lit("/"), F.lpad((end % 100).cast("string"), 2, "0"))
    return F.struct(start.alias("start"), end.alias("end"), key.alias("key"))


def _years(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def _end_after(start: Column, text: Column) -> Column:
    """Year of a two- or four-digit end text, in the century of the start or the next one."""
    number = text.try_cast("int")
    same_century = number + F.floor(start / 100).cast("int") * 100
    return F.when(F.length(text) == 4, number).otherwise(
        same_century + F.when(same_century < start, 100).otherwise(0)
    )


def canonical_season(c: Column, strict: bool = False) -> Column:
    """Parse any season notation; ``strict`` takes a four-digit start and a one-year span only."""
    pattern = _STRICT if strict else _ANY
    texts = let(
        clean(c),
        lambda t: F.struct(
            F.regexp_extract(t, pattern, 1).alias("a"),
            F.concat(
                F.regexp_extract(t, pattern, 2), F.regexp_extract(t, pattern, 3)
            ).alias("b")
            if strict
            else F.regexp_extract(t, pattern, 2).alias("b"),
        ),
    )

    def start_of(t: Column) -> Column:
        number = t["a"].try_cast("int")
        return number + F.when(F.length(t["a"]) == 4, 0).when(number >= 70, 1900).otherwise(2000)

    years = let(
        texts,
        lambda t: let(start_of(t), lambda start: _years(start, _end_after(start, t["b"]))),
    )
    span = 1 if strict else 2
    return let(
        years,
        lambda y: F.when(
            (y["end"] - y["start"]).between(1, span), _season(y["start"], y["end"])
        ),
    )


def long_key(season: Column) -> Column:
    """``YYYY/YYYY`` form of a season struct."""
    return F.concat_ws("/", season["start"].cast("string"), season["end"].cast("string"))


def season_in_label(c: Column) -> Column:
    """The season named in a label, only when exactly one is named."""
    found = F.regexp_extract_all(c, F.lit(_IN_LABEL), F.lit(1))
    one = let(found, lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0))))
    return canonical_season(one)


def trailing_season(c: Column) -> Column:
    """Strict season at the end of a league key."""
    return canonical_season(_group(c, _AT_END, 1), strict=True)


def season_of_date(d: Column) -> Column:
    """Season (August to July) a date belongs to."""
    start = F.year(d) - F.when(F.month(d) < 8, 1).otherwise(0)
    return let(start, lambda s: F.when(s.isNotNull(), _season(s, s + 1)))

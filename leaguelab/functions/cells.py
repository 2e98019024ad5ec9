"""Values of table cells: rounds, affiliations, ratings, addresses, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .seasons import clean
from .text import squeeze

# Administrative round markers and affiliation markers.
ROUND_MARKERS = ["x", "vw", "d", "kp", "*"]
AFFILIATION_MARKERS = ["vw"]
# Largest exact integer and largest accepted model rating.
MAX_SAFE_INTEGER = 2**53 - 1
MAX_RATING = 1000.0


def safe_integer(c: Column) -> Column:
    """Digits up to the safe-integer limit as BIGINT, else NULL."""
    number = c.try_cast("decimal(38,0)")
    return F.when(c.rlike(r"^\d+$") & (number <= MAX_SAFE_INTEGER), number.cast("bigint"))


def round_value(c: Column) -> Column:
    """``(points, marker, error)`` of a round cell."""

    def parse(text: Column) -> Column:
        number = safe_integer(text)
        known = (text == "") | F.lower(text).isin(ROUND_MARKERS)
        return F.struct(
            number.alias("points"),
            F.when(number.isNull() & known, text).alias("marker"),
            (number.isNull() & ~known).alias("error"),
        )

    return let(F.coalesce(clean(c), F.lit("")), parse)


def round_value_loose(c: Column) -> Column:
    """Leading integer of a cell; NULL for blanks, entities and 'x'."""
    return F.regexp_extract(c, r"^[\s\u00a0]*([+-]?\d+)", 1).try_cast("bigint")


def affiliation(c: Column) -> Column:
    """``(club_no, marker, error)`` of an affiliation cell."""

    def parse(text: Column) -> Column:
        digits = text.rlike(r"^[0-9]+$")
        marker = F.lower(text).isin(AFFILIATION_MARKERS)
        return F.struct(
            F.when(digits, text).alias("club_no"),
            F.when(marker, text).alias("marker"),
            ((text != "") & ~digits & ~marker).alias("error"),
        )

    return let(F.coalesce(clean(c), F.lit("")), parse)


def round_number(c: Column) -> Column:
    """Round of '7', 'Runde 7' or '7. Spieltag'."""
    text = clean(c)
    found = F.regexp_extract(
        text, r"(?i)^(?:runde[\s\u00a0]+)?([1-9][0-9]*)(?:\.[\s\u00a0]*spieltag|\b)", 1
    )
    return safe_integer(found)


# Words that head a round column, the longer one first.
ROUND_WORDS = ["runde", "r"]


def _behind_round_word(text: Column) -> Column:
    """What follows a round word at the beginning of a text; NULL without one."""
    out = F.lit(None).cast("string")
    for word in reversed(ROUND_WORDS):
        out = F.when(text.startswith(word), F.substr(text, F.lit(len(word) + 1))).otherwise(out)
    return out


def round_header(c: Column) -> Column:
    """Round number of a header cell such as 'R1', 'Runde 3' or '12'."""

    def number(text: Column) -> Column:
        digits = F.ltrim(F.coalesce(_behind_round_word(text), text))
        plain = (F.length(digits) <= 2) & (F.translate(digits, "0123456789", "") == "")
        return F.when(plain, digits.try_cast("int"))

    return let(F.lower(squeeze(c)), number)


def suspicious_round_header(c: Column) -> Column:
    """Looks like a round header but has no usable number."""

    def cut_off(text: Column) -> Column:
        following = F.substring(_behind_round_word(text), 1, 1)
        sign = F.coalesce(following.isin("", " ", *":._-", *"0123456789"), F.lit(False))
        return F.when(text.isNotNull(), sign)

    return round_header(c).isNull() & let(F.lower(squeeze(c)), cut_off)


def cup_round_weight(c: Column) -> Column:
    """Order of cup rounds; 0 when the round is not a known one."""
    text = F.lower(c)
    out = F.lit(0)
    # Fixed values, tested top down: later words contain earlier ones.
    steps = [("runde " + str(n), n) for n in range(1, 7)] + [
        ("achtelfinale", 10),
        ("viertelfinale", 11),
        ("halbfinale", 12),
        ("finale", 15),
        ("spiel um platz", 14),
    ]
    for word, weight in reversed(steps):
        out = F.when(text.contains(word), F.lit(weight)).otherwise(out)
    return F.coalesce(out, F.lit(0))


def safe_rating(c: Column) -> Column:
    """Finite rating in (0, 1000], else NULL."""
    return F.when(~F.isnan(c) & (c > 0) & (c <= MAX_RATING), c)


def nonnegative(c: Column) -> Column:
    """Finite value >= 0, else NULL."""
    return F.when(~F.isnan(c) & (c >= 0) & (c < float("inf")), c)


def placeholder_free(c: Column) -> Column:
    """Trimmed text; NULL for blanks and the placeholder '-'."""
    text = clean(c)
    return F.when((text != "") & (text != "-"), text)


def address(venue: Column, street: Column, city: Column) -> Column:
    """``(text, status)``: joined parts and complete / incomplete / unresolved."""
    parts = [placeholder_free(x) for x in (venue, street, city)]
    n = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return F.struct(
        F.nullif(F.concat_ws(", ", *parts), F.lit("")).alias("text"),
        F.when(n == 3, "complete").when(n > 0, "incomplete").otherwise("unresolved").alias("status"),
    )


def freshness(season: Column, state: Column, updated_at: Column) -> Column:
    """current / retained / unknown; needs a season and a valid time."""
    ok = (F.coalesce(squeeze(season), F.lit("")) != "") & updated_at.isNotNull()
    return F.when(ok & state.isin("current", "retained"), state).otherwise(F.lit("unknown"))


def is_cup(league: Column) -> Column:
    """League name of the cup competition."""
    return F.coalesce(F.lower(league).contains("ligapokal"), F.lit(False))


def half_up(c: Column) -> Column:
    """Round half up to an integer, for non-negative input."""
    return F.floor(c + 0.5).cast("bigint")


# Confidence and evidence levels from best to worst.
CONFIDENCE = ["high", "medium", "provisional", "very-low"]
EVIDENCE = ["current+history", "current", "historical", "historical-fallback", "neutral"]


def _position(c: Column, levels: list[str]) -> Column:
    out = F.lit(len(levels) - 1)
    for i, name in enumerate(levels):
        out = F.when(c == name, F.lit(i)).otherwise(out)
    return out


def confidence_ordinal(c: Column) -> Column:
    """0 best .. 3 worst; unknown is worst."""
    return _position(c, CONFIDENCE)


def confidence_name(ordinal: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in CONFIDENCE]), (ordinal + 1).cast("int"))


def evidence_ordinal(c: Column) -> Column:
    """0 strongest .. 4 neutral."""
    return _position(c, EVIDENCE)


def weakest_confidence(c: Column) -> Column:
    """Aggregate: the worst confidence of a group."""
    return confidence_name(F.max(confidence_ordinal(c)))

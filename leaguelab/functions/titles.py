"""Identity of archive table titles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .seasons import canonical_season
from .text import folded

# Competition families named in titles, first match wins.
FAMILIES = ["bundesliga", "verbandsliga", "oberliga", "bezirksliga", "ligapokal", "pokal"]
# Words for a part of a competition (group, round, matchday, final).
PART_WORDS = ["gruppe", "runde", "spieltag", "gruppenphase", "gruppenrunde"]
PART_WORDS += [p + "runde" for p in ("vor", "zwischen", "haupt", "end", "final")]
PART_WORDS += [p + f for p in ("", "achtel", "viertel", "halb") for f in ("final", "finale")]
# Words that name the kind of title only.
TITLE_WORDS = ["mm", "meisterschaft", "meisterschaften"]
TITLE_WORDS += [m + k for m in ("mannschaft", "mannschafts") for k in ("meisterschaft", "meisterschaften")]

# A chain of numbers with signs between them, or a word.
_TOKEN = r"(?U)[0-9]+(?:[/_.\-][0-9]+)+|[^\W_]+"


def _tokens(text: Column) -> Column:
    tight = F.regexp_replace(text, r"(?<=[0-9])\s*([/_.\-])\s*(?=[0-9])", "$1")
    return F.regexp_extract_all(tight, F.lit(_TOKEN), F.lit(0))


def _without_season(parts: Column, key: Column) -> Column:
    """A chain of numbers without the two at its end, or else its beginning, that are the season."""

    def own(at: Column) -> Column:
        years = F.array_join(F.slice(parts, at, F.lit(2)), "/")
        return F.coalesce((F.size(parts) > 1) & (canonical_season(years)["key"] == key), F.lit(False))

    last = F.greatest(F.size(parts) - 1, F.lit(1))
    rest = F.greatest(F.size(parts) - 2, F.lit(0))
    return F.when(own(last), F.slice(parts, F.lit(1), rest)).when(
        own(F.lit(1)), F.slice(parts, F.lit(3), rest)
    ).otherwise(parts)


def _is_date(token: Column) -> Column:
    sizes = F.array_join(F.transform(F.split(token, "[.]"), lambda x: F.length(x)), ",")
    return sizes.isin("1,1,4", "1,2,4", "2,1,4", "2,2,4")


def _kept_words(tokens: Column, key: Column) -> Column:
    """Words of the title without its own season, dates after 'am', and title words."""

    def words_of(token: Column, n: Column) -> Column:
        before = F.when(n > 0, F.get(tokens, n - 1))
        after = F.get(tokens, n + 1)
        dated = (token == "am") & F.coalesce(_is_date(after), F.lit(False))
        date = _is_date(token) & F.coalesce(before == "am", F.lit(False))
        drop = dated | date | token.isin(TITLE_WORDS)
        parts = let(F.split(token, r"[/_.\-]"), lambda p: _without_season(p, key))
        return F.when(drop, F.array().cast("array<string>")).otherwise(parts)

    return F.flatten(F.transform(tokens, words_of))


def _pair(words: Column, first: list[str], second: list[str]) -> Column:
    """First word of the first pair of neighbours out of the two lists, or NULL."""
    pairs = F.transform(words, lambda w, n: F.when(w.isin(first) & F.get(words, n + 1).isin(second), w))
    return F.get(F.filter(pairs, lambda w: w.isNotNull()), F.lit(0))


def title_identity(
    season: Column, title: Column, organisers: Sequence[str] = (), normalized: bool = False
) -> Column:
    """``(season, title, family, partition)`` of an archive table; NULL without season or title.

    Season, date, organiser and championship words are removed from the title. ``organisers`` are
    regular expressions of organiser names (with their legal form). Pass ``normalized=True`` when
    the title is already folded.
    """

    def without_organisers(text: Column) -> Column:
        for name in organisers:
            text = F.regexp_replace(text, rf"\b{name}\s*e\.?\s*v\.?", " ")
        return text

    def identify(key: Column, words: Column) -> Column:
        named = F.when(_pair(words, ["liga"], ["pokal"]).isNotNull(), F.lit("ligapokal"))
        family = F.lit(None).cast("string")
        for name in reversed(FAMILIES):
            has = F.array_contains(words, name)
            family = F.when(has | (named == name) if name == "ligapokal" else has, F.lit(name)).otherwise(family)
        letter = _pair(words, ["a", "b", "c"], ["klasse", "klassen"])
        part = F.arrays_overlap(words, F.array(*[F.lit(w) for w in PART_WORDS]))
        return F.struct(
            key.alias("season"),
            F.array_join(words, " ").alias("title"),
            F.coalesce(F.concat(letter, F.lit("-klasse")), family).alias("family"),
            (part | _pair(words, ["gruppen"], ["phase"]).isNotNull()).alias("partition"),
        )

    both = F.struct(
        canonical_season(season)["key"].alias("k"),
        (title if normalized else folded(title)).alias("t"),
    )
    return let(
        both,
        lambda b: F.when(
            b["k"].isNotNull() & (F.trim(b["t"]) != ""),
            let(
                let(_tokens(without_organisers(b["t"])), lambda t: _kept_words(t, b["k"])),
                lambda words: identify(b["k"], words),
            ),
        ),
    )

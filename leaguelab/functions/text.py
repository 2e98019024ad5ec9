"""Name and team keys.

Unicode normal forms have no Spark built-in, so they run as Arrow UDFs; everything after that
step is a built-in expression. Keys meant for joins should be computed once and stored.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .binding import let

_SPACES = r"[\s\u00a0]+"


def _arrow(build: Callable[[], Callable[[str], str | None]], c: Column) -> Column:
    """Arrow UDF of a text function that ``build`` returns.

    ``build`` must be self-contained (own imports, no module globals): its result is then shipped
    by value and executors need no copy of this package. Equal texts of a batch are converted once.
    """
    convert = build()

    def apply(values: pd.Series) -> pd.Series:
        import numpy as np

        codes, texts = values.factorize()
        out = np.array([*map(convert, texts), None], dtype=object)
        return pd.Series(out[codes])

    apply.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(apply, StringType())(c)


def _build_nfkc():
    import unicodedata

    return lambda v: v if v.isascii() else unicodedata.normalize("NFKC", v)


def _build_folded():
    import unicodedata

    def fold(v):
        if v.isascii():
            return v.lower()
        return unicodedata.normalize("NFC", unicodedata.normalize("NFKC", v).casefold())

    return fold


def _build_lowered():
    import unicodedata

    def lower(v):
        if v.isascii():
            return v.lower()
        return unicodedata.normalize("NFC", unicodedata.normalize("NFKC", v).lower())

    return lower


def _build_unmarked():
    import unicodedata

    def strip(v):
        if v.isascii():
            return v
        return "".join(
            ch for ch in unicodedata.normalize("NFKD", v) if unicodedata.category(ch)[0] != "M"
        )

    return strip


def _build_label():
    import unicodedata

    # Default-ignorable code points outside the categories Cc, Cf, Cs and Cn.
    ignorable = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F]
    ignorable += [0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
    dropped = {chr(n) for n in ignorable}

    def convert(v):
        text = unicodedata.normalize("NFKC", v)
        if any(unicodedata.category(ch) in ("Cc", "Cf", "Cs", "Cn") or ch in dropped for ch in text):
            return None
        return unicodedata.normalize("NFC", " ".join(text.split())) or None

    return convert


def nfkc(c: Column) -> Column:
    """Compatibility-composed form."""
    return _arrow(_build_nfkc, c)


def folded(c: Column) -> Column:
    """Case-folded compatibility form: equal for spellings that differ in case, width, ligatures,
    composition or in ß and ss."""
    return _arrow(_build_folded, c)


def lowered(c: Column) -> Column:
    """Lower-case compatibility form; ß stays."""
    return _arrow(_build_lowered, c)


def unmarked(c: Column) -> Column:
    """Compatibility-decomposed form without combining marks."""
    return _arrow(_build_unmarked, c)


def squeeze(c: Column) -> Column:
    """Collapse white space (including no-break spaces) and trim."""
    return F.trim(F.regexp_replace(c, _SPACES, " "))


def display_name(c: Column, normalized: bool = False) -> Column:
    """Readable player name; NULL when it holds no letter."""
    text = squeeze(c if normalized else nfkc(c))
    return F.when(text.rlike(r"\p{L}"), text)


def player_key(c: Column, normalized: bool = False) -> Column:
    """Case-folded player name, '' when there is none."""
    return F.coalesce(F.lower(display_name(c, normalized)), F.lit(""))


def last_first_swapped(c: Column) -> Column:
    """'Last, First' becomes 'First Last' when there is exactly one comma."""

    def swap(text: Column) -> Column:
        parts = F.split(text, ",")
        last, first = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
        return F.when(
            (F.size(parts) == 2) & (last != "") & (first != ""), F.concat_ws(" ", first, last)
        ).otherwise(text)

    return let(squeeze(c), swap)


def ascii_words(c: Column) -> Column:
    """Lower-case a-z/0-9 words of an already unmarked text."""
    text = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(text, r"[^a-z0-9]+", " "))


def team_key(c: Column) -> Column:
    """Exact team key: marks dropped, lower case, only a-z and 0-9 words."""
    return ascii_words(unmarked(c))


def search_key(c: Column) -> Column:
    """Search text; the same folding as the team key."""
    return team_key(c)


def schedule_team_key(c: Column) -> Column:
    """Schedule key: non-alphanumeric characters vanish instead of separating words."""
    return squeeze(F.regexp_replace(F.lower(c), r"[^a-z0-9\s\u00a0]", ""))


def without_legal_form(key: Column) -> Column:
    """Drop the legal form 'e v' before an optional team number of a team key."""
    return F.regexp_replace(key, r"(?:^| )e v( \d+)?$", "$1")


def club_alias(c: Column) -> Column:
    """Team key of a club name without its legal form."""
    return F.trim(without_legal_form(team_key(c)))


# Words before a team number, and roman team numbers.
TEAM_WORDS = ["team", "mannschaft"]
ROMAN = ["i", "ii", "iii", "iv", "v"]
# Words and whole labels for "no opponent".
BYE_WORDS = ["spielfrei", "freilos", "bye"]
BYE_LABELS = ["kein gegner", "keine gegner", "keiner gegner", "keines gegner", "ohne gegner"]
BYE_LABELS += ["tbd", "n n", "offen", "unbekannt"]


def club_base_name(c: Column) -> Column:
    """Club name without a team number, roman numeral or 'Team n' suffix."""

    def cut(words: Column, drop: Column, count: int) -> Column:
        return F.when(drop & (F.size(words) > count), F.slice(words, F.lit(1), F.size(words) - count)).otherwise(words)

    def last(words: Column, back: int = 1) -> Column:
        return F.coalesce(F.lower(F.try_element_at(words, F.lit(-back))), F.lit(""))

    def number(word: Column, most: int | None = None) -> Column:
        value = word.try_cast("int")
        fits = F.regexp_like(word, F.lit("^[0-9]+$"))
        if most is not None:
            fits = fits & value.between(1, most) & ~word.startswith("0")
        return F.coalesce(fits, F.lit(False))

    def undotted(word: Column) -> Column:
        return F.when(word.endswith("."), F.substr(word, F.lit(1), F.length(word) - 1)).otherwise(word)

    def named_team(w: Column) -> Column:
        return cut(w, last(w, 2).isin(TEAM_WORDS) & number(last(w)), 2)

    def roman(w: Column) -> Column:
        return cut(w, undotted(last(w)).isin(ROMAN), 1)

    def numbered(w: Column) -> Column:
        return cut(w, number(undotted(last(w)), 19), 1)

    words = F.split(squeeze(c), " ")
    return F.array_join(let(let(let(words, named_team), roman), numbered), " ")


def club_base_key(c: Column) -> Column:
    """Letters and digits of the club base name, lower case."""
    return F.regexp_replace(F.lower(club_base_name(c)), r"[^a-z0-9äöüß]", "")


def exact_team_label(c: Column) -> Column:
    """Lower-case label; NULL with hidden code points or without a letter."""
    text = _arrow(_build_label, c)
    return F.when(text.rlike(r"\p{L}"), F.lower(text))


def is_bye(c: Column, normalized: bool = False) -> Column:
    """True for a missing or placeholder opponent; NULL input is not a bye.

    Pass ``normalized=True`` when the label is already NFKC.
    """
    signs = r"[^\p{L}\p{N}]+"
    text = F.trim(F.regexp_replace(F.lower(c if normalized else nfkc(c)), signs, " "))

    def bye(t: Column) -> Column:
        named = F.arrays_overlap(F.split(t, " "), F.array(*[F.lit(w) for w in BYE_WORDS]))
        return (t == "") | named | t.isin(BYE_LABELS)

    return F.coalesce(let(text, bye), F.lit(False))


def is_bye_key(key: Column) -> Column:
    """Closed-set bye test on a team key."""
    # Team keys that stand for a bye.
    return key.isin("spielfrei", "bye", "freilos", "freilose")


def first_nonblank(*cols: Column) -> Column:
    """First value that is not blank, trimmed; '' when all are."""
    return F.coalesce(*[F.nullif(squeeze(c), F.lit("")) for c in cols], F.lit(""))


def club_no_key(c: Column) -> Column:
    """Club number without leading zeros; other texts lower-cased."""
    text = squeeze(c)
    return F.when(text.rlike(r"^\d+$"), F.regexp_replace(text, r"^0+(?=\d)", "")).otherwise(
        F.lower(text)
    )


def person_key(club_no: Column, player_id: Column, name: Column) -> Column:
    """``club|id|name``; NULL when a part is blank. ``name`` must be a player key."""
    club, pid = club_no_key(club_no), squeeze(player_id)
    return F.when((club != "") & (pid != "") & (name != ""), F.concat_ws("|", club, pid, name))


def record_key(league_class: Column, player_id: Column) -> Column:
    """``class|id``; NULL when the class is unknown or the id blank."""
    pid = squeeze(player_id)
    return F.when(league_class.isNotNull() & (pid != ""), F.concat_ws("|", league_class, pid))

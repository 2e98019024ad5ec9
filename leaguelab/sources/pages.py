"""Tables, headings, fields and links of stored web pages.

Only the HTML tokenizing itself runs in Python, page by page inside Arrow batches; everything that
follows is built from DataFrame operations. The functions sent to the executors carry their own
imports, so the cluster needs no copy of this package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.seasons import canonical_season, clean, long_key
from ..functions.text import squeeze

ELEMENTS = (
    "page_id bigint, pos int, kind string, table_no int, section string, row_no int, "
    "cells array<string>, spans array<string>, text string"
)


def _build_tokenizer() -> Callable[[str], list[tuple]]:
    """A self-contained function from HTML to ordered headings and table rows."""
    import re
    from html.parser import HTMLParser

    # Elements dropped with their content, void ones among them, and heading tags.
    void = {"source", "link", "meta", "base", "img", "input", "embed"}
    dropped = {
        "script", "style", "iframe", "object", "svg", "math", "form", "template", "noscript",
        "canvas", "audio", "video", "picture", "button", "select", "textarea",
    }
    headings = {"b", "strong", "h1", "h2", "h3", "h4"}
    sections = {"thead", "tbody", "tfoot"}
    squeeze_re = re.compile(r"\s+")

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.skip, self.depth = [], [], 0
            self.heading, self.heading_tag = None, None
            self.tables, self.rows, self.section = 0, 0, ""
            self.row, self.cell, self.span = None, None, ""

        def put(self, kind, cells=(), spans=(), text=None):
            inside = kind == "row"
            self.out.append(
                (
                    len(self.out), kind, self.tables if inside else None,
                    self.section if inside else None, self.rows if inside else None,
                    list(cells), list(spans), text,
                )
            )

        def close_heading(self):
            text = self.text_of(self.heading) if self.heading is not None else ""
            self.heading = None
            if text:
                self.put("heading", text=text)

        def text_of(self, parts):
            return squeeze_re.sub(" ", " ".join(parts)).strip()

        def close_cell(self):
            if self.cell is not None and self.row is not None:
                self.row.append((self.text_of(self.cell), self.span))
            self.cell = None

        def close_row(self):
            self.close_cell()
            if self.row:
                self.put("row", [c for c, _ in self.row], [s for _, s in self.row])
                self.rows += 1
            self.row = None

        def handle_starttag(self, tag, attrs):
            if tag in void:
                return
            if self.skip or tag in dropped:
                self.skip.append(tag)
                return
            if tag == "table":
                self.depth += 1
                if self.depth == 1:
                    self.close_heading()
                    self.rows, self.section = 0, ""
            elif self.depth == 1 and tag in sections:
                self.close_row()
                self.section = tag
            elif self.depth == 1 and tag == "tr":
                self.close_row()
                self.row = []
            elif self.depth == 1 and tag in ("td", "th") and self.row is not None:
                self.close_cell()
                kept = []
                for name, value in attrs:
                    if name in ("rowspan", "colspan") and re.fullmatch(r"[1-9]\d*", value or ""):
                        if int(value) <= 100:
                            kept.append(f"{name}={value}")
                self.cell, self.span = [], " ".join(sorted(kept))
            elif self.depth == 0 and tag in headings:
                # Bold text inside a heading belongs to it; a heading ends open bold text.
                if self.heading is None or tag.startswith("h"):
                    self.close_heading()
                    self.heading, self.heading_tag = [], tag

        def handle_endtag(self, tag):
            if self.skip:
                if tag in self.skip:
                    while self.skip and self.skip.pop() != tag:
                        pass
                return
            if tag == "table" and self.depth:
                if self.depth == 1:
                    self.close_row()
                    self.section = ""
                    self.tables += 1
                self.depth -= 1
            elif self.depth == 1 and tag == "tr":
                self.close_row()
            elif self.depth == 1 and tag in sections:
                self.close_row()
                self.section = ""
            elif self.depth == 1 and tag in ("td", "th"):
                self.close_cell()
            elif self.depth == 0 and tag == self.heading_tag:
                self.close_heading()

        def handle_data(self, data):
            if self.skip:
                return
            if self.depth == 1 and self.cell is not None:
                self.cell.append(data)
            elif self.depth == 0 and self.heading is not None:
                self.heading.append(data)

    def read(html):
        reader = Reader()
        reader.feed(html)
        reader.close()
        if reader.depth >= 1:
            reader.close_row()
        return reader.out

    return read


def extract_elements(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Headings and table rows of every page in document order.

    Only root tables count; of a row only its own cells. Nested tables, scripts and forms are
    dropped, white space is collapsed, and row and column spans are kept from 1 to 100.
    """
    read = _build_tokenizer()
    names = [part.split()[0] for part in ELEMENTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas

        for batch in batches:
            rows = []
            for key, text in zip(batch["page_id"], batch["html"]):
                if isinstance(text, str):
                    rows.extend((key, *item) for item in read(text))
                if len(rows) >= 20000:
                    yield pandas.DataFrame(rows, columns=names)
                    rows = []
            yield pandas.DataFrame(rows, columns=names)

    run.__annotations__ = {}
    source = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(html).alias("html"))
    return source.mapInPandas(run, ELEMENTS)


def extract_tables(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Table rows of every page: page_id, table_no, section, row_no, cells, spans."""
    rows = extract_elements(pages, page_id, html).where(F.col("kind") == "row")
    return rows.select("page_id", "table_no", "section", "row_no", "cells", "spans")


def attach_headings(elements: DataFrame, wanted: Column) -> DataFrame:
    """The nearest heading before each table; a heading serves the first table after it only.

    ``wanted`` picks the useful part of a heading's ``text`` (NULL = not a heading of interest).
    The window is one page, which is also what one task has read.
    """
    page = Window.partitionBy("page_id").orderBy("pos")
    upto = page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    label = F.when(F.col("kind") == "heading", wanted)
    marked = elements.withColumn("_h", F.last(label, ignorenulls=True).over(upto)).withColumn(
        "_no", F.count(label).over(upto)
    )
    tables = marked.where(F.col("kind") == "row").groupBy("page_id", "table_no").agg(
        F.min("pos").alias("pos"), F.min_by("_h", "pos").alias("_h"), F.min("_no").alias("_no")
    )
    first = Window.partitionBy("page_id", "_no").orderBy("pos")
    taken = tables.withColumn("_first", F.row_number().over(first) == 1)
    return taken.select(
        "page_id", "table_no", "pos", F.when(F.col("_first"), F.col("_h")).alias("heading")
    )


def carry_sections(rows: DataFrame, title: str = "title", section_col: str | None = None) -> DataFrame:
    """Turn in-table section rows into a first column that is carried down.

    ``rows``: table_id, row_no, cells and the table's ``title``. ``section_col`` names the section that
    stands outside the table (NULL = none); it holds until the first section row. A one-cell row with a competition
    word renames the table. Header rows get the label 'Runde/Info', tables with two rows or less
    are dropped.
    """
    # Words of titles, section rows and header rows, and the added header.
    title_words, part_words = r"klasse|liga|pokal|meisterschaft", r"finale|runde|spieltag|gruppe"
    header_words, added = r"heim|gast|tabelle|spiel-?nr", "Runde/Info"
    text = F.lower(F.array_join("cells", " "))
    size = F.size("cells")
    marked = rows.where(size > 0).select(
        "*",
        ((size == 1) & text.rlike(title_words)).alias("_title"),
        (text.rlike(header_words) & ~text.rlike("team")).alias("_head"),
        text.rlike(r"\d+:\d+").alias("_score"),
        text.rlike(part_words).alias("_part"),
    )
    section = ~F.col("_title") & ~F.col("_head") & (
        (size == 1) | (~F.col("_score") & F.col("_part"))
    )
    name = F.get(F.filter("cells", lambda c: F.length(c) > 2), F.lit(0))
    order = Window.partitionBy("table_id").orderBy("row_no")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = marked.withColumn("_section", section).withColumn(
        "_name", F.last(F.when(F.col("_section"), name), ignorenulls=True).over(upto)
    ).withColumn(
        "_renamed",
        F.last(F.when(F.col("_title"), F.get("cells", F.lit(0))), ignorenulls=True).over(
            Window.partitionBy("table_id").orderBy("row_no").rowsBetween(
                Window.unboundedPreceding, Window.unboundedFollowing
            )
        ),
    )
    data = ~F.col("_title") & ~F.col("_section") & (
        (size > 2) | ((size == 2) & F.col("_score"))
    )
    outside = F.col(section_col) if section_col else F.lit(None).cast("string")
    first = F.when(F.col("_head"), F.lit(added)).otherwise(F.coalesce("_name", outside, F.lit("")))
    kept = carried.where(data)
    counted = kept.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("table_id")))
    return counted.where(F.col("_n") > 2).select(
        "table_id", "row_no", F.coalesce("_renamed", title).alias(title),
        F.concat(F.array(first), F.col("cells")).alias("cells"),
    )


def classify_tables(rows: DataFrame) -> DataFrame:
    """Ids of team tables: a team word and no player word in the first row, three rows or more."""
    # Words of team tables and of player rankings.
    team_words = r"tabelle|team|mannschaft|verein|heim|gast"
    player_words = r"vorname|nachname|spieler|bestleistungen|name"
    facts = rows.groupBy("table_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min_by("cells", "row_no").alias("_first")
    )
    text = F.lower(F.array_join("_first", " "))
    return facts.where(
        text.rlike(team_words) & ~text.rlike(player_words) & (F.col("rows") >= 3)
    ).select("table_id", "rows")


def extract_fields(
    lines: DataFrame, fields: dict[str, Sequence[str]], footers: Sequence[str] = ()
) -> DataFrame:
    """Label and value pairs of page lines ``(page_id, line_no, line)``, one row per page.

    A value stands behind a tab, or on the next line unless that is a label itself. The last value
    of a label counts, and of a field's labels the first that is not empty. Lines from the first
    footer line on are ignored.
    """
    labels = [label for group in fields.values() for label in group]
    text = clean(F.col("line"))
    rows = lines.withColumn("_t", text).where(F.col("_t") != "")
    if footers:
        ends = rows.where(
            F.exists(F.array(*[F.lit(f) for f in footers]), lambda f: F.col("_t").startswith(f))
        ).groupBy("page_id").agg(F.min("line_no").alias("_end"))
        rows = rows.join(ends, "page_id", "left").where(
            F.col("_end").isNull() | (F.col("line_no") < F.col("_end"))
        )

    def first_label(matches: Callable[[str], Column]) -> Column:
        return F.coalesce(*[F.when(matches(label), F.lit(label)) for label in labels])

    tabbed = F.col("_t").contains("\t")
    key = F.rtrim(clean(F.substring_index("_t", "\t", 1)), F.lit(":"))
    value = clean(F.substring("_t", F.instr("_t", "\t") + 1, F.length("_t")))
    exact = F.coalesce(first_label(lambda x: key == x), first_label(lambda x: key.startswith(x)))
    alone = first_label(
        lambda x: (F.col("_t") == x) | (F.col("_t") == x + ":") | F.col("_t").startswith(x + ":")
    )
    page = Window.partitionBy("page_id").orderBy("line_no")
    rows = rows.withColumn("_next", F.lead("_t").over(page))
    next_is_label = F.coalesce(
        F.exists(F.array(*[F.lit(x) for x in labels]), lambda x: F.col("_next").startswith(x)),
        F.lit(True),
    )
    found = rows.select(
        "page_id", "line_no",
        F.when(tabbed, exact).otherwise(alone).alias("_label"),
        F.when(tabbed, value)
        .when(next_is_label, F.lit(""))
        .otherwise(F.col("_next"))
        .alias("_value"),
    ).where(F.col("_label").isNotNull())
    last = lambda x: F.max_by("_value", F.when(F.col("_label") == x, F.col("line_no")))
    return found.groupBy("page_id").agg(
        *[
            F.coalesce(*[F.nullif(last(x), F.lit("")) for x in group], F.lit("")).alias(name)
            for name, group in fields.items()
        ]
    )


def canonical_url(href: Column, host: str, prefixes: Sequence[str]) -> Column:
    """https URL of the host without query and fragment, or NULL when the link is not allowed.

    Not allowed: other hosts, schemes or ports, user names, back-slashes and control characters,
    protocol-relative links, dot segments (also encoded) and paths outside the prefixes.
    """
    origin = rf"^https://{host.replace('.', chr(92) + '.')}(?::443)?(?=[/?#]|$)"
    absolute = href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    rest = F.when(absolute, F.when(href.rlike(origin), F.regexp_replace(href, origin, ""))).otherwise(
        href
    )
    path = F.regexp_replace(rest, r"[?#].*$", "")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    unsafe = r"[\\\x00-\x1f\x7f]"
    allowed = F.lit(False)
    for prefix in prefixes:
        allowed = allowed | path.startswith(prefix)
    ok = (
        (href != "")
        & ~href.rlike(unsafe)
        & ~href.startswith("//")
        & decoded.isNotNull()
        & ~decoded.rlike(unsafe)
        & ~decoded.rlike(r"(^|/)\.{1,2}(/|$)")
        & allowed
    )
    return F.when(ok, F.concat(F.lit(f"https://{host}"), path))


def extract_links(pages: DataFrame, host: str, prefixes: Sequence[str]) -> DataFrame:
    """Allowed links of all pages with their texts, one row per URL and text."""
    anchor = r"(?is)<a\s[^>]*?href\s*=\s*(?:\"[^\"]*\"|'[^']*')[^>]*>.*?</a>"
    href = r"(?is)href\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(anchor), F.lit(0))).alias("_a"))
    link = F.concat(F.regexp_extract("_a", href, 1), F.regexp_extract("_a", href, 2))
    text = F.regexp_replace(F.regexp_replace("_a", r"(?s)^<[^>]*>|</a>$", ""), r"(?s)<[^>]*>", " ")
    rows = found.select(
        canonical_url(F.replace(link, F.lit("&amp;"), F.lit("&")), host, prefixes).alias("url"),
        squeeze(text).alias("text"),
    )
    return rows.where(F.col("url").isNotNull()).distinct()


_SEASON = r"(?<!\d)((?:\d{4}|\d{2})\s*[/\-]\s*(?:\d{4}|\d{2}))(?!\d)"


def _signal(c: Column) -> Column:
    """The one season a text names; NULL for none, several or an invalid one."""
    found = F.transform(
        F.regexp_extract_all(c, F.lit(_SEASON), F.lit(1)),
        lambda s: F.coalesce(long_key(canonical_season(s)), F.lit("")),
    )
    distinct = F.array_distinct(found)
    return F.when(F.size(distinct) == 1, F.nullif(F.get(distinct, F.lit(0)), F.lit("")))


def season_index(links: DataFrame) -> DataFrame:
    """One landing URL per season, the smallest; links whose text and URL disagree are ignored."""
    rows = links.withColumn("_t", _signal(F.col("text"))).withColumn("_u", _signal(F.col("url")))
    agree = F.col("_t").isNull() | F.col("_u").isNull() | (F.col("_t") == F.col("_u"))
    return (
        rows.where(agree)
        .withColumn("season", F.coalesce("_t", "_u"))
        .where(F.col("season").isNotNull())
        .groupBy("season")
        .agg(F.min("url").alias("url"))
    )


def club_index(links: DataFrame) -> DataFrame:
    """Number and name of each club link: texts of one URL joined, digits first.

    A URL has a handful of distinct texts; they are made distinct before they are collected.
    """
    texts = links.where(F.col("text") != "").select("url", "text").distinct()
    order = F.struct((~F.col("text").rlike(r"^\d+$")).alias("o"), F.col("text").alias("t"))
    joined = texts.groupBy("url").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["t"]), " ").alias("_f")
    )
    pattern = r"^(\d{1,4}) (.+)$"
    split = F.col("_f").rlike(pattern)
    return joined.select(
        "url",
        F.when(split, F.regexp_extract("_f", pattern, 1)).otherwise("").alias("number"),
        F.when(split, F.regexp_extract("_f", pattern, 2)).otherwise(F.col("_f")).alias("name"),
    )


def _build_table_check() -> Callable[[str], str | None]:
    """A self-contained check that a fragment holds inert tables only."""
    import re
    from html.parser import HTMLParser

    # The only elements and attributes a table fragment may have.
    allowed = {"table", "thead", "tbody", "tfoot", "tr", "th", "td"}
    spans = {"rowspan", "colspan"}

    class Check(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.found, self.stack = set(), []
            self.tables = []

        def handle_comment(self, data):
            self.found.add("comments")

        def handle_starttag(self, tag, attrs):
            if tag not in allowed:
                self.found.add("forbidden elements")
            if tag == "table":
                if "table" in self.stack:
                    self.found.add("nested tables")
                self.tables.append([0, 0])
            elif self.tables and tag == "tr":
                self.tables[-1][0] += 1
            elif self.tables and tag in ("td", "th"):
                self.tables[-1][1] += 1
            if tag in ("td", "th"):
                if any(name not in spans for name, _ in attrs):
                    self.found.add("cell attributes")
                for name, value in attrs:
                    number = value if re.fullmatch(r"[1-9]\d*", value or "") else "0"
                    if name in spans and not 1 <= int(number) <= 100:
                        self.found.add("invalid span")
            elif attrs:
                self.found.add("attributes")
            self.stack.append(tag)

        def handle_endtag(self, tag):
            if tag in self.stack:
                while self.stack.pop() != tag:
                    pass

        def handle_data(self, data):
            if data.strip() and not ({"td", "th"} & set(self.stack)):
                self.found.add("text outside cells")

    order = [
        "comments", "text outside cells", "forbidden elements", "no table", "nested tables",
        "cell attributes", "invalid span", "attributes", "no rows", "no cells",
    ]

    def check(value):
        if not value.strip():
            return "missing"
        reader = Check()
        reader.feed(value)
        reader.close()
        if not reader.tables:
            reader.found.add("no table")
        if any(rows == 0 for rows, _ in reader.tables):
            reader.found.add("no rows")
        elif any(cells == 0 for _, cells in reader.tables):
            reader.found.add("no cells")
        return next((item for item in order if item in reader.found), None)

    return check


def safe_table_issue(c: Column) -> Column:
    """Why a table fragment must not be published; NULL when it is safe."""
    check = _build_table_check()

    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda v: check(v) if isinstance(v, str) else "missing")

    apply.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(apply, StringType())(c)

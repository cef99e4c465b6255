"""Record extraction from saved pages.

Rules are data: an ordered list of selectors for the blocks and, per field, an ordered list whose
first non-empty value counts.  A page becomes its elements once (``sources.markup``); selecting
runs on them as Spark expressions, in one pass over the page column and without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.functions.rules import star_from_label
from forecourt.functions.text import SPACE, let, strip
from forecourt.session import posexplode_once
from forecourt.sources.markup import with_elements


@dataclass(frozen=True)
class Select:
    """An element by its tag, a class, an attribute it has (that contains ``part``) and what it is in.

    ``itself`` stands for the block in place of the elements in it.
    """

    tag: str = ""
    cls: str = ""
    attribute: str = ""
    part: str = ""
    inside: Select | None = None
    itself: bool = False

    def own(self, e: Column) -> Column:
        attributes, tests = e["attributes"], []
        if self.tag:
            tests.append(e["tag"] == self.tag)
        if self.cls:
            tests.append(F.array_contains(F.split(attributes["class"], f"[{SPACE}]+"), self.cls))
        if self.attribute:
            tests.append(attributes[self.attribute].contains(self.part) if self.part
                         else F.map_contains_key(attributes, self.attribute))
        return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))

    def of(self, elements: Column, page: Column) -> Column:
        """Those of the elements that match; ``page`` has all elements of the page."""
        found = F.filter(elements, self.own)
        if self.inside is None:
            return found
        return let(self.inside.of(page, page), lambda outer: F.filter(found, lambda e: F.exists(
            outer, lambda o: (o["first"] < e["first"]) & (e["first"] < o["last"]))))

    def attributes(self) -> set[str]:
        own = {"class"} if self.cls else set()
        own |= {self.attribute} if self.attribute else set()
        return own | (self.inside.attributes() if self.inside else set())


@dataclass(frozen=True)
class PageRules:
    """Selectors, in order of trial."""

    blocks: tuple[Select, ...]
    author: tuple[Select, ...] = ()
    stars: tuple[Select, ...] = ()
    text: tuple[Select, ...] = ()
    date: tuple[Select, ...] = ()

    def wanted(self) -> frozenset[str]:
        """The attributes that the selectors ask for."""
        return frozenset({LABEL}).union(*(s.attributes() for f in fields(self) for s in getattr(self, f.name)))


# FIXED VALUES: the markers of saved review pages, in order of trial.
LABEL = "aria-label"
REVIEW_PAGE = PageRules(
    blocks=(
        Select("div", attribute="data-review-id"),
        Select("div", cls="jftiEf"),
        Select("div", cls="review-block"),
        Select("div", attribute="class", part="review"),
    ),
    author=(
        Select("button", attribute="data-review-id"),
        Select(cls="d4r55"),
        Select("span", attribute="class", part="author"),
        Select(cls="section-review-owner-name"),
        Select("button", cls="al6Kxe"),
    ),
    stars=(
        Select("span", attribute=LABEL, part="star"),
        Select(cls="kvMYJc"),
        Select("span", attribute="class", part="star"),
    ),
    text=(
        Select("span", cls="wiI7pd"),
        Select(cls="review-full-text"),
        Select("span", attribute="class", part="review"),
        Select(cls="section-review-text"),
        Select("span", inside=Select("div", attribute="data-review-id")),
    ),
    date=(
        Select("span", cls="rsqaWe"),
        Select(cls="section-review-publish-date"),
        Select("span", attribute="class", part="date"),
    ),
)


def page_blocks(elements: Column, selectors: tuple[Select, ...]) -> Column:
    """The elements of the first selector that finds any; later selectors run only if needed."""
    if not selectors:
        return F.filter(elements, lambda e: F.lit(False))
    rest = page_blocks(elements, selectors[1:])
    return let(selectors[0].of(elements, elements), lambda found: F.when(F.size(found) > 0, found).otherwise(rest))


def extract_records(
    pages: DataFrame,
    html: str,
    keys: list[str],
    page_rules: PageRules = REVIEW_PAGE,
    cap: int | None = None,
) -> DataFrame:
    """One row per block of each page, in page order.

    The first block selector that finds an element decides; a block within a block is a row of
    its own.  A field is the text, without white space at its ends, of the first element
    that its selector finds in the block, if that is not empty; else the next selector's.  ``cap`` is a limit per page for callers
    that state one.  Blocks with neither author nor text are dropped.
    """
    blocks = page_blocks(F.col("elements"), page_rules.blocks)
    if cap is not None:
        blocks = F.slice(blocks, 1, cap)
    read = with_elements(pages, html, keys, page_rules.wanted())
    rows = posexplode_once(read, [*keys, "visible", "elements"], blocks, "block")
    inner = F.slice("elements", F.col("block.first") + 2, F.greatest(F.col("block.last") - F.col("block.first") - 1, F.lit(0)))
    rows = rows.withColumn("inner", inner)

    def first(selector: Select) -> Column:
        found = F.array("block") if selector.itself else F.col("inner")
        return F.get(selector.of(found, F.col("elements")), F.lit(0))

    def text(selectors: tuple[Select, ...]) -> Column:
        tries = [F.nullif(let(first(s), lambda e: strip(F.substring(
            F.col("visible"), e["start"] + 1, e["end"] - e["start"]))), F.lit("")) for s in selectors]
        return F.coalesce(*tries, F.lit(""))
    stars = [star_from_label(first(s)["attributes"][LABEL]) for s in page_rules.stars]
    found = rows.select(
        *keys, "pos", text(page_rules.author).alias("author_name"),
        F.coalesce(*stars, F.lit(None).cast("double")).alias("rating"),
        text(page_rules.text).alias("text"), text(page_rules.date).alias("date_relative"))
    return found.where((F.col("author_name") != "") | (F.col("text") != ""))

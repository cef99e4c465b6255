"""Keyword scoring: issue categories, aspects and review quality.

A keyword counts when it occurs anywhere in the lower-case text, inside words
too, and counts once however often it occurs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from forecourt import lexicon as lx
from forecourt.functions.keywords import found_keywords
from forecourt.functions.text import let, split_words


def _lower(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _among(found: Column, start: int, keywords: list[str]) -> Column:
    """How many of the found keywords are among those that start at a place of the list."""
    return F.size(F.filter(found, lambda i: i.between(start, start + len(keywords) - 1)))


def issue_words(table: dict[str, list[str]] | None = None) -> list[str]:
    return [k for kws in (lx.ISSUE_KEYWORDS if table is None else table).values() for k in kws]


def keywords_of(text: Column, words: list[str]) -> Column:
    """The places of the keywords that occur in a text, whatever their case."""
    return found_keywords(_lower(text), words)


def issue_scores(
    text: Column, table: dict[str, list[str]] | None = None, found: Column | None = None
) -> Column:
    """array<struct<n, o, name>> of the categories hit, best first.

    One array serves both the single label and the tags, so the text is read
    once.  Equal scores keep table order.  ``found`` may hold the text's places of
    keywords, if those of the table come first among them.
    """
    table = lx.ISSUE_KEYWORDS if table is None else table

    def score(found: Column) -> Column:
        rows, start = [], 0
        for i, (name, kws) in enumerate(table.items()):
            rows.append(F.struct(_among(found, start, kws).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")))
            start += len(kws)
        return F.array(*rows)

    found = keywords_of(text, issue_words(table)) if found is None else found
    hit = F.filter(let(found, score), lambda s: s["n"] > 0)
    return F.sort_array(hit, asc=False)


def primary_issue(scores: Column, other: str = lx.OTHER) -> Column:
    return F.coalesce(F.get(scores, F.lit(0))["name"], F.lit(other))


def issue_tags(scores: Column, top_n: int, other: str = lx.OTHER) -> Column:
    names = F.transform(F.slice(scores, 1, top_n), lambda s: s["name"])
    return F.when(F.size(scores) == 0, F.array(F.lit(other))).otherwise(names)


def classify_issue(text: Column, table=None) -> Column:
    return primary_issue(issue_scores(text, table))


def classify_issues(text: Column, top_n: int = 2, table=None) -> Column:
    return let(issue_scores(text, table), lambda s: issue_tags(s, top_n))


def aspect_sentiment(
    text: Column, aspects=None, positive=None, negative=None
) -> Column:
    """map<aspect, polarity>; the polarity belongs to the whole text."""
    aspects = lx.ASPECT_KEYWORDS if aspects is None else aspects
    positive = lx.POSITIVE_SIGNALS if positive is None else positive
    negative = lx.NEGATIVE_SIGNALS if negative is None else negative
    lists = [*aspects.values(), positive, negative]
    starts = [sum(map(len, lists[:i])) for i in range(len(lists))]

    def told(found: Column) -> Column:
        *counts, pos, neg = (_among(found, at, kws) for at, kws in zip(starts, lists, strict=True))
        polarity = (
            F.when(pos > neg, lx.POSITIVE).when(neg > pos, lx.NEGATIVE).otherwise(lx.NEUTRAL)
        )
        named = F.filter(F.array(*[F.when(n > 0, F.lit(name)) for name, n in zip(aspects, counts, strict=True)]),
                         lambda a: a.isNotNull())
        return let(
            polarity,
            lambda p: F.map_from_entries(F.transform(named, lambda a: F.struct(a, p))),
        )

    return let(keywords_of(text, [k for kws in lists for k in kws]), told)


def quality_score(text: Column, specific=None, hits: Column | None = None) -> Column:
    """0-100 from length, share of distinct words and ``hits``, the number of specific keywords."""
    specific = lx.SPECIFIC_KEYWORDS if specific is None else specific
    bonus = F.size(keywords_of(text, specific)) if hits is None else hits

    def score(both: Column) -> Column:
        ws = both["words"]
        n = F.size(ws)
        distinct = F.size(F.array_distinct(ws))
        points = (
            F.least(F.lit(40), n * 2)
            + F.floor(distinct.cast("double") / n * 30).cast("int")
            + F.least(F.lit(30), both["bonus"] * 10)
        )
        return (
            F.when(n == 0, F.lit(0)).when(n < 3, F.lit(5)).otherwise(F.least(F.lit(100), points))
        )

    words = split_words(F.coalesce(text, F.lit("")))
    return let(F.struct(words.alias("words"), bonus.alias("bonus")), score)

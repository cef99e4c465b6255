"""From a five-class distribution to a sentiment record."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from forecourt import lexicon as lx
from forecourt.functions.rules import star_sentiment
from forecourt.functions.text import SPACE, WORD, let


def softmax(logits: Column) -> Column:
    """Stable softmax of an array of doubles."""
    def normalise(exps: Column) -> Column:
        total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
        return let(total, lambda t: F.transform(exps, lambda x: x / t))

    def exponents(v: Column) -> Column:
        return let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))

    return let(let(logits, exponents), normalise)


def result(probabilities: Column) -> Column:
    """struct<sentiment, confidence, star, prob_negative, prob_neutral, prob_positive>."""
    def build(p: Column) -> Column:
        top = F.array_max(p)
        star = F.array_position(p, top).cast("int")
        return F.struct(
            star_sentiment(star).alias("sentiment"),
            top.alias("confidence"),
            star.alias("star"),
            (p[0] + p[1]).alias("prob_negative"),
            p[2].alias("prob_neutral"),
            (p[3] + p[4]).alias("prob_positive"),
        )
    return let(probabilities, build)


def override_pattern(patterns: list[str] | None = None) -> str:
    """One alternation with Unicode white space and word edges.

    A pattern may open with a word edge before a word character and close with
    one after a word character; these become plain look-arounds.
    """
    patterns = lx.NEGATIVE_OVERRIDES if patterns is None else patterns
    edge = r"\b"
    after_edge, anywhere = [], []
    for p in patterns:
        before, after = p.startswith(edge), p.endswith(edge)
        core = p.removeprefix(edge).removesuffix(edge)
        if edge in core:
            raise ValueError(f"word edge inside a pattern: {p}")
        (after_edge if before else anywhere).append(
            core.replace(r"\s", f"[{SPACE}]") + (f"(?![{WORD}])" if after else ""))
    out = list(anywhere)
    if after_edge:
        # One look back for all, and only where one of them can start.
        plain = all(re.match(r"[A-Za-z](?![?*{])[^|]*$", c) for c in after_edge)
        letters = {c[0] for c in after_edge} if plain else set()
        first = f"(?=[{''.join(sorted(letters))}])" if letters else ""
        out.append(f"{first}(?<![{WORD}])(?:{'|'.join(after_edge)})")
    return "(?iu)" + "|".join(out)


def hard_negative(text: Column, patterns: list[str] | None = None) -> Column:
    return F.coalesce(text.rlike(override_pattern(patterns)), F.lit(False))


def apply_override(text: Column, res: Column, patterns: list[str] | None = None) -> Column:
    """Turn a Positive result Negative when the text names a hard complaint."""
    flip = (res["sentiment"] == lx.POSITIVE) & hard_negative(text, patterns)

    def record(flip: Column) -> Column:
        def pick(changed: Column, name: str) -> Column:
            return F.when(flip, changed).otherwise(res[name]).alias(name)

        return F.struct(
            pick(F.lit(lx.NEGATIVE), "sentiment"),
            res["confidence"].alias("confidence"),
            pick(F.lit(lx.OVERRIDE_STAR), "star"),
            pick(F.greatest(res["prob_negative"], F.lit(lx.OVERRIDE_NEGATIVE_FLOOR)),
                 "prob_negative"),
            res["prob_neutral"].alias("prob_neutral"),
            pick(F.least(res["prob_positive"], F.lit(lx.OVERRIDE_POSITIVE_CEILING)),
                 "prob_positive"),
        )
    return let(flip, record)  # the text is searched once, not for every field

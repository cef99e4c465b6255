"""Text cleaning and tokenising as column expressions.

Spark's ``\\w`` and ``\\s`` cover ASCII only.  Review text is multilingual, so
the character classes are spelled out: a word character is a letter, a digit of
any script or the underscore, and white space is the Unicode set, including the
no-break space.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from forecourt import lexicon as lx

WORD = r"\p{L}\p{N}_"
SPACE = (
    r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

SPACE_CHARS = "".join(
    chr(c)
    for low, high in [
        (0x9, 0xD), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
        (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
        (0x3000, 0x3000),
    ]
    for c in range(low, high + 1)
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    The optimizer may copy a projected expression into every place that uses it.
    Inside a lambda that would repeat, say, ``lower(text)`` per keyword; a bound
    lambda variable is evaluated once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def not_blank(text: Column) -> Column:
    """True when the text has at least one character that is not white space."""
    return F.coalesce(text.rlike(f"[^{SPACE}]"), F.lit(False))


def _drop_links(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"http[^{SPACE}]+", "")


def model_text(text: Column, max_chars: int | None = None) -> Column:
    """Text for the scorer: no links, basic punctuation kept.

    ``max_chars`` is the input window of the scoring model; ``None`` keeps the
    whole text.
    """
    kept = strip(F.regexp_replace(_drop_links(text), rf"[^{WORD}{SPACE},.!?'\-]", " "))
    return kept if max_chars is None else F.substring(kept, 1, max_chars)


def mining_text(text: Column) -> Column:
    """Text for counting words: no links, no punctuation, lower case."""
    return strip(F.lower(F.regexp_replace(_drop_links(text), f"[^{WORD}{SPACE}]", " ")))


def split_words(text: Column) -> Column:
    """White-space separated words; a blank text has none."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def _keep(tokens: Column, stop_words: list[str], min_len: int = 1) -> Column:
    # A long IN list becomes a hash-set test, also inside a lambda.
    if not stop_words:
        return F.filter(tokens, lambda w: F.length(w) >= min_len)
    return F.filter(tokens, lambda w: (F.length(w) >= min_len) & ~w.isin(stop_words))


def tokenize(text: Column, stop_words: list[str] | None = None) -> Column:
    """Mining tokens: words of three or more characters that are no stop words.

    They are the words of ``mining_text``, found by one search.  No letter's lower case has more
    than two characters, so a run of one can be left out before that is known.
    """
    stop = lx.DEFAULT.mining_stop_words if stop_words is None else stop_words
    runs = F.regexp_extract_all(_drop_links(text), F.lit(f"[{WORD}]{{2,}}"), F.lit(0))
    return _keep(F.transform(runs, F.lower), stop, 3)


def word_tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Runs of two or more word characters, lower case, stop words removed."""
    stop = lx.DEFAULT.mining_stop_words if stop_words is None else stop_words
    runs = F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[{WORD}]{{2,}}"), F.lit(0)
    )
    return _keep(runs, stop) if stop else runs


def keyword_tokens(text: Column) -> Column:
    """Whole words made of three or more letters a-z (stop words still in)."""
    pattern = f"(?<![{WORD}])[a-z]{{3,}}+(?![{WORD}])"
    return F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0)
    )


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined runs of ``n`` neighbouring tokens."""
    if n == 1:
        return tokens

    def grams(ts: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(ts) - n)
        joined = F.transform(
            starts, lambda i: F.concat_ws(" ", *[F.get(ts, i + k) for k in range(n)])
        )
        return F.when(F.size(ts) >= n, joined).otherwise(F.array().cast("array<string>"))

    return let(tokens, grams)


def fill_empty(tokens: Column, document: str) -> Column:
    """Give a document without tokens a fixed stand-in text."""
    stand_in = F.array(*[F.lit(w) for w in document.split()])
    return let(tokens, lambda ts: F.when(F.size(ts) == 0, stand_in).otherwise(ts))

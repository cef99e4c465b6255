"""Which of many keywords occur in a text, by one pass of an automaton over it."""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE_ROWS = 64  # rows of a batch that are Python strings at a time


def found_keywords(low: Column, keywords: list[str]) -> Column:
    """array<int>: ascending places of the keywords that occur anywhere in a text, inside words too.

    The time of a text does not grow with the number of keywords.  A null text and one without
    keywords give an empty array; the empty keyword occurs in every text.  Without the
    pyahocorasick library each keyword is searched by itself, with the same result.
    """
    places: dict[str, list[int]] = {}
    for i, k in enumerate(keywords):
        places.setdefault(k, []).append(i)
    always = places.pop("", [])
    text = F.coalesce(low, F.lit(""))
    if not places:
        return F.array(*map(F.lit, always)).cast("array<int>")
    if importlib.util.find_spec("ahocorasick") is None:
        each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(keywords)])
        return F.transform(F.filter(each, lambda e: F.contains(text, e["k"])), lambda e: e["i"])

    def search(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick
        automaton = ahocorasick.Automaton()
        for k, own in places.items():
            automaton.add_word(k, own)
        automaton.make_automaton()
        for batch in texts:
            ends, flat = [0], []
            for t in (t for i in range(0, len(batch), PIECE_ROWS) for t in batch.slice(i, PIECE_ROWS).to_pylist()):
                here = {id(own): own for _, own in automaton.iter(t)}
                flat += sorted([*always, *(i for own in here.values() for i in own)])
                ends.append(len(flat))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
    search.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(search, "array<int>")(text)

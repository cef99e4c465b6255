"""Token counts by rank-synchronous merging of ragged arrays (operator 4)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from forecourt.llm.batches import append, fresh
from forecourt.llm.pretokens import NONE, Codes, Vocabulary, ragged, vocabulary

KNOWN_CHUNKS = 300_000


def surviving(ids: np.ndarray, lengths: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Number of symbols left of each sequence once no pair can be merged.

    All sequences lie one after another in one array.  A round finds the lowest pair
    rank of every sequence, merges that pair wherever it stands in its sequence (left
    to right, no overlaps) for all sequences at once, and closes the gaps.  Finished
    sequences leave the array.  Sequences must not be empty.
    """
    left = np.zeros(len(lengths), np.int64)
    at = np.arange(len(lengths))
    while len(at):
        starts = lengths.cumsum() - lengths
        rank = np.full(len(ids), NONE, np.int32)
        rank[:-1] = vocab.ranks(ids[:-1], ids[1:])
        rank[starts + lengths - 1] = NONE  # no pair reaches into the next sequence
        lowest = np.minimum.reduceat(rank, starts)
        live = lowest < NONE
        if not live.all():
            left[at[~live]] = lengths[~live]
            keep = np.repeat(live, lengths)
            ids, rank = ids[keep], rank[keep]
            at, lengths, lowest = at[live], lengths[live], lowest[live]
            if not len(at):
                break
            starts = lengths.cumsum() - lengths
        hit = rank == np.repeat(lowest, lengths)
        place = np.arange(len(ids))
        run_start = np.maximum.accumulate(np.where(hit, -1, place))
        hit &= (place - run_start) % 2 == 1  # of pairs that overlap, every second one
        where = np.flatnonzero(hit)
        ids[where] = vocab.merged[rank[where]]
        keep = np.ones(len(ids), bool)
        keep[where + 1] = False
        ids = ids[keep]
        lengths = lengths - np.add.reduceat(hit.astype(np.int64), starts)
    return left


class Counter:
    """Token counts of texts; counts of recent chunks are kept up to a fixed number."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._forget()

    def _forget(self) -> None:
        self.codes, self.known = Codes(self.vocab), np.zeros(0, np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        if len(self.codes) > KNOWN_CHUNKS:
            self._forget()
        code, sizes = self.codes.of(texts)
        if self.codes.new:
            words, places, per_chunk = self.codes.take_new()
            counts = surviving(*ragged(words, self.vocab), self.vocab)[places]
            total = np.concatenate(([0], counts.cumsum()))
            ends = per_chunk.cumsum()
            self.known = np.concatenate([self.known, total[ends] - total[ends - per_chunk]])
        total = np.concatenate(([0], self.known[code].cumsum()))
        ends = sizes.cumsum()
        return total[ends] - total[ends - sizes]


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit of every whole text.

    A null or empty text has 0 bytes and 0 tokens.  Special tokens in a text count as
    one token each.  Repeated rows are counted each, an empty frame stays empty, and a
    taken column name gets an underscore.
    """
    made: list[Counter] = []  # one per task; its words go when the task ends

    def run(offsets, raw):
        if not made:
            made.append(Counter(vocabulary(path)))
        data = raw.tobytes()
        texts = [data[a:b].decode("utf-8", "replace")
                 for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        n = made[0].count(texts)
        return [np.diff(offsets), n, n > limit]
    return append(docs, text, run, [
        T.StructField(fresh(docs, "n_bytes"), T.LongType()),
        T.StructField(fresh(docs, "n_tokens"), T.LongType()),
        T.StructField(fresh(docs, "over_limit"), T.BooleanType())])

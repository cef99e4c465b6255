"""BPE encoding and decoding over a contiguous rank array (operator 2)."""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from forecourt.llm.batches import append, fresh, ship
from forecourt.llm.pretokens import NONE, Codes, Vocabulary, ragged, take_ragged, vocabulary

SHORT = 96
KNOWN_CHUNKS = 300_000


def merge_short(parts: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merge words of one length: (ids padded with -1, token counts).

    Each row holds a word's parts and, beside them, the ranks of its adjacent pairs,
    both contiguous.  A step scans every row for its minimum (the leftmost of equal
    ones), deletes that boundary and looks the two neighbouring ranks up again; rows
    without a rank are finished.
    """
    rows, width = parts.shape
    out, count = np.full((rows, width), -1, np.int32), np.zeros(rows, np.int64)
    at = np.arange(rows)
    ranks = vocab.ranks(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(rows, width - 1)
    while len(at):
        width = parts.shape[1]
        if width > 1:
            j = ranks.argmin(axis=1)
            best = ranks[np.arange(len(at)), j]
            done = best == NONE
        else:
            done = np.ones(len(at), bool)
        if done.any():
            out[at[done], :width] = parts[done]
            count[at[done]] = width
            at, parts = at[~done], parts[~done]
            if not len(at):
                break
            ranks, j, best = ranks[~done], j[~done], best[~done]
        row = np.arange(len(at))
        parts[row, j] = vocab.merged[best]
        keep = np.ones(parts.shape, bool)
        keep[row, j + 1] = False
        parts = parts[keep].reshape(len(at), width - 1)
        keep = np.ones(ranks.shape, bool)
        keep[row, j] = False
        ranks = ranks[keep].reshape(len(at), width - 2)
        left = np.flatnonzero(j > 0)
        right = np.flatnonzero(j < width - 2)
        ranks[left, j[left] - 1] = vocab.ranks(parts[left, j[left] - 1], parts[left, j[left]])
        ranks[right, j[right]] = vocab.ranks(parts[right, j[right]], parts[right, j[right] + 1])
    return out, count


def merge_long(ids: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Merge one long word: the same order of merges from a heap of ranks."""
    parts, n = ids.tolist(), len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ranks = vocab.ranks(ids[:-1], ids[1:])
    heap = [(int(r), i, parts[i], parts[i + 1]) for i, r in enumerate(ranks) if r != NONE]
    heapq.heapify(heap)

    def push(i: int, k: int) -> None:
        r = int(vocab.ranks(np.array([parts[i]]), np.array([parts[k]]))[0])
        if r != NONE:
            heapq.heappush(heap, (r, i, parts[i], parts[k]))

    while heap:
        rank, i, a, b = heapq.heappop(heap)
        k = after[i]
        if parts[i] != a or k >= n or parts[k] != b:
            continue
        parts[i], parts[k] = int(vocab.merged[rank]), -1
        after[i] = after[k]
        if after[k] < n:
            before[after[k]] = i
            push(i, after[k])
        if before[i] >= 0:
            push(before[i], i)
    return np.array([p for p in parts if p >= 0], np.int32)


class Encoder:
    """Ids of texts; results of recent chunks are kept up to a fixed number."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._forget()
        blobs = [vocab.bytes_of.get(i, b"") for i in range(vocab.size)]
        self.token_bytes = np.frombuffer(b"".join(blobs), np.uint8)
        self.token_length = np.array([len(b) for b in blobs], np.int64)
        self.token_start = self.token_length.cumsum() - self.token_length
        digits = [f"{i}," .encode() for i in range(vocab.size)]
        self.digit_bytes = np.frombuffer(b"".join(digits), np.uint8)
        self.digit_length = np.array([len(b) for b in digits], np.int64)
        self.digit_start = self.digit_length.cumsum() - self.digit_length

    def _forget(self) -> None:
        self.codes = Codes(self.vocab)
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def _learn(self) -> None:
        words, places, sizes = self.codes.take_new()
        ids, lengths = ragged(words, self.vocab)
        starts = lengths.cumsum() - lengths
        out: list[np.ndarray] = [np.zeros(0, np.int32)]
        order: list[np.ndarray] = [np.zeros(0, np.int64)]
        counts = np.zeros(len(words), np.int64)
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            if n > SHORT:
                for k in own:
                    got = merge_long(ids[starts[k]:starts[k] + n], self.vocab)
                    counts[k] = len(got)
                    out.append(got)
            else:
                parts = ids[starts[own][:, None] + np.arange(n)]
                got, counts[own] = merge_short(parts, self.vocab)
                out.append(got[got >= 0])
            order.append(own)
        flat, order = np.concatenate(out), np.concatenate(order)
        begin = np.zeros(len(words), np.int64)
        begin[order] = counts[order].cumsum() - counts[order]
        flat = flat[take_ragged(begin[places], counts[places])]  # chunk after chunk
        total = np.concatenate(([0], counts[places].cumsum()))
        ends = sizes.cumsum()
        self.start = np.concatenate([self.start, total[ends - sizes] + len(self.flat)])
        self.length = np.concatenate([self.length, total[ends] - total[ends - sizes]])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        if len(self.codes) > KNOWN_CHUNKS:
            self._forget()
        code, sizes = self.codes.of(texts)
        if self.codes.new:
            self._learn()
        lengths = self.length[code]
        total = np.concatenate(([0], lengths.cumsum()))
        ends = sizes.cumsum()
        return self.flat[take_ragged(self.start[code], lengths)], total[ends] - total[ends - sizes]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of the ids; bytes that are no UTF-8 become replacement characters."""
        return [b.decode("utf-8", "replace") for b in self._spread(
            ids, counts, self.token_bytes, self.token_start, self.token_length)]

    def decimals(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The ids of each text in decimal, joined by commas."""
        return [b[:-1] for b in self._spread(
            ids, counts, self.digit_bytes, self.digit_start, self.digit_length)]

    @staticmethod
    def _spread(ids, counts, blob, start, length) -> list[bytes]:
        lengths = length[ids]
        raw = blob[take_ragged(start[ids], lengths)].tobytes()
        total = np.concatenate(([0], lengths.cumsum()))
        ends = counts.cumsum()
        return [raw[a:b] for a, b in zip(total[ends - counts].tolist(), total[ends].tolist(),
                                         strict=True)]


def encoder(path: str):
    """A function that gives one encoder per task; its words go when the task ends."""
    made: list[Encoder] = []

    def get() -> Encoder:
        if not made:
            made.append(Encoder(vocabulary(path)))
        return made[0]
    return get


def _texts(offsets: np.ndarray, raw: np.ndarray) -> list[str]:
    data = raw.tobytes()
    return [data[a:b].decode("utf-8", "replace")
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of every whole text as an array column.

    A null or empty text has no ids.  Special tokens in a text get their own id, as
    the tokenizers library does by default.  Rows stay as they are: repeated rows are
    encoded each, an empty frame stays empty, and a taken column name gets an
    underscore.
    """
    tool = encoder(path)

    def run(offsets, raw):
        got, counts = tool().encode(_texts(offsets, raw))
        return [np.split(got, counts.cumsum()[:-1])]
    return append(docs, text, run, [T.StructField(fresh(docs, ids), T.ArrayType(T.IntegerType()))])


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of an array of ids; null ids give null, ids out of range fail."""
    ship(docs.sparkSession)
    field = T.StructField(fresh(docs, text), T.StringType())
    schema = T.StructType([*docs.schema.fields, field])

    tool = encoder(path)

    def run(frames):
        for frame in frames:
            frame[field.name] = [
                None if x is None else tool().decode(np.asarray(x, np.int64), np.array([len(x)]))[0]
                for x in frame[ids]]
            yield frame
    return docs.mapInPandas(run, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256: encoded, then decoded again.

    The ids of a text exist only inside the task that makes them, so the result is a
    few bytes per document.  Nulls, ties and empty frames as in ``encode``.
    """
    fields = [T.StructField(fresh(docs, "n_tokens"), T.LongType()),
              T.StructField(fresh(docs, "ids_sha256"), T.StringType()),
              T.StructField(fresh(docs, "decoded_sha256"), T.StringType())]

    tool = encoder(path)

    def run(offsets, raw):
        ids, counts = tool().encode(_texts(offsets, raw))
        return [counts,
                [hashlib.sha256(b).hexdigest() for b in tool().decimals(ids, counts)],
                [hashlib.sha256(t.encode()).hexdigest() for t in tool().decode(ids, counts)]]
    return append(docs, text, run, fields)

"""Topic model: vocabulary, variational fit, labels and tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from forecourt import lexicon as lx
from forecourt.functions.rules import topic_label
from forecourt.functions.text import fill_empty, let, tokenize
from forecourt.operators.textmining import coded_terms, frequent_phrases
from forecourt.session import send_code, stage

SHIFT = 6  # below it digamma and log gamma go by their recurrence
BLOCK, MOST_EMPTY = 1 << 18, 16  # cells of a block of documents by terms; cells for each that is not zero
ROW_TERMS, ROWS = 1 << 10, 64  # terms and documents in a packed row; rows that a pass takes at once


@dataclass
class TopicModel:
    """A fit: its terms, the topics' parameters (topics x terms), the documents' and the bounds."""

    terms: list[str]
    topics: np.ndarray
    documents: DataFrame
    bounds: list[float]
    key: str


def digamma(x: np.ndarray) -> np.ndarray:
    below = sum(1.0 / (x + i) for i in range(SHIFT))
    y = x + SHIFT
    z = 1.0 / (y * y)
    return np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132)))) - below


def log_gamma(x: np.ndarray) -> np.ndarray:
    below = sum(np.log(x + i) for i in range(SHIFT))
    y = x + SHIFT
    z = 1.0 / (y * y)
    tail = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + tail - below


def dirichlet_bound(parameters: np.ndarray, expected_log: np.ndarray, prior: float) -> float:
    """What rows of Dirichlet parameters add to the bound: expected log prior minus log density."""
    n, k = parameters.shape
    own = log_gamma(parameters).sum() - log_gamma(parameters.sum(axis=1)).sum()
    constant = float(log_gamma(np.array([k * prior]))[0] - k * log_gamma(np.array([prior]))[0])
    return float(((prior - parameters) * expected_log).sum() + own + n * constant)


def start(terms: list[str], frequency: np.ndarray, n_topics: int) -> np.ndarray:
    """The fixed start: each term's frequency dealt over the topics, uneven by a hash of both."""
    def share(k: int, term: str) -> float:
        return 0.5 + int(hashlib.md5(f"{k}:{term}".encode()).hexdigest()[:8], 16) / 2**32
    shares = np.array([[share(k, t) for t in terms] for k in range(n_topics)])
    return frequency / n_topics * shares


class Step:
    """One round of documents: their parameters move, and what each gives to its topics adds up.

    With the topics fixed, a document's term shares and its own parameters take turns ``turns``
    times; each turn raises the bound.  The last shares are what the topics get.
    """

    def __init__(self, topics: np.ndarray, prior: float, turns: int):
        self.expected = (digamma(topics) - digamma(topics.sum(axis=1))[:, None]).T  # terms x topics
        self.prior, self.turns = prior, turns
        self.given = np.zeros_like(self.expected)
        self.bound = 0.0

    def of(self, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        """New parameters of documents whose terms lie one after another."""
        doc = np.repeat(np.arange(len(sizes)), sizes)
        beta = np.exp(self.expected)
        # A table of documents by terms is quicker than one value per term, where it is not mostly empty.
        if len(beta) * len(sizes) > MOST_EMPTY * len(terms):
            return self._of_few(terms, counts, doc, gamma, beta)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        block = max(1, BLOCK // len(beta))
        moved = [self._of_block(terms[ends[i]:ends[j]], counts[ends[i]:ends[j]], doc[ends[i]:ends[j]] - i, gamma[i:j], beta)
                 for i in range(0, len(sizes), block) for j in [min(i + block, len(sizes))]]
        return np.concatenate(moved)

    def _shares(self, gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        expected = digamma(gamma) - digamma(gamma.sum(axis=1))[:, None]
        return expected, np.exp(expected)

    def _of_block(self, terms, counts, doc, gamma, beta):
        at, ratio = doc * len(beta) + terms, np.zeros((len(gamma), len(beta)))
        for turn in range(self.turns):
            expected, theta = self._shares(gamma)
            total = (theta @ beta.T).ravel()[at]
            if turn == 0:
                self.bound += float(counts @ np.log(total)) + dirichlet_bound(gamma, expected, self.prior)
            ratio.ravel()[at] = counts / total
            gamma = self.prior + theta * (ratio @ beta)
        self.given += beta * (ratio.T @ theta)
        return gamma

    def _of_few(self, terms, counts, doc, gamma, beta):
        beta = beta[terms]
        for turn in range(self.turns):
            expected, theta = self._shares(gamma)
            total = np.einsum("ij,ij->i", theta[doc], beta)
            if turn == 0:
                self.bound += float(counts @ np.log(total)) + dirichlet_bound(gamma, expected, self.prior)
            share = beta * (counts / total)[:, None]
            taken = np.stack([np.bincount(doc, share[:, k], len(gamma)) for k in range(gamma.shape[1])], 1)
            gamma = self.prior + theta * taken
        share *= theta[doc]
        for k in range(gamma.shape[1]):
            self.given[:, k] += np.bincount(terms, share[:, k], len(self.expected))
        return gamma


def term_counts(
    df: DataFrame, key: str, max_features: int, text: str = "text", max_df: float = 0.95,
    stop_words: list[str] | None = None,
) -> tuple[DataFrame, list[str], np.ndarray]:
    """(key, terms, counts) of every document over the most frequent terms; these; their frequencies.

    ``max_features`` is stated by the caller; about that many terms reach the driver.  The tokens are
    written once, so a text is searched once, and so are the rows, which the rounds of a fit read.
    """
    tokens = fill_empty(tokenize(F.col(text), stop_words), lx.EMPTY_TOPIC_DOCUMENT)
    docs = stage(df.select(key, tokens.alias("tokens")), "topic-tokens")
    names, frequency = frequent_phrases(docs, max_features, 2, docs.count() * max_df)
    if not names:
        raise ValueError("no term occurs in two documents")
    words = sorted({w for t in names for w in t.split(" ")})
    at = {w: i for i, w in enumerate(words)}

    def code(first: str, second: str | None = None) -> int:
        return at[first] if second is None else (at[first] + 1) * len(words) + at[second]
    rows = coded_terms(docs, words, {code(*t.split(" ")): i for i, t in enumerate(names)})
    rows = rows.select(key, F.col("terms").cast("array<int>").alias("terms"), "counts")
    return stage(rows, "topic-counts"), names, np.array(frequency)


def fit_topics(
    df: DataFrame, key: str, max_features: int, text: str = "text", n_topics: int = 8,
    passes: int = 20, turns: int = 3, max_df: float = 0.95, stop_words: list[str] | None = None,
) -> TopicModel:
    """Variational LDA over 1- and 2-grams by coordinate ascent.

    Every pass reads every document's term counts and writes them with the document's new
    parameters, some documents packed in a row, so that they are copied and not converted one by one; beside them
    each task writes the sums that its documents give to the topics, which then add up to ``n_topics`` x
    ``max_features`` numbers, the only ones on the driver.  A lost executor costs a task of one pass.
    The start is fixed, so a fit can be repeated, and no pass lowers the bound.  ``bounds`` holds
    it before each pass.
    """
    send_code(df.sparkSession)
    prior = 1.0 / n_topics
    rows, names, frequency = term_counts(df, key, max_features, text, max_df, stop_words)
    topics = start(names, frequency, n_topics)
    field = rows.schema[key]
    schema = T.StructType([
        T.StructField("keys", T.ArrayType(field.dataType)), T.StructField("found", T.BinaryType()),
        T.StructField("sizes", T.BinaryType()), T.StructField("gamma", T.BinaryType()),
        T.StructField("given", T.ArrayType(T.DoubleType()))])
    state = rows.select(key, "terms", "counts").mapInArrow(_packed(prior, n_topics, schema), schema)
    bounds: list[float] = []
    for _ in range(passes):
        moved = state.where("given is null").select(schema.fieldNames()).mapInArrow(
            _pass(topics, prior, turns, schema), schema)
        state = stage(moved, "topic-pass")
        sums = state.where("given is not null").select(F.posexplode("given")).groupBy("pos").agg(F.sum("col")).collect()
        given = np.zeros(topics.size + 1)
        for pos, value in sums:
            given[pos] = value
        expected = digamma(topics) - digamma(topics.sum(axis=1))[:, None]
        bounds.append(float(given[-1]) + dirichlet_bound(topics, expected, prior))
        topics = prior + given[:-1].reshape(len(names), n_topics).T
    unpacked = T.StructType([T.StructField(key, field.dataType), T.StructField("gamma", T.ArrayType(T.DoubleType()))])
    documents = state.where("given is null").select("keys", "gamma").mapInArrow(_unpacked(n_topics, unpacked), unpacked)
    return TopicModel(names, topics, documents, bounds, key)


def _pack(values: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """Numbers that lie one after another as one value per row; a row's end where ``ends`` says."""
    at = (ends * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def _unpack(column: pa.BinaryArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, how many of them each row has) of packed values."""
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int32)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(kind), np.diff(at) // np.dtype(kind).itemsize


def _packed(prior: float, n_topics: int, schema: T.StructType):
    """Documents that lie side by side in one row, until they have ``ROW_TERMS`` terms."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            terms, counts = batch.column(1), batch.column(2)
            ends = terms.offsets.to_numpy().astype(np.int64)
            ends, numbers = ends - ends[0], counts.flatten().to_numpy()
            sums = np.concatenate([[0], np.cumsum(numbers)])[ends]
            gamma = np.repeat(prior + np.diff(sums) / n_topics, n_topics)
            both = np.stack([terms.flatten().to_numpy(), numbers], 1).astype(np.int32).ravel()
            place = (ends[1:] + np.arange(len(batch))) // ROW_TERMS
            rows = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(batch)]])  # the first document of each
            keys = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [keys.cast(arrow.field(0).type), _pack(both, 2 * ends[rows]), _pack(np.diff(ends).astype(np.int32), rows),
                 _pack(gamma, rows * n_topics), pa.nulls(len(keys), arrow.field(4).type)], schema=arrow)
    return run


def _pass(topics: np.ndarray, prior: float, turns: int, schema: T.StructType):
    arrow, width = to_arrow_schema(schema), len(topics)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = Step(topics, prior, turns)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            terms, counts = _unpack(batch.column(1), np.int32)[0].reshape(-1, 2).T
            sizes, documents = _unpack(batch.column(2), np.int32)
            gamma = _unpack(batch.column(3), np.float64)[0].reshape(-1, width)
            moved = step.of(terms, counts.astype(float), sizes, gamma)
            ends = np.concatenate([[0], np.cumsum(documents)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], _pack(moved.ravel(), ends * width), pa.nulls(len(batch), arrow.field(4).type)], schema=arrow)
        own = [*step.given.ravel().tolist(), step.bound]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, f.type) for f in list(arrow)[:4]] + [pa.array([own], arrow.field(4).type)], schema=arrow)
    return run


def _unpacked(width: int, schema: T.StructType):
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            keys, gamma = batch.column(0).flatten(), pa.array(_unpack(batch.column(1), np.float64)[0])
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * width), gamma)
            yield pa.RecordBatch.from_arrays([keys, rows.cast(arrow.field(1).type)], schema=arrow)
    return run


def distributions(fitted: TopicModel) -> DataFrame:
    """Document key and its weights, one per topic, which add up to 1.

    A document without a term of the vocabulary has equal weights.
    """
    total = F.aggregate("gamma", F.lit(0.0), lambda a, x: a + x)
    return fitted.documents.select(fitted.key, let(total, lambda s: F.transform(
        "gamma", lambda g: g / s)).alias("weights"))


def topic_words(fitted: TopicModel, top_n: int = 10) -> DataFrame:
    """Topic and its top terms by their share of the topic (six digits), equal ones by name."""
    spark = fitted.documents.sparkSession
    share = np.round(fitted.topics / fitted.topics.sum(axis=1)[:, None], 6)
    words = [[t for _, t in sorted(zip(-s, fitted.terms, strict=True))[:top_n]] for s in share]
    # As an Arrow table, which no Python worker has to make rows of.
    return spark.createDataFrame(pa.table({"topic": pa.array(range(len(words)), pa.int32()),
                                           "words": pa.array(words, pa.list_(pa.string()))}))


def labelled_topics(words: DataFrame, table=None, by_words: bool = False) -> DataFrame:
    """Topic, its terms and the name from the label table that shares most of them.

    A topic that shares none has the table's default, or with ``by_words`` its first three terms.
    """
    name = topic_label(F.col("words"), table)
    if by_words:
        none = topic_label(F.col("words"), table, default="")
        name = F.when(none != "", none).otherwise(F.array_join(F.slice("words", 1, 3), " / "))
    return words.withColumn("label", name)


def dominant_topics(weights: DataFrame, key: str, words: DataFrame, table=None, by_words: bool = False) -> DataFrame:
    """Document key, its strongest topic (weights to six digits; of equal ones the first) and label."""
    rounded = F.transform("weights", lambda w: F.round(w, 6))
    best = weights.select(key, let(rounded, lambda w: F.array_position(w, F.array_max(w)) - 1).cast("int").alias("topic"))
    labels = labelled_topics(words, table, by_words).select("topic", "label")  # one row per topic
    return best.join(F.broadcast(labels), "topic")


def topic_frequency(topics: DataFrame) -> DataFrame:
    return topics.groupBy("label").agg(F.count("*").alias("reviews"))


def topic_table(words: DataFrame, width: int = 8, table=None, by_words: bool = False) -> DataFrame:
    """Display terms per topic; topics with equal labels stay apart by id."""
    shown = F.slice(
        F.transform(
            F.filter("words", lambda w: (F.length(w) > 3) & ~w.isin(lx.TOPIC_NOISE_WORDS)),
            F.initcap,
        ), 1, width)
    words = labelled_topics(words, table, by_words).select("topic", "label", shown.alias("shown"))
    padded = F.concat("shown", F.array_repeat(F.lit(""), F.lit(width) - F.size("shown")))
    rows = words.select("topic", "label", F.posexplode(padded).alias("i", "term"))
    return rows.select("topic", "label", (F.col("i") + 1).alias("place"), "term")


def topic_sentiment(topics: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Topic label by sentiment, all three sentiment columns always present."""
    joined = topics.join(facts.select(key, "sentiment"), key)
    return joined.groupBy("label").agg(*[
        F.count_if(F.col("sentiment") == s).alias(s.lower()) for s in lx.SENTIMENTS
    ])

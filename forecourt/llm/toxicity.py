"""Class-conditional Kneser-Ney models of words, letter by letter (operator 5).

One model is counted over toxic texts, one over ordinary texts.  A letter is predicted
from up to seven before it, from the start of its word on.  Both models discount their
own counts and back off to the same continuation counts, so an expression that one class
has rarely or never seen is judged by what both share.  A document's evidence is the
difference of both log-likelihoods divided by its length; beside it stands the share of
clear differences (words beyond 1), in the whole text and in its most toxic stretch of 32
words, since a few insults vanish in the mean of a long text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt.llm.batches import PIECE_BYTES, PIECE_ROWS, append, flat, fresh, pieces, ship, tidy
from forecourt.llm.labels import labelled
from forecourt.llm.pretokens import take_ragged
from forecourt.session import stage

ORDER = 8
TASK_GRAMS = 1 << 20
SHARD_KEYS, RESIDENT = 1 << 20, 8
STRETCH = 32
CLEAR = 1.0
FEATURES = ("mean", "clear", "top")
START, END = 1, 2
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[ord("a"):ord("z") + 1] = True
_IS_LETTER[128:] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """Different words of some texts, each between a start and an end symbol."""

    doc: np.ndarray      # of each word in the texts: its text
    number: np.ndarray   # of each word in the texts: its place among the different words
    symbols: np.ndarray  # the different words, one after another
    lengths: np.ndarray  # with both marks


_LOWER = np.array([ord(low) if len(low := chr(i).lower()) == 1 else i for i in range(0xD800)], np.uint32)


def letters(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, symbols): a byte for each lower-case code point, those above 255 folded into 128-255."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    points = np.where(points < len(_LOWER), _LOWER[np.minimum(points, len(_LOWER) - 1)], points)
    begins = np.concatenate(([0], ((raw & 0xC0) != 0x80).cumsum()))
    return begins[offsets], np.where(points < 256, points, 128 + points % 128).astype(np.uint8)


def words(offsets: np.ndarray, raw: np.ndarray) -> Words:
    """Words are runs of letters a-z and of code points from 128 on, in lower case."""
    offsets, raw = letters(offsets, raw)
    letter = _IS_LETTER[raw]
    joined = np.zeros(len(raw) + 1, bool)
    joined[1:-1] = letter[1:] & letter[:-1]
    joined[offsets] = False
    starts = np.flatnonzero(letter & ~joined[:-1])
    lengths = np.flatnonzero(letter & ~joined[1:]) + 1 - starts
    doc = np.searchsorted(offsets, starts, side="right") - 1
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), none)
    power = np.multiply.accumulate(np.full(int(lengths.max()), 0x100000001B3, np.uint64))
    first = lengths.cumsum() - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    codes = np.add.reduceat((raw[letter].astype(np.uint64) + _MIX) * power[place], first)
    _, where, number = np.unique(codes, return_index=True, return_inverse=True)
    own = lengths[where] + 2
    symbols = np.zeros(int(own.sum()), np.uint64)
    begin = own.cumsum() - own
    symbols[begin], symbols[begin + own - 1] = START, END
    symbols[take_ragged(begin + 1, own - 2)] = raw[take_ragged(starts[where], own - 2)]
    return Words(doc, number, symbols, own)


def grams(w: Words) -> np.ndarray:
    """Of each symbol but the starts: itself and up to seven before it, a byte each."""
    keys, place = w.symbols.copy(), np.arange(len(w.symbols))
    place = place - np.repeat(w.lengths.cumsum() - w.lengths, w.lengths)
    for back in range(1, ORDER):
        own = np.flatnonzero(place >= back)
        keys[own] |= w.symbols[own - back] << np.uint64(8 * back)
    return keys[place > 0]


def gram_counts(rows: DataFrame, text: str) -> DataFrame:
    """Counts by class (t toxic, o ordinary) and by part of the training rows (0 or 2).

    A task adds up its pieces before it sends them, up to ``TASK_GRAMS`` grams at a time.
    """
    names = ["gram", "t0", "o0", "t2", "o2"]

    def joined(found):
        keys, of = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        counts = np.zeros((4, len(keys)), np.int64)
        for g in range(4):
            # Counts are whole numbers far below 2^53, where these sums are exact.
            counts[g] = np.bincount(of, np.concatenate([n[g] for _, n in found]), len(keys))
        for i in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[i:i + (1 << 16)]) for x in (keys.view(np.int64), *counts)], names)

    def run(batches):
        found, size = [], 0
        for batch in batches:
            offsets, raw = flat(batch.column("text"))
            group = (np.asarray(batch.column("part")) // 2 * 2
                     + (1 - np.asarray(batch.column("label"))))
            for i, j in pieces(offsets):
                own = offsets[i:j + 1]
                w = words(own - own[0], raw[own[0]:own[-1]])
                keys, of = np.unique(grams(w), return_inverse=True)
                kinds = len(w.lengths)
                per_word = np.bincount(group[i:j][w.doc] * kinds + w.number, minlength=4 * kinds)
                found.append((keys, [np.bincount(of, np.repeat(per_word[g * kinds:(g + 1) * kinds], w.lengths - 1),
                                                 len(keys)).astype(np.int64) for g in range(4)]))
                size += len(keys)
                if size > TASK_GRAMS:
                    yield from joined(found)
                    found, size = [], 0
        if found:
            yield from joined(found)

    ship(rows.sparkSession)
    plain = rows.select(F.col(text).alias("text"), "part", "label")
    return plain.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in names)).groupBy("gram").agg(
        *(F.sum(c).alias(c) for c in names[1:]))


class Table:
    """Numbers by 64-bit key, every one of them, broadcast in shards of about ``SHARD_KEYS`` keys.

    There are as many shards as the keys need.  The driver holds one at a time, a worker at most
    ``RESIDENT`` (12 MB each); where there are more it loads each when it is asked and drops it again.
    """

    def __init__(self, rows: DataFrame):
        """``rows``: key, value; read more than once."""
        shards = -(-rows.count() // SHARD_KEYS)
        cuts = []
        if shards > 1:
            rows = stage(rows.select("key", "value").sort("key"), "toxicity-shards")  # a shard lies in few files
            cuts = sorted({int(x) for x in rows.approxQuantile(
                "key", [i / shards for i in range(1, shards)], 0.2 / shards)})
        spark, key = rows.sparkSession, F.col("key")
        self.cuts, self.shards = np.array(cuts, np.int64), []
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            own = rows if low is None else rows.where(key >= low)
            got = (own if high is None else own.where(key < high)).select("key", F.col("value").cast("float")).toArrow()
            keys = got.column(0).to_numpy()
            order = keys.argsort()
            self.shards.append(spark.sparkContext.broadcast(
                (keys[order], got.column(1).to_numpy().astype(np.float32)[order])))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys; NaN for keys that are not here."""
        keys = keys.view(np.int64)
        out = np.full(len(keys), np.nan, np.float32)
        of = np.searchsorted(self.cuts, keys, side="right")
        for i, shard in enumerate(self.shards):
            own = np.flatnonzero(of == i)
            known, values = shard.value if len(own) else ([], [])
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
                out[own] = np.where(known[at] == keys[own], values[at], np.float32("nan"))
            if len(self.shards) > RESIDENT:
                vars(shard).pop("_value", None)  # it stays in the executor's store
        return out

    def destroy(self) -> None:
        for shard in self.shards:
            shard.destroy()


def _discount(counts: DataFrame, *columns: str) -> list[float]:
    """Ney's estimate n1 / (n1 + 2 n2) for each column of counts."""
    got = counts.agg(*(F.count_if(F.col(c) == k).alias(f"{c}{k}") for c in columns for k in (1, 2))
                     ).first()
    out = []
    for c in columns:
        one, two = got[f"{c}1"], got[f"{c}2"]
        out.append(min(0.9, max(0.1, one / (one + 2 * two) if one else 0.5)))
    return out


class Model:
    """Log-likelihood ratios of all grams counted, and of the back-off of all their contexts."""

    def __init__(self, counts: DataFrame, toxic: str, ordinary: str):
        """``counts`` are read more than once."""
        c = counts.select("gram", F.expr(toxic).alias("t"), F.expr(ordinary).alias("o")).where(
            "t + o > 0").selectExpr(
            "gram", "t", "o", "shiftrightunsigned(gram, 8) as context",
            "cast(case when shiftrightunsigned(gram, 24) > 0 then gram & 16777215L when "
            "shiftrightunsigned(gram, 16) > 0 then gram & 65535L else gram & 255L end as int) as low")
        low = stage(c.groupBy("low").agg(F.count("*").alias("n")).select(  # 2^24 rows at most
            "low", "n", F.expr("shiftright(low, 8)").alias("history"), F.expr("low & 255").alias("last")), "toxicity-low")
        dt, do = _discount(c, "t", "o")
        (dl,) = _discount(low, "n")
        ends = low.groupBy("last").agg(F.count("*").alias("n_last"))
        total = ends.agg(F.sum("n_last"), F.count("*")).first()
        all_ends, kinds = total[0] or 1, total[1]
        history = low.groupBy("history").agg(F.sum("n").alias("n_all"), F.count("*").alias("n_kinds"))
        shared = (low.join(ends, "last").join(history, "history").select("low", F.expr(
            f"greatest(n - {dl}D, 0D) / n_all + {dl}D * n_kinds / n_all * "
            f"(greatest(n_last - 0.5D, 0D) + 0.5D * {kinds} / 256) / {all_ends}").alias("p")))
        # A context has 256 grams at most.
        whole = Window.partitionBy("context")
        known = c.join(shared, "low").select(
            "gram", "context", "t", "o", "p", F.sum("t").over(whole).alias("t_all"), F.sum("o").over(whole).alias("o_all"),
            F.count_if(F.col("t") > 0).over(whole).alias("t_kinds"), F.count_if(F.col("o") > 0).over(whole).alias("o_kinds"),
            (F.row_number().over(whole.orderBy("gram")) == 1).alias("first")).selectExpr(
            "*", f"if(t_all > 0, {dt}D * t_kinds / t_all, 1D) as t_back", f"if(o_all > 0, {do}D * o_kinds / o_all, 1D) as o_back")
        found = stage(known.select(
            "gram", "context", "first", F.expr("ln(t_back / o_back)").alias("back"), F.expr(
                f"ln((if(t_all > 0, greatest(t - {dt}D, 0D) / t_all, 0D) + t_back * p)"
                f" / (if(o_all > 0, greatest(o - {do}D, 0D) / o_all, 0D) + o_back * p))").alias("ratio")), "toxicity-grams")
        self.ratio = Table(found.selectExpr("gram as key", "ratio as value"))
        self.back = Table(found.where("first").selectExpr("context as key", "back as value"))

    def piece(self) -> tuple[int, int]:
        """Bytes and rows that are scored at once: more where each time shards have to be loaded again."""
        if max(len(self.ratio.shards), len(self.back.shards)) > RESIDENT:
            return 16 * PIECE_BYTES, 16 * PIECE_ROWS
        return PIECE_BYTES, PIECE_ROWS

    def destroy(self) -> None:
        self.ratio.destroy()
        self.back.destroy()

    def features(self, offsets: np.ndarray, raw: np.ndarray) -> list[np.ndarray]:
        """Per text: mean ratio of a letter, clear ratio of a word, that of the top stretch."""
        docs = len(offsets) - 1
        w = words(offsets, raw)
        if not len(w.doc):
            return [np.zeros(docs) for _ in FEATURES]
        keys = grams(w)
        r = self.ratio(keys)
        gap = np.isnan(r)
        r[gap] = np.nan_to_num(self.back(keys[gap] >> np.uint64(8)))
        own = w.lengths - 1
        per_word = np.add.reduceat(r.astype(np.float64), own.cumsum() - own)
        size = np.maximum(np.bincount(w.doc, own[w.number], docs), 1)
        mean = np.bincount(w.doc, per_word[w.number], docs) / size
        clear = np.maximum(per_word - CLEAR, 0)[w.number]
        # A repeated word counts once in a stretch.
        by_word = np.lexsort((np.arange(len(clear)), w.number, w.doc))
        again = ((w.number[by_word[1:]] == w.number[by_word[:-1]])
                 & (w.doc[by_word[1:]] == w.doc[by_word[:-1]]) & (np.diff(by_word) < STRETCH))
        clear[by_word[1:][again]] = 0
        sums = np.concatenate(([0.0], clear.cumsum()))
        count = np.bincount(w.doc, minlength=docs)
        share = np.bincount(w.doc, clear, docs) / np.maximum(count, STRETCH)
        first = np.searchsorted(w.doc, np.arange(docs))
        begin = np.maximum(np.arange(len(clear)) - STRETCH + 1, first[w.doc])
        top, has = np.zeros(docs), np.flatnonzero(count)
        top[has] = np.maximum.reduceat((sums[1:] - sums[begin]) / STRETCH, first[has])
        return [mean, share, top]


@dataclass
class Detector:
    """A fitted model with the weights that turn its features into a probability."""

    model: Model | None
    weights: list[float]
    constant: float

    def probability(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        if self.model is None:
            return np.full(len(offsets) - 1, self.constant)
        features = self.model.features(offsets, raw)
        z = self.constant + sum(a * x for a, x in zip(self.weights, features, strict=True))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> Detector:
    """Learn from all labelled rows that are not held out.

    Part 0 of the training rows gives a model whose ratios of part 2 set the weights, so
    these are not fitted on texts that the model has seen; the final model counts both
    parts.  Where a class is missing, all scores are the share of toxic labels (0
    without labels).
    """
    rows = labelled(docs, labels, "toxic", text)
    seen = {(r["part"], r["label"]): r["count"] for r in rows.groupBy("part", "label").count().collect()}
    toxic = sum(n for (_, k), n in seen.items() if k)
    total = sum(seen.values())
    if len(seen) < 4:
        return Detector(None, [], toxic / total if total else 0.0)
    counts = stage(gram_counts(rows, text), "toxicity-counts")
    half = Model(counts, "t0", "o0")
    other = rows.where("part = 2").select(F.col(text).alias("text"), F.col("label").cast("double"))
    features = append(other, "text", half.features, [
        T.StructField(c, T.DoubleType()) for c in FEATURES], *half.piece()).drop("text")
    # Four numbers a row: written once, the rounds of the fit read them in few tasks.
    features = stage(features, "toxicity-features")
    line = LogisticRegression(regParam=0.0005, maxIter=60).fit(
        VectorAssembler(inputCols=[*FEATURES], outputCol="features").transform(features))
    half.destroy()
    whole = Model(counts, "t0 + t2", "o0 + o2")
    return Detector(whole, [float(x) for x in line.coefficients], float(line.intercept))


def toxicity(docs: DataFrame, detector: Detector, text: str = "text", threshold: float = 0.7
             ) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from the threshold on) to every row.

    Null, empty and wordless texts have no evidence and get the score of ratios of 0.
    Whole texts are read, repeated rows get equal scores, an empty frame stays empty, and
    a taken column name gets an underscore.
    """
    score = fresh(docs, "score")
    scored = append(docs, text, lambda o, r: [detector.probability(o, r)],
                    [T.StructField(score, T.DoubleType())], *(detector.model.piece() if detector.model else ()))
    return scored.withColumn(fresh(docs, "predicted"), (F.col(score) >= threshold).cast("int"))

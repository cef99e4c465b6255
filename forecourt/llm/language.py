"""Language by the nearest of several centroids per language (operator 10).

A text is a unit vector of TF-IDF weights of its byte n-grams within words.  Each
language has several centroids, found by spherical k-means; the nearest one by cosine
gives the language, and a text too far from all of them is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt.llm.batches import append, flat, fresh, pieces, ship, tidy

BITS = 12
SIZES = (1, 2, 3, 4)
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
_MIX = np.uint32(2654435761)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z and the accented capitals of Latin-1 in lower case, in UTF-8 bytes."""
    out = LOWER[raw]
    if len(raw) > 1:
        accented = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        out[1:][accented] += 32
    return out


def _is_part(raw: np.ndarray) -> np.ndarray:
    return ((raw >= ord("a")) & (raw <= ord("z"))) | (raw >= 128)


def gram_counts(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Counts of the byte n-grams of words in lower case, a row per text.

    All that is no letter a-z and no byte outside ASCII counts as one blank.  N-grams of
    one to four bytes with at least one letter are numbered by a hash of 12 bits.
    """
    docs = len(offsets) - 1
    raw = lowered(raw)
    symbol = np.where(_is_part(raw), raw, 32).astype(np.uint32)
    doc = np.repeat(np.arange(docs), np.diff(offsets))
    out = np.zeros(docs << BITS, np.float32)
    key = np.zeros(len(raw), np.uint32)
    for n in range(1, max(SIZES) + 1):
        if len(raw) < n:
            break
        key = (key[:len(raw) - n + 1] << np.uint32(8)) | symbol[n - 1:]
        if n not in SIZES:
            continue
        inside = doc[:len(key)] == doc[n - 1:]
        inside &= key != np.uint32(0x20202020 & ((1 << 8 * n) - 1))
        mixed = (key[inside] ^ np.uint32(n * 0x9E37)) * _MIX
        slot = (mixed ^ (mixed >> np.uint32(15))) * _MIX >> np.uint32(32 - BITS)
        out += np.bincount((doc[:len(key)][inside] << BITS) + slot, minlength=docs << BITS)
    return out.reshape(docs, 1 << BITS)


@dataclass
class Centroids:
    """A fitted model: unit centroids, each with its language."""

    weight: np.ndarray          # inverse document frequency of each n-gram number
    centre: np.ndarray          # a row per centroid
    language: list[str]         # of each centroid
    nearest: float              # smaller cosines are rejected
    sharpness: float = 40.0

    def vectors(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        x = np.log1p(gram_counts(offsets, raw)) * self.weight
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)

    def predict(self, offsets: np.ndarray, raw: np.ndarray, letters: np.ndarray) -> list:
        """(language, score, cosine of the nearest centroid, rejected) of each text."""
        docs = len(offsets) - 1
        if not self.language:
            return [[UNKNOWN] * docs, np.zeros(docs), np.zeros(docs), np.ones(docs, bool)]
        near = self.vectors(offsets, raw) @ self.centre.T
        names = sorted(set(self.language))
        per = np.stack([near[:, [x == name for x in self.language]].max(axis=1) for name in names], 1)
        best = per.argmax(axis=1)  # of equal ones the first name
        cosine = per[np.arange(docs), best].astype(np.float64)
        score = 1 / np.exp(self.sharpness * (per - per.max(axis=1, keepdims=True))).sum(axis=1)
        language = [names[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
        return [language, np.where(letters, score, 0).astype(np.float64),
                np.clip(np.where(letters, cosine, 0), 0, 1), ~letters | (cosine < self.nearest)]


def _sums(rows: DataFrame, text: str, group: str, value, width: str) -> dict[str, np.ndarray]:
    """Sums of ``value(offsets, bytes, group)`` -> {group: vector} over all rows.

    A task sends one vector of fixed length per group, however many rows it has.
    """
    schema = "name string, at int, x double"

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            offsets, raw = flat(batch.column("text"))
            names = batch.column("name").to_pylist()
            for i, j in pieces(offsets):
                own = offsets[i:j + 1]
                for name, x in value(own - own[0], raw[own[0]:own[-1]], names[i:j]).items():
                    total[name] = total[name] + x if name in total else x.astype(np.float64)
        for name, x in total.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                 pa.array(x[at])], ["name", "at", "x"])

    ship(rows.sparkSession)
    got = (rows.select(F.col(text).alias("text"), F.col(group).alias("name"))
           .mapInArrow(tidy(run), schema).groupBy("name", "at").agg(F.sum("x").alias("x")).toArrow())
    out: dict[str, np.ndarray] = {}
    frame = got.to_pandas()
    for name, part in frame.groupby("name"):
        out[name] = np.zeros(1 << BITS) if width == "grams" else np.zeros(int(part["at"].max()) + 1)
        out[name][part["at"]] = part["x"]
    return out


def fit(docs: DataFrame, text: str = "text", language: str = "lang", clusters: int = 3,
        rounds: int = 3, sample: int = 2_000, nearest: float = 0.02) -> Centroids:
    """Learn from all rows with a language; callers leave out what must not be seen.

    Document frequencies and the final centroids cover every row.  Only the search for
    clusters runs on a bounded sample: about ``sample`` rows of each language, chosen by
    a hash of the text, all of them where there are fewer.  Without rows every text is
    ``und`` and rejected.
    """
    rows = docs.where(F.col(language).isNotNull() & F.col(text).isNotNull())

    def frequency(offsets, raw, names):
        seen, names = gram_counts(offsets, raw) > 0, np.array(names, object)
        return {n: np.append(seen[names == n].sum(axis=0), (names == n).sum()) for n in set(names)}

    got = _sums(rows, text, language, frequency, "count")
    names = sorted(got)
    if not names:
        return Centroids(np.ones(1 << BITS, np.float32), np.zeros((0, 1 << BITS), np.float32), [], nearest)
    count = {n: int(got[n][1 << BITS]) for n in names}
    frequencies = sum(got[n][:1 << BITS] for n in names)
    weight = np.log((1 + sum(count.values())) / (1 + frequencies)).astype(np.float32)
    share = F.create_map(*(F.lit(x) for n in names for x in (n, min(1.0, sample / count[n]))))
    some = rows.where(F.pmod(F.xxhash64(text), F.lit(1 << 30)) / float(1 << 30) < share[F.col(language)])

    # A seed for each cluster: the sides of fixed random planes through the language's mean.
    plane = np.random.default_rng(7).normal(size=(1 << BITS, clusters)).astype(np.float32)
    model = Centroids(weight, np.zeros((0, 1 << BITS), np.float32), [], nearest)
    mean = _sums(some, text, language, _by_cluster(model, lambda x, n: n), "grams")

    def side(x, n):
        z = x @ plane - mean[n].astype(np.float32) / max(np.linalg.norm(mean[n]), 1e-12) @ plane
        return f"{z.argmax()}|{n}"

    for k in range(rounds + 1):
        last = k == rounds
        sums = _sums(rows if last else some, text, language, _by_cluster(
            model, side if k == 0 else _nearest_of(model)), "grams")
        keys = sorted(sums)
        centre = np.stack([sums[c] / max(np.linalg.norm(sums[c]), 1e-12) for c in keys])
        model = Centroids(weight, centre.astype(np.float32), [c.split("|", 1)[1] for c in keys], nearest)
    return model


def _by_cluster(model: Centroids, choose):
    """Sums of the unit vectors by the cluster that ``choose(vector, language)`` names."""
    def run(offsets, raw, names):
        x = model.vectors(offsets, raw)
        chosen = np.array([choose(v, n) for v, n in zip(x, names, strict=True)], object)
        return {c: x[chosen == c].sum(axis=0) for c in set(chosen)}
    return run


def _nearest_of(model: Centroids):
    centres = {n: [k for k, x in enumerate(model.language) if x == n] for n in set(model.language)}

    def pick(v, n):
        own = centres.get(n)
        return f"0|{n}" if not own else f"{own[int((model.centre[own] @ v).argmax())]}|{n}"
    return pick


def languages(docs: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """Add lang_pred, score (0 to 1), cosine and rejected to every row.

    A text that is null or has no letter is ``und`` with score 0 and rejected.  A text
    farther from all centroids than the model allows keeps its nearest language and is
    rejected.  Whole texts are read; of equally near languages the first name counts; an
    empty frame stays empty, and a taken column name gets an underscore.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(offsets, raw):
        data = raw.tobytes()
        letters = np.array([bool(LETTER.search(data[a:b].decode("utf-8", "replace")))
                            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        return held.value.predict(offsets, raw, letters)

    return append(docs, text, run, [
        T.StructField(fresh(docs, "lang_pred"), T.StringType()),
        T.StructField(fresh(docs, "score"), T.DoubleType()),
        T.StructField(fresh(docs, "cosine"), T.DoubleType()),
        T.StructField(fresh(docs, "rejected"), T.BooleanType())])

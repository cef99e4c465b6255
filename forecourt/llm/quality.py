"""Quality by hierarchical empirical Bayes over hosts and paths (operator 9).

A naive Bayes model of the shapes of characters gives each document's own evidence.
Grouped counts give each host a posterior share of good documents, shrunk towards the
global share, and each path one that is shrunk towards its host's; sites with few
documents stay close to what is known above them.  Both combine as log-odds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt.llm.batches import append, flat, fresh, pieces, ship, tidy
from forecourt.llm.labels import all_labels, labelled
from forecourt.session import stage

BITS = 14
REPEATED = 1 << BITS           # the feature of a word that repeats the one before
WIDTH = (1 << BITS) + 1
SHAPE = np.arange(256, dtype=np.uint32)
SHAPE[ord("a"):ord("z") + 1] = SHAPE[128:] = ord("a")
SHAPE[ord("A"):ord("Z") + 1] = ord("A")
SHAPE[ord("0"):ord("9") + 1] = ord("0")


def features(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every run of four character shapes and of every repeated word."""
    docs = len(offsets) - 1
    doc = np.repeat(np.arange(docs), np.diff(offsets))
    shape = SHAPE[raw]
    key = shape.copy()
    for n in range(1, 4):
        if len(raw) > n:
            key = (key[:len(raw) - n] << np.uint32(8)) | shape[n:]
    key = key if len(raw) > 3 else key[:0]
    inside = doc[:len(key)] == doc[len(raw) - len(key):]
    mixed = key[inside] * np.uint32(2654435761)
    slot = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(32 - BITS)
    word = ~np.isin(raw, (9, 10, 11, 12, 13, 32))
    joined = np.zeros(len(raw) + 1, bool)
    joined[1:-1] = word[1:] & word[:-1]
    joined[offsets] = False
    starts = np.flatnonzero(word & ~joined[:-1])
    again = np.zeros(0, np.int64)
    if len(starts) > 1:
        lengths = np.flatnonzero(word & ~joined[1:]) + 1 - starts
        first = lengths.cumsum() - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        power = np.multiply.accumulate(np.full(int(lengths.max()), 0x100000001B3, np.uint64))
        code = np.add.reduceat((raw[word].astype(np.uint64) + np.uint64(7)) * power[place], first)
        same = (code[1:] == code[:-1]) & (doc[starts[1:]] == doc[starts[:-1]])
        again = doc[starts[1:][same]]
    return (np.concatenate([doc[:len(key)][inside], again]),
            np.concatenate([slot.astype(np.int64), np.full(len(again), REPEATED)]))


@dataclass
class Evidence:
    """Naive Bayes weights, and the line from the mean weight to log-odds."""

    weight: np.ndarray
    slope: float
    constant: float

    def mean(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        docs = len(offsets) - 1
        of, slot = features(offsets, raw)
        return np.bincount(of, self.weight[slot], docs) / np.maximum(np.bincount(of, minlength=docs), 1)

    def log_odds(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.mean(offsets, raw) + self.constant, -30, 30)


def _counts(rows: DataFrame, text: str) -> np.ndarray:
    """Feature counts [part 0 or 2, label, feature]; a task sends a fixed number of sums."""
    def run(batches):
        total = np.zeros(4 * WIDTH, np.int64)
        for batch in batches:
            offsets, raw = flat(batch.column("text"))
            group = np.asarray(batch.column("part")) // 2 * 2 + np.asarray(batch.column("label"))
            for i, j in pieces(offsets):
                own = offsets[i:j + 1]
                of, slot = features(own - own[0], raw[own[0]:own[-1]])
                total += np.bincount(group[i:j][of] * WIDTH + slot, minlength=4 * WIDTH)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    ship(rows.sparkSession)
    got = rows.select(F.col(text).alias("text"), "part", "label").mapInArrow(
        tidy(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(4 * WIDTH)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.reshape(2, 2, WIDTH)


def _weights(counts: np.ndarray) -> np.ndarray:
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> Evidence:
    """Learn the document evidence from all labelled rows that are not held out.

    Weights of part 0 are laid against the labels of part 2 for the line; the final
    weights come from both.  Where a part lacks a class there is no evidence: log-odds 0.
    """
    rows = labelled(docs, labels, "quality", text)
    seen = {(r["part"], r["label"]) for r in rows.groupBy("part", "label").count().collect()}
    if len(seen) < 4:
        return Evidence(np.zeros(WIDTH), 0.0, 0.0)
    counts = _counts(rows, text)
    half = Evidence(_weights(counts[0]), 1.0, 0.0)
    other = rows.where("part = 2").select(text, F.col("label").cast("double").alias("label"))
    name = fresh(other, "mean")
    scored = append(other, text, lambda o, r: [half.mean(o, r)], [T.StructField(name, T.DoubleType())])
    # Two numbers a row: written once, so the fit does not join the texts again.
    scored = stage(scored.select(name, "label"), "quality-means")
    line = LogisticRegression(regParam=0.0005, maxIter=60).fit(VectorAssembler(
        inputCols=[name], outputCol="features").transform(scored))
    return Evidence(_weights(counts[0] + counts[1]), float(line.coefficients[0]), float(line.intercept))


def _strength(groups: DataFrame, expected: str) -> float:
    """Pseudo-count of a beta prior by moments: (good, n) of groups against expected shares."""
    row = groups.where("n > 0").selectExpr("good / n as p", "n", f"{expected} as e").agg(
        F.count("*").alias("k"), F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("squares"),
        F.sum(F.expr("n * (p - e) * (p - e)")).alias("between"), F.avg(F.expr("e * (1 - e)")).alias("within")
    ).first()
    if not row["k"] or row["k"] < 2 or not row["within"]:
        return 10.0
    spread = row["all"] - row["squares"] / row["all"] - (row["k"] - 1)
    rho = (row["between"] / row["within"] - (row["k"] - 1)) / spread if spread > 0 else 0.0
    rho = min(max(rho, 1e-4), 0.5)  # the prior weighs at least one document
    return (1 - rho) / rho


def _log_odds(p: Column) -> Column:
    return F.ln(p / (1 - p))


def quality(docs: DataFrame, labels: DataFrame, evidence: Evidence, host: Column, path: Column,
            doc_id: str = "doc_id", text: str = "text", soft: float = 0.25, threshold: float = 0.5
            ) -> DataFrame:
    """(doc_id, score, predicted, evidence, host_prior, path_prior) of every row.

    Every labelled training row counts with its label in its site, any other row with its own
    probability at the weight ``soft``, so every document has its part in the posteriors.
    The labels have no bound: they meet the documents' ids, not their texts, in a shuffle.
    Null hosts and paths are sites of their own; null and empty texts have no evidence and
    get their site's share.  Repeated rows stay; an empty frame gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(evidence)
    thin = docs.select(F.col(doc_id).alias("doc_id"), host.cast("string").alias("host"),
                       path.cast("string").alias("path"), F.col(text).alias("text"))
    thin = append(thin, "text", lambda o, r: [held.value.log_odds(o, r)],
                  [T.StructField("odds", T.DoubleType())]).drop("text")
    thin = stage(thin, "evidence")
    known = all_labels(labels, "quality").hint("merge")
    # Rows without an id have no label and would all meet in one task.
    told = thin.where("doc_id is not null").join(
        known, F.col("doc_id") == F.col("labelled_id"), "left").select("host", "path", "odds", "label")
    told = told.unionByName(thin.where("doc_id is null").select(
        "host", "path", "odds", F.lit(None).cast("int").alias("label")))
    own = F.coalesce(F.col("label").cast("double"), F.lit(soft) / (1 + F.exp(-F.col("odds"))))
    paths = stage(told.groupBy("host", "path").agg(F.sum(own).alias("good"), F.sum(
        F.when(F.col("label").isNotNull(), 1.0).otherwise(soft)).alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    whole = hosts.agg(F.sum("good"), F.sum("n")).first()
    share = min(max((whole[0] or 0.0) / whole[1], 1e-6), 1 - 1e-6) if whole[1] else 0.5
    m = _strength(hosts, f"{share!r}D")
    hosts = stage(hosts.select(F.col("host").alias("of_host"), (
        (F.col("good") + m * share) / (F.col("n") + m)).alias("host_prior")), "hosts")
    paths = paths.join(hosts, paths["host"].eqNullSafe(hosts["of_host"]))
    m = _strength(paths, "host_prior")
    paths = stage(paths.select("of_host", F.col("path").alias("of_path"), "host_prior", (
        (F.col("good") + m * F.col("host_prior")) / (F.col("n") + m)).alias("path_prior")), "sites")
    odds = F.col("odds") + _log_odds(F.col("path_prior")) - F.lit(float(np.log(share / (1 - share))))
    return thin.join(paths, thin["host"].eqNullSafe(paths["of_host"])
                     & thin["path"].eqNullSafe(paths["of_path"])).select(
        "doc_id", (1 / (1 + F.exp(-odds))).alias("score"), F.col("odds").alias("evidence"),
        "host_prior", "path_prior").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))

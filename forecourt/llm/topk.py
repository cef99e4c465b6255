"""Exact top-k inner products by distributed histogram selection (operator 7).

Every row is scored against a block of queries.  Global histograms of the scores, one per
query, are refined around the k-th highest until few scores are left at or above it; the
rows from there on are filtered and ranked, ties by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forecourt.llm.batches import ship
from forecourt.session import work_dir

BINS = 256
LONG = np.iinfo(np.int64)


def quantised(values: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of each component, as whole numbers in doubles (exact)."""
    return np.floor(1024.0 * values.astype(np.float64))


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, a line per query; beyond a long they stop at its ends.

    Doubles are exact as long as no sum can pass 2 ** 53; larger components are
    multiplied as Python integers.
    """
    dim = max(1, queries.shape[1])
    if np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * dim < 2.0 ** 53:
        return (queries @ rows.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(queries) @ whole(rows).T
    return np.clip(exact, LONG.min, LONG.max).astype(np.int64)


class Block:
    """Some queries, the scores of which are taken batch by batch."""

    def __init__(self, ids: list[int], vectors: list):
        self.ids = np.array(ids, np.int64)
        self.of: dict[int, np.ndarray] = {}
        self.rows: dict[int, np.ndarray] = {}
        size = np.array([len(v) for v in vectors])
        for dim in np.unique(size):
            own = np.flatnonzero(size == dim)
            self.of[int(dim)] = own
            self.rows[int(dim)] = quantised(np.array([vectors[i] for i in own]).reshape(len(own), dim))

    def scored(self, batch: pa.RecordBatch, at_once: int = 4096):
        """(places of queries, ids, scores, allowed): a query's own row is not allowed."""
        ids = batch.column(0).to_numpy()
        lists = batch.column(1)
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False)
        size = np.diff(offsets)
        for dim, own in self.of.items():
            same = np.flatnonzero(size == dim)
            for i in range(0, len(same), at_once):
                some = same[i:i + at_once]
                rows = values[offsets[some][:, None] + np.arange(dim)]
                yield (own, ids[some], scores(self.rows[dim], quantised(rows)),
                       self.ids[own][:, None] != ids[some][None, :])


def _ranges(rows: DataFrame, block) -> dict[int, tuple[int, int, int]]:
    """Per query: lowest score, highest score, number of scores."""
    def run(batches):
        n = len(block.value.ids)
        low, high, count = np.full(n, LONG.max), np.full(n, LONG.min), np.zeros(n, np.int64)
        for batch in batches:
            for own, _, s, ok in block.value.scored(batch):
                low[own] = np.minimum(low[own], np.where(ok, s, LONG.max).min(axis=1))
                high[own] = np.maximum(high[own], np.where(ok, s, LONG.min).max(axis=1))
                count[own] += ok.sum(axis=1)
        has = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[has]) for x in (np.arange(n), low, high, count)], ["q", "low", "high", "n"])
    got = rows.mapInArrow(run, "q long, low long, high long, n long").groupBy("q").agg(
        F.min("low"), F.max("high"), F.sum("n")).collect()
    return {r[0]: (r[1], r[2], r[3]) for r in got}


def _histogram(rows: DataFrame, block, low: np.ndarray, last: np.ndarray, width: np.ndarray
               ) -> np.ndarray:
    """Per query: how many scores from its low to its last lie in each bin of its width."""
    def run(batches):
        n = len(block.value.ids)
        total = np.zeros((n, BINS), np.int64)
        for batch in batches:
            for own, _, s, ok in block.value.scored(batch):
                ok = ok & (s >= low[own][:, None]) & (s <= last[own][:, None])
                bins = (s - low[own][:, None]) // width[own][:, None]
                ok &= bins < BINS
                line, _ = np.nonzero(ok)
                flat = own[line] * BINS + bins[ok]
                total += np.bincount(flat, minlength=n * BINS).reshape(n, BINS)
        q, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(total[q, b])],
                                         ["q", "bin", "n"])
    got = rows.mapInArrow(run, "q long, bin long, n long").groupBy("q", "bin").agg(
        F.sum("n").alias("n")).toArrow()
    out = np.zeros((len(low), BINS), np.int64)
    out[got.column(0).to_numpy(), got.column(1).to_numpy()] = got.column(2).to_numpy()
    return out


def _thresholds(rows: DataFrame, block, count: int, k: int) -> np.ndarray:
    """Per query: a score that at least k scores reach, but not many more unless they tie."""
    ranges = _ranges(rows, block)
    floor = np.full(count, LONG.max)
    low, width, above = np.zeros(count, np.int64), np.ones(count, np.int64), np.zeros(count, np.int64)
    last = np.zeros(count, np.int64)  # above counts the scores beyond it
    todo = []
    for q, (least, most, n) in ranges.items():
        if n <= 4 * k:
            floor[q] = least
        else:
            low[q], last[q], width[q] = least, most, (int(most) - int(least)) // BINS + 1
            todo.append(q)
    todo = np.array(sorted(todo), np.int64)
    while len(todo):
        held = np.full(count, LONG.max)  # finished queries count nothing
        held[todo] = low[todo]
        seen = _histogram(rows, block, held, last, width)
        left = []
        for q in todo:
            higher = seen[q][::-1].cumsum() + above[q]  # scores from each bin on, top bin first
            at = int(np.searchsorted(higher, k))        # the first bin from the top to reach k
            b = BINS - 1 - at
            low[q] += b * width[q]
            # The bins of the next round can reach beyond this one.
            last[q] = min(int(last[q]), int(low[q]) + int(width[q]) - 1)
            above[q] = higher[at] - seen[q][b]
            if width[q] == 1 or higher[at] <= 4 * k:
                floor[q] = low[q]
            else:
                width[q] = -(-width[q] // BINS)
                left.append(q)
        todo = np.array(left, np.int64)
    return floor


def _best(rows: DataFrame, block, floor: np.ndarray, k: int) -> DataFrame:
    """The rows at or above the thresholds; of one task the first k of each query."""
    def run(batches):
        kept = [np.zeros((3, 0), np.int64)]
        held = 0
        for batch in batches:
            for own, ids, s, ok in block.value.scored(batch):
                line, row = np.nonzero(ok & (s >= floor[own][:, None]))
                kept.append(np.stack([own[line], ids[row], s[line, row]]))
                held += len(line)
                if held > 1 << 20:
                    kept = [_first(np.concatenate(kept, axis=1), k)]
                    held = 0
        q, ids, s = _first(np.concatenate(kept, axis=1), k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.value.ids[q]), pa.array(ids), pa.array(s)], ["query_id", "vec_id", "score"])
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.mapInArrow(run, "query_id long, vec_id long, score long").withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _first(found: np.ndarray, k: int) -> np.ndarray:
    q, ids, s = found
    found = found[:, np.lexsort((ids, ~s, q))]  # ~s falls as s rises, without overflow
    q = found[0]
    start = np.searchsorted(q, q)
    return found[:, np.arange(len(q)) - start < k]


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, block: int = 1024,
          vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of every query, exactly.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but the
    query's own.  Vectors that are null or hold null or non-finite components take no
    part, nor do rows without id; only vectors of equal length are compared.  Of repeated
    rows every one is a candidate, and rows of one id are not candidates of each other.
    An id that repeats among the queries asks once, with its smallest vector.
    An empty table gives no rows.

    Queries are taken in blocks of about ``block``, a fixed size, which go to all tasks;
    the driver sees ``block`` histograms at a time.  Each block's answer is a written
    table.
    """
    spark = vectors.sparkSession
    ship(spark)
    x = F.col("x")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("x")).where(
        F.col("id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: F.coalesce(
            ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))))
    asked = rows.where(F.col("id") % every == 0)
    blocks = -(-asked.count() // block)
    path = work_dir(spark, "topk")
    part = F.pmod(F.xxhash64("id"), F.lit(max(blocks, 1)))
    for b in range(max(blocks, 1)):
        own = asked.where(part == b).groupBy("id").agg(F.min("x").alias("x")).collect()
        held = spark.sparkContext.broadcast(Block([r["id"] for r in own], [r["x"] for r in own]))
        floor = _thresholds(rows, held, len(own), k)
        _best(rows, held, floor, k).write.mode("append").parquet(path)
        held.destroy()
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)

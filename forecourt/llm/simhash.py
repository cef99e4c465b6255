"""Near-duplicate documents by SimHash and a byte-position index (operator 8).

Two fingerprints of eight bytes that differ in at most two bits agree in at least six
bytes at their places; six is the guaranteed minimum of shared positional bytes.  The
inverted index has a posting for every choice of six byte places and the bytes there, 28
per fingerprint, so a pair's tally of shared bytes reaches the minimum exactly if it
meets in a posting (in one with six equal bytes, in seven with seven).  Within a posting
only the two other bytes are left, so it holds at most 65,536 fingerprints, and pairs
are verified by looking up the values at one or two bits' distance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt.llm.batches import append, fresh, ship, tidy
from forecourt.llm.components import components
from forecourt.session import stage

PLACES = list(combinations(range(8), 2))  # the two byte places that a posting leaves out
FLIPS = np.array([1 << i for i in range(16)]
                 + [(1 << i) | (1 << j) for i, j in combinations(range(16), 2)], np.uint16)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SHINGLES_AT_ONCE = 1 << 16


def simhash(offsets: np.ndarray, raw: np.ndarray, size: int = 3) -> np.ndarray:
    """The 64-bit SimHash of each text: a bit is 1 if more than half the shingles have it."""
    docs = len(offsets) - 1
    low, word = LOWER[raw], ~BLANK[raw]
    joined = np.zeros(len(raw) + 1, bool)
    joined[1:-1] = word[1:] & word[:-1]
    joined[offsets] = False
    starts = np.flatnonzero(word & ~joined[:-1])
    ends = np.flatnonzero(word & ~joined[1:]) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    out = np.zeros(docs, np.uint64)
    if not len(starts):
        return out
    # All words in a row with one space after each: a shingle is a slice.
    lengths = ends - starts
    keep = word.copy()
    text = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
    first = (lengths + 1).cumsum() - lengths - 1
    fill = np.ones(len(text), bool)
    fill[first + lengths] = False
    text[fill] = low[keep]
    data = text.tobytes()
    words = np.bincount(doc, minlength=docs)
    begin = np.concatenate(([0], words.cumsum()))
    count = np.where(words > 0, np.maximum(words - size + 1, 1), 0)
    of = np.repeat(np.arange(docs), count)
    at = begin[of] + np.arange(len(of)) - np.repeat(count.cumsum() - count, count)
    last = np.minimum(at + size, begin[of + 1]) - 1
    a, b = first[at], first[last] + lengths[last]
    digest = xxhash.xxh64_intdigest
    bits = np.zeros((docs, 64), np.int64)
    for i in range(0, len(of), SHINGLES_AT_ONCE):
        part = slice(i, i + SHINGLES_AT_ONCE)
        h = np.fromiter((digest(data[x:y], 42) for x, y in zip(
            a[part].tolist(), b[part].tolist(), strict=True)), np.uint64)
        own = of[part]
        change = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        each = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        bits[own[change]] += np.add.reduceat(each, change, axis=0, dtype=np.int64)
    majority = np.packbits(bits * 2 > count[:, None], axis=1)
    return majority.view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the SimHash of every whole text as a signed long (null or blank text: 0)."""
    return append(docs, text, lambda o, r: [simhash(o, r).view(np.int64)],
                  [T.StructField(fresh(docs, name), T.LongType())])


def posting_links(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same 16-bit values as all pairs within two bits do.

    Every value takes the smallest label among the values within two bits of it, again
    and again; the values of one label are then linked one after another.
    """
    label = np.full(1 << 16, 1 << 16, np.int64)
    label[rest] = rest
    near = rest[:, None] ^ FLIPS[None, :]
    while True:
        new = np.minimum(label[rest], label[near].min(axis=1))
        if (new == label[rest]).all():
            break
        label[rest] = new
    order = np.lexsort((rest, label[rest]))
    same = label[rest[order[1:]]] == label[rest[order[:-1]]]
    return rest[order[:-1][same]], rest[order[1:][same]]


def links(distinct: DataFrame, name: str) -> DataFrame:
    """(a, b): links between fingerprints that differ in at most two bits.

    Each pair is joined directly or over others within its posting, so the components are
    those of all pairs, while a posting of n fingerprints sends fewer than n links.
    """
    def keys(left_out):
        i, j = left_out
        mask = ((1 << 64) - 1) ^ (255 << 8 * i) ^ (255 << 8 * j)
        return F.struct(F.col(name).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
                        .alias("bytes"),
                        F.lit(PLACES.index(left_out)).cast("byte").alias("places"),
                        (F.shiftrightunsigned(name, 8 * i).bitwiseAND(F.lit(255))
                         + F.shiftrightunsigned(name, 8 * j).bitwiseAND(F.lit(255)) * 256)
                        .cast("int").alias("rest"))

    def run(batches):
        for batch in batches:
            a, b = [], []
            rests = batch.column("rests")
            for held, places, rest in zip(batch.column("bytes").to_pylist(),
                                          batch.column("places").to_pylist(), rests, strict=True):
                x, y = posting_links(rest.values.to_numpy().astype(np.int64))
                if not len(x):
                    continue
                i, j = PLACES[places]
                for side, out in ((x, a), (y, b)):
                    side = side.astype(np.uint64)
                    out.append(np.uint64(held & ((1 << 64) - 1))
                               | ((side & np.uint64(255)) << np.uint64(8 * i))
                               | ((side >> np.uint64(8)) << np.uint64(8 * j)))
            if a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    ship(distinct.sparkSession)
    postings = (distinct.select(F.explode(F.array(*map(keys, PLACES))).alias("p")).select("p.*")
                .groupBy("places", "bytes").agg(F.collect_set("rest").alias("rests"))
                .where(F.size("rests") > 1))
    return postings.mapInArrow(tidy(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                    keep: list[str] | None = None) -> DataFrame:
    """The kept columns with ``fingerprint`` (hex) and ``component_id`` of every row.

    A component is what links of at most two differing bits reach; its id is the smallest
    document id in it.  Null and blank texts have fingerprint zero and link like others.
    Rows without an id take part; the component is null where no row has an id.  Repeated
    rows stay, an empty frame gives no rows, a taken column name gets an underscore.  Texts
    are read once, however long: the fingerprints are a written table.
    """
    keep = [doc_id] if keep is None else keep
    own = stage(fingerprints(docs.select(*keep, F.col(text).alias("_text")), "_text", "_print")
                .drop("_text"), "fingerprints")
    distinct = stage(own.groupBy("_print").agg(F.min(doc_id).alias("_least")), "distinct")
    tree = components(links(distinct, "_print"))
    roots = distinct.join(tree.withColumnRenamed("node", "_print"), "_print", "left").select(
        "_print", "_least", F.coalesce("root", "_print").alias("_root"))
    roots = stage(roots, "roots")
    least = roots.groupBy("_root").agg(F.min("_least").alias("_component"))
    names = stage(roots.join(least, "_root").select("_print", "_component"), "components")
    return own.join(names, "_print").select(
        *keep, F.lower(F.lpad(F.hex("_print"), 16, "0")).alias(fresh(own, "fingerprint")),
        F.col("_component").alias(fresh(own, "component_id")))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The row with the smallest id of every component, one where rows repeat.

    Rows without an id stay only where their whole component has none, one of them.  The
    columns are those of ``docs``, whatever their names.
    """
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    found = near_duplicates(packed, "text", "id", ["row", "id"])
    first = Window.partitionBy("component_id", F.when(F.col("component_id").isNull(), F.col(
        "fingerprint"))).orderBy(F.col("id").asc_nulls_last(), F.col("row")[text].asc_nulls_last())
    kept = found.where(F.col("id").eqNullSafe(F.col("component_id"))).withColumn(
        "place", F.row_number().over(first)).where("place = 1")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))

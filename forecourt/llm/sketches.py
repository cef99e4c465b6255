"""Threshold-scaled sketches of documents, mergeable and comparable (operator 6).

A sketch keeps every shingle hash in the lowest 1/scale of the 64-bit range.  What is
kept depends on the hash alone, so sketches of parts merge by union, and the shares that
two sketches have in common estimate those of the texts, however unequal their lengths.
A text whose shingles all lie above the threshold keeps its smallest hash, so that every
text with a word has a fingerprint of its own.  Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt.functions.text import let

SHINGLE = 5
SCALE = 8


def words(text: Column) -> Column:
    blank = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(blank, " "), lambda w: w != "")


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted different hashes below the threshold; no word: an empty array.

    Shingles are runs of ``shingle`` words; fewer words are one shingle.
    """
    below = F.lit(-(1 << 63) + (1 << 64) // scale)

    def keep(hashes: Column) -> Column:
        low = F.filter(hashes, lambda h: h < below)
        return let(low, lambda x: F.when(F.size(x) > 0, F.array_sort(F.array_distinct(x)))
                   .otherwise(F.array(F.array_min(hashes))))

    def shingles(hashes: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(hashes) - (shingle - 1)),
                           lambda i: F.xxhash64(F.slice(hashes, i, shingle)))
        return (F.when(F.size(hashes) == 0, F.array().cast("array<bigint>"))
                .when(F.size(hashes) < shingle, F.array(F.xxhash64(hashes)))
                .otherwise(let(runs, keep)))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), shingles)


def merge(sketches: Column) -> Column:
    """The sketch of texts put together, from an array of their sketches.

    Exact where every text keeps a hash below the threshold; shingles that reach over the
    seam of two texts are in neither sketch.
    """
    return F.array_sort(F.array_distinct(F.flatten(sketches)))


def resemblance(a: Column, b: Column) -> Column:
    """Common hashes among all of both; two empty sketches are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(
        both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """The share of a's hashes that b has; an empty sketch is contained in all."""
    return F.when(F.size(a) == 0, 1.0).otherwise(
        F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def fingerprint(hashes: Column) -> Column:
    """The hashes as hexadecimal digits, 16 each."""
    return F.lower(F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def _longs(values: list) -> Column:
    return F.array(*(F.lit(v).cast("bigint") for v in values))


def _part(doc_id: Column, cuts: list[int], step: int = 64) -> Column:
    """How many of the sorted cuts lie below the id: first every 64th, then those between."""
    if not cuts:
        return F.when(doc_id.isNull(), -1).otherwise(0)
    def below(some):
        return F.size(F.filter(some, lambda c: c < doc_id))
    start = (below(_longs(cuts[::step])) - 1) * step
    return F.when(doc_id.isNull(), -1).when(start < 0, 0).otherwise(
        start + below(F.slice(_longs(cuts), start + 1, step)))


def with_next(docs: DataFrame, doc_id: str, text: str, *carried: str) -> DataFrame:
    """Add ``next_`` and each carried column of the next row by descending id.

    Ids are whole numbers.  Rows with equal ids follow each other by text, rows without an id come last, and
    after the last row comes the first.  Ids are cut into ranges of about equal size; each
    range gets one more row, the first one of the range below, so that one shuffle by
    range is enough and no task sorts all rows.  The driver sees one row per range.
    """
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise ValueError(f"{doc_id}: the next document is found by whole numbers")
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.agg(F.percentile_approx(doc_id, [i / ranges for i in range(1, ranges)], 10_000)
                     ).first()[0] or []
    rows = docs.withColumn("_part", _part(F.col(doc_id), sorted(set(found)))).withColumn(
        "_tie", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    heads = rows.groupBy("_part").agg(F.max(doc_id).alias("top"), F.min("_tie").alias("tie")
                                      ).orderBy("_part").collect()
    top, above = [None] * (ranges + 1), [None] * (ranges + 1)  # by the number of the range + 1
    for k, head in enumerate(heads):
        at = head["_part"] + 1
        top[at] = head["tie"] if head["top"] is None else head["top"]
        above[at] = heads[(k + 1) % len(heads)]["_part"]
    here = F.col("_part") + 2
    first = F.coalesce(F.col(doc_id), F.col("_tie")) == F.element_at(_longs(top), here)
    to = F.when(first, F.element_at(_longs(above), here).cast("int"))
    copies = rows.withColumn("_go", F.explode(F.array(
        F.struct(F.col("_part").alias("part"), F.lit(False).alias("extra")),
        F.struct(to.alias("part"), F.lit(True).alias("extra"))))).where("_go.part is not null")
    order = Window.partitionBy("_go.part").orderBy(
        "_go.extra", F.col(doc_id).desc_nulls_last(), "_tie", text)
    return copies.select(*docs.columns, "_go", *(F.lead(c).over(order).alias(f"next_{c}")
                                                 for c in carried)
                         ).where("not _go.extra").drop("_go")


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form, and their likeness.

    The edited form ends with the start of the next document in place of its own last
    half.  Null texts are empty; texts without a word have empty fingerprints, which are
    alike among each other and unlike all others.  Equal texts have equal fingerprints.
    A single document is its own next one; an empty frame gives no rows.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = with_next(plain.withColumn("sketch", sketch(F.col("text"))), "doc_id", "text", "text", "sketch")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    seen = let(edited, lambda t: F.struct(F.sha2(t, 256).alias("sha"), let(
        sketch(t), lambda s: F.struct(
            fingerprint(s).alias("print"), resemblance(F.col("sketch"), s).alias("near"),
            containment(F.col("sketch"), s).alias("inside"))).alias("s")))
    return rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch",
                       seen.alias("e")).select(
        "doc_id", "n_chars", F.col("e.sha").alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        F.col("e.s.print").alias("edited_fingerprint"),
        F.col("e.s.near").alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        F.col("e.s.inside").alias("contained_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("contained_next"))

"""Labelled training rows, all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT_BITS = 24


def third(doc_id: Column) -> Column:
    """The part of three that a row belongs to: crc32 of the id as text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from; a null id is not held out."""
    return F.coalesce(third(doc_id) == 1, F.lit(False))


def all_labels(labels: DataFrame, label: str) -> DataFrame:
    """(labelled_id, label) of every training row, however many there are.

    Held-out rows and rows without id or label take no part; of two labels of one id the
    larger counts.
    """
    return (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
            .where(~held_out(F.col("doc_id")))
            .groupBy(F.col("doc_id").alias("labelled_id"))
            .agg(F.max(F.col(label).cast("int")).alias("label")))


def labelled(docs: DataFrame, labels: DataFrame, label: str, *columns: str) -> DataFrame:
    """Every training document with its 0/1 ``label`` and its third as ``part``.

    Labels and documents meet in a shuffle at any size, for the labels have no bound.  A table of 2^24
    slots of label ids (at most 2^19 rows) goes to the documents first, so texts without a label, but
    for those that share a slot, are not shuffled.
    """
    known = all_labels(labels, label)
    train = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        *dict.fromkeys(["doc_id", *columns]))  # any other column may be called as those that join
    if docs.schema["doc_id"].dataType == labels.schema["doc_id"].dataType:  # else equal ids may hash apart
        train = _maybe_labelled(train, known)
    return train.join(known.hint("merge"), F.col("doc_id") == F.col("labelled_id")).select(
        *columns, "label", third(F.col("doc_id")).cast("int").alias("part"))


def _maybe_labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Documents whose id falls in a slot that some label's id falls in; none with a label is missing."""
    def slot(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(1 << SLOT_BITS))

    def bit(c: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1), c.bitwiseAND(F.lit(31)).cast("int"))

    words = known.select(slot("labelled_id").alias("slot")).groupBy(F.shiftright("slot", 5).alias("_word")).agg(
        F.bit_or(bit(F.col("slot"))).alias("_ones"))
    return docs.join(F.broadcast(words), F.shiftright(slot("doc_id"), 5) == F.col("_word")).where(
        F.col("_ones").bitwiseAND(bit(slot("doc_id"))) != 0).drop("_word", "_ones")

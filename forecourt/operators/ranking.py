"""Top-k lists and ranks.  Every ordering ends with a key, so ties are fixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt import lexicon as lx


def top_ranked(df: DataFrame, score: str, key: str, k: int = 20) -> DataFrame:
    """The k best rows with a 1-based rank.

    The limit comes first, so the unpartitioned window sees k rows, not a table.
    """
    top = df.orderBy(F.desc(score), key).limit(k)
    w = Window.orderBy(F.desc(score), key)
    return top.withColumn("rank", F.row_number().over(w))


def top_per_group(df: DataFrame, group: str, score: str, key: str, k: int) -> DataFrame:
    """At most k rows per group; Spark prunes to k per task before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc(score), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ordered(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.orderBy(*columns)


def bottom(df: DataFrame, score: str, key: str, k: int = 15) -> DataFrame:
    """The tail of the descending list, lowest first."""
    return df.orderBy(F.asc_nulls_last(score), key).limit(k)


def best_with_evidence(
    df: DataFrame, score: str = "_rating", key: str = "_title", count: str = "_review_count",
    k: int = 5, minimum: int = lx.EVIDENCE_MIN_REVIEWS,
) -> DataFrame:
    """The k best and the k worst rated stations among those with enough reviews."""
    enough = df.where((F.col(count) >= minimum) & F.col(score).isNotNull()).select(key, score)
    best = enough.orderBy(F.desc(score), key).limit(k).withColumn("list", F.lit("top"))
    worst = enough.orderBy(F.asc(score), key).limit(k).withColumn("list", F.lit("bottom"))
    return best.unionByName(worst)


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(k)

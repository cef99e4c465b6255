"""Join-shaped steps.

No side is broadcast by hint: Spark broadcasts a side whose measured size is
under its threshold and otherwise joins by shuffle, splitting skewed keys.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.functions.text import let
from forecourt.session import explode_once


def lookup(key: Column, table: Mapping[str, str], default: str) -> Column:
    """Value of a small literal dictionary, with a default."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def lookup_join(
    df: DataFrame, dimension: DataFrame, key: str, value: str, default
) -> DataFrame:
    """Left join with a default for unmatched keys."""
    dim = dimension.select(key, value)
    return df.join(dim, key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def members(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in a long list of keys."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def points(month: str = "month", value: str = "n") -> Column:
    """Aggregate: the (month, value) pairs of a series that was counted by month.

    There is one pair per calendar month, so the list stays small however many
    reviews stand behind it.
    """
    return F.collect_list(F.struct(F.col(month).alias("month"), F.col(value).alias("value")))


def on_spine(pairs: Column, months: Column) -> Column:
    """Array of (month, value) over all ``months``, zero where a pair is missing."""
    return let(F.map_from_entries(pairs), lambda known: F.transform(months, lambda m: F.struct(
        m.alias("month"),
        F.coalesce(F.try_element_at(known, m), F.lit(0)).alias("value"),
    )))


def fill_spine(
    counts: DataFrame, months: Column, group: str, month: str = "month", value: str = "n"
) -> DataFrame:
    """Every group gets every month of the array ``months``; missing ones are 0.

    The counts are already one row per group and month, so the spine is laid
    inside each group and neither side is joined.
    """
    rows = counts.groupBy(group).agg(points(month, value).alias("_p")).withColumn("_m", months)
    filled = explode_once(rows, [group], on_spine(F.col("_p"), F.col("_m")), "_s")
    return filled.select(group, F.col("_s.month").alias(month), F.col("_s.value").alias(value))


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Plan-time intersection of two headers, in the order of the first."""
    other = set(b.columns)
    return [c for c in a.columns if c in other]

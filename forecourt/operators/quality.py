"""Data-quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt import lexicon as lx


def in_bounds(lat: Column, lng: Column, box=lx.BOUNDING_BOX) -> Column:
    south, north, west, east = box
    return F.coalesce(lat.between(south, north) & lng.between(west, east), F.lit(False))


def with_bounds(df: DataFrame, lat="lat", lng="lng", box=lx.BOUNDING_BOX, name="accepted"):
    """All stations with a flag whether they lie in the box."""
    return df.withColumn(name, in_bounds(F.col(lat), F.col(lng), box))


def split_by_bounds(df: DataFrame, lat="lat", lng="lng", box=lx.BOUNDING_BOX):
    """(accepted, rejected) stations; missing coordinates are rejected."""
    inside = in_bounds(F.col(lat), F.col(lng), box)
    return df.where(inside), df.where(~inside)


def category_mismatch(
    brand: Column, category: Column, cng_brand=lx.CNG_BRAND, cng_category=lx.CNG_CATEGORY
) -> Column:
    """A gas brand whose category is not the gas category."""
    return F.coalesce((brand == cng_brand) & ~category.eqNullSafe(cng_category), F.lit(False))


def low_review_count(count: Column, minimum: int = lx.LOW_REVIEW_COUNT) -> Column:
    return F.coalesce(count < minimum, F.lit(True))


def audit_sample(
    df: DataFrame, id_column: str, by: str, size: int = lx.AUDIT_SAMPLE, seed: int = 42
) -> DataFrame:
    """A seeded random sample spread over the brands.

    Each brand's rows get a random order from a hash; the sample takes the first
    of every brand, then the second of every brand, until ``size`` rows are in.
    Both cuts prune to ``size`` rows per task.
    """
    ticket = F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f"|{seed}")))
    w = Window.partitionBy(by).orderBy("_ticket", id_column)
    turn = df.withColumn("_ticket", ticket).withColumn("_turn", F.row_number().over(w))
    return (
        turn.where(F.col("_turn") <= size).orderBy("_turn", "_ticket", id_column).limit(size)
        .drop("_turn", "_ticket")
    )


def ambiguous(confidence: Column, threshold: float = lx.AMBIGUOUS_CONFIDENCE) -> Column:
    return F.coalesce(confidence < threshold, F.lit(False))


def unmatched_brand(df: DataFrame, brand: str = "brand") -> DataFrame:
    return df.where(F.col(brand) == lx.BRAND_DEFAULT)

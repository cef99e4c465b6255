"""Sheets: CSV and Parquet in and out, and header resolution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt import lexicon as lx
from forecourt.functions import rules
from forecourt.sources.reviews import nan_columns_to_null


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False
) -> DataFrame:
    """CSV with a header and a fixed schema.

    Files split unless ``multi_line`` allows line breaks inside quotes.  An empty field is
    a missing value, as is usual for these sheets.
    """
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    return nan_columns_to_null(df)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def land_sheet(spark: SparkSession, path: str, schema: T.StructType | str | None = None):
    """A station or outlet sheet that was landed as CSV or Parquet."""
    if path.rstrip("/").endswith(".parquet") or schema is None:
        return nan_columns_to_null(spark.read.parquet(path))
    return read_csv(spark, path, schema)


def resolve_headers(columns: list[str], candidates: dict[str, list[str]]) -> dict[str, str]:
    """Map given headers to canonical names; the first candidate present wins."""
    by_name = {c.lower().strip(): c for c in columns}
    found: dict[str, str] = {}
    for canonical, names in candidates.items():
        hit = next((by_name[n] for n in names if n in by_name), None)
        if hit is not None:
            found[hit] = canonical
    return found


def normalize_stations(df: DataFrame, zones=None) -> DataFrame:
    """Canonical station table with sentiment, zone and fuel type."""
    out = df.withColumnsRenamed(resolve_headers(df.columns, lx.STATION_COLUMNS))
    have = set(out.columns)
    numbers = {
        c: rules.to_number(F.col(c)) for c in ("_rating", "_lat", "_lng") if c in have
    }
    if "_review_count" in have:
        numbers["_review_count"] = rules.floor_count(F.col("_review_count"))
    out = out.withColumns(numbers) if numbers else out
    tags = {}
    if "_rating" in have:
        tags["sentiment"] = rules.rating_sentiment(F.col("_rating"))
    if {"_lat", "_lng"} <= have:
        tags["zone"] = rules.zone(F.col("_lat"), F.col("_lng"), zones)
    if "_category" in have:
        tags["fuel_type"] = rules.fuel_type(F.col("_category"))
    return out.withColumns(tags) if tags else out


def normalize_reviews(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Canonical review table and the map back to the given headers."""
    names = resolve_headers(df.columns, lx.REVIEW_COLUMNS)
    out = df.withColumnsRenamed(names)
    if "_date" in out.columns:
        if not isinstance(out.schema["_date"].dataType, (T.TimestampType, T.DateType)):
            out = out.withColumn("_date", F.try_to_timestamp(F.col("_date").cast("string")))
        else:
            out = out.withColumn("_date", F.col("_date").cast("timestamp"))
    return out, {canonical: given for given, canonical in names.items()}


def has_review_text(columns: list[str]) -> bool:
    """Plan-time test: does a sheet carry review text, or only stations?"""
    given = {c.lower().strip() for c in columns}
    return bool(given & set(lx.REVIEW_COLUMNS["_review_text"]))


def dispatch(
    df: DataFrame,
    stations: Callable[[DataFrame], DataFrame],
    reviews: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Send a sheet to the station or the review job by its columns."""
    return reviews(df) if has_review_text(df.columns) else stations(df)


def display(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """The present columns of a view under their display headers."""
    return df.select([F.col(c).alias(h) for c, h in headers.items() if c in df.columns])

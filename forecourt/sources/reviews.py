"""Review documents: scan, sink, identity and incremental ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt import lexicon as lx
from forecourt.functions import rules
from forecourt.functions.text import strip

REVIEW_SCHEMA = T.StructType([
    T.StructField("review_id", T.StringType()),
    T.StructField("station_name", T.StringType()),
    T.StructField("station_address", T.StringType()),
    T.StructField("station_rating", T.DoubleType()),
    T.StructField("station_reviews", T.DoubleType()),
    T.StructField("brand", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("zone", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lng", T.DoubleType()),
    T.StructField("author_name", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("text", T.StringType()),
    T.StructField("date_relative", T.StringType()),
    T.StructField("date_iso", T.StringType()),
    T.StructField("collected_at", T.StringType()),
    T.StructField("source", T.StringType()),
])


def nan_columns_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers are NULL from here on, never NaN."""
    floats = {
        f.name: rules.nan_to_null(F.col(f"`{f.name}`"))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floats) if floats else df


CORRUPT = "_corrupt_record"


def review_reader(reader, schema: T.StructType, layout: str):
    """A JSON reader, batch or stream, that keeps what it cannot parse beside the fields."""
    if layout not in ("file", "line"):
        raise ValueError(f"unknown layout: {layout}")
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = reader.schema(full).option("columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE")
    if layout == "file":
        reader = reader.option("multiLine", True).option("pathGlobFilter", "*.json")
    return reader


def parsed(schema: T.StructType) -> Column:
    """True for rows without a parse error; names a field, as Spark reads no file for the error alone."""
    first = F.length(F.coalesce(F.col(schema.fields[0].name).cast("string"), F.lit("")))
    return F.col(CORRUPT).isNull() & (first >= 0)


def _placed(spark: SparkSession, path: str, schema: T.StructType, layout: str) -> DataFrame:
    raw = review_reader(spark.read, schema, layout).json(path)
    return raw.select("*", F.col("_metadata.file_path").alias("file"), F.struct(
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row")).alias("pos"))


def read_review_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType = REVIEW_SCHEMA,
    layout: str = "file",
) -> DataFrame:
    """Scan reviews, with their place as ``(file, pos)``.

    ``layout="line"`` has one review (or array) per line; files split, so a station with a
    third of all reviews is read by many tasks.  ``layout="file"`` takes each ``*.json``
    file as one array, which is parsed review by review and not held as one value.  Rows of
    one file come in order within a block.  What cannot be parsed is left to ``rejects``.
    """
    rows = _placed(spark, path, schema, layout).where(parsed(schema)).drop(CORRUPT)
    return nan_columns_to_null(rows.select("file", "pos", *[f"`{f.name}`" for f in schema.fields]))


def rejects(spark: SparkSession, path: str, schema: T.StructType = REVIEW_SCHEMA,
            layout: str = "file") -> DataFrame:
    """(file, review_id, record) of what a scan could not parse."""
    rows = _placed(spark, path, schema, layout).where(F.col(CORRUPT).isNotNull())
    return rows.select("file", schema.fields[0].name, F.col(CORRUPT).alias("record"))


def write_station_json(df: DataFrame, path: str, key: str = "station_key") -> None:
    """One folder of JSON lines per station.

    The rebalance hint splits a station that is too large for one file and joins
    small ones, on run-time sizes.
    """
    df.hint("rebalance", key).write.partitionBy(key).json(path)


def read_station_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return nan_columns_to_null(spark.read.schema(schema).json(path))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order.

    ``row_number() = 1`` lets Spark drop all but one row per key and task before
    the shuffle, so a key that holds a third of the table costs one row a task.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def unseen(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is not among ``known``.

    The known keys are made distinct first: a hot key is then one row, not a
    third of the table.
    """
    return df.join(known.select(*keys).distinct(), keys, "left_anti")


def merge_passes(
    first: DataFrame, second: DataFrame, keys: list[str], order: list[Column]
) -> DataFrame:
    """All of the first pass plus the second pass's unseen keys, once each.

    The second pass is reduced to one row per key first: copies of a hot key go
    before any shuffle, and the anti join reuses that partitioning.
    """
    extra = unseen(keep_first(second, keys, order), first, keys)
    return first.unionByName(extra)


def pending(stations: DataFrame, done: DataFrame, key: str = "station_key") -> DataFrame:
    """Stations that have no output yet."""
    return unseen(stations, done, [key])


def take_stations(stations: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` stations of the sheet; the caller chose the number."""
    return stations.orderBy(*order).limit(n)


def station_defaults(sheet: DataFrame, idx: str = "idx") -> DataFrame:
    """Canonical station columns with alternates and defaults.

    Alternates and coordinate defaults apply when a column is absent, which is
    known at plan time.
    """
    have = set(sheet.columns)

    def first_present(names: list[str], default: Column) -> Column:
        for name in names:
            if name in have:
                return F.col(name)
        return default

    title = first_present(
        ["title"], F.concat(F.lit("Station_"), F.col(idx).cast("string"))
    )
    return sheet.select(
        F.col(idx),
        strip(title.cast("string")).alias("title"),
        rules.clean_address(first_present(["address"], F.lit("")).cast("string")).alias("address"),
        first_present(["lat", "latitude_clean"], F.lit(lx.DEFAULT_LAT)).cast("double").alias("lat"),
        first_present(["lng", "longitude_clean"], F.lit(lx.DEFAULT_LNG)).cast("double").alias("lng"),
        first_present(["totalScore"], F.lit(None)).cast("double").alias("rating"),
        first_present(["reviewsCount"], F.lit(0)).cast("double").alias("review_count"),
        first_present(["categoryName"], F.lit("")).cast("string").alias("category_name"),
    )


def tag_stations(stations: DataFrame, idx: str = "idx") -> DataFrame:
    """Brand, zone, category and file key of each station."""
    return stations.withColumns({
        "brand": rules.brand(F.col("title")),
        "zone": rules.zone(
            F.col("lat"), F.col("lng"), missing_label=lx.ZONE_MISSING_AT_COLLECTION
        ),
        "category": rules.station_category(F.col("category_name")),
        "station_key": rules.station_key(F.col("title"), F.col(idx)),
    })

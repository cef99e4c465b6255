"""Monthly series and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt import lexicon as lx
from forecourt.functions.rules import relative_month
from forecourt.operators.aggregates import is_negative, pct
from forecourt.operators.joins import fill_spine, on_spine, points
from forecourt.session import explode_once

VOLUME, NEGATIVES, RATE = "volume", "negative_count", "negative_rate"
UNITS = {"Monthly": "month", "Weekly": "week", "Quarterly": "quarter"}


def with_month(df: DataFrame, relative: str = "date_relative", reference=lx.REFERENCE_MONTH):
    """Month of each dated row; rows without a usable date drop out."""
    out = df.withColumn("month", relative_month(F.col(relative), reference))
    return out.where(F.col("month").isNotNull())


def monthly_volume(df: DataFrame) -> DataFrame:
    return df.groupBy("month").agg(F.count("*").alias("n"))


def monthly_sentiment(df: DataFrame) -> DataFrame:
    return df.where(F.col("sentiment").isNotNull()).groupBy("month", "sentiment").agg(
        F.count("*").alias("n")
    )


def monthly_negative_rate(df: DataFrame) -> DataFrame:
    return df.groupBy("month").agg(pct(F.count_if(is_negative()), F.count("*")).alias("negative_pct"))


def _worst_series(counts: DataFrame, issue: str, k: int) -> DataFrame:
    """The k largest issues, one row each with their monthly pairs.

    ``counts`` is one row per issue and month; the list and the totals come from
    one aggregation, so the reviews are read once.
    """
    totals = counts.groupBy(issue).agg(F.sum("n").alias("_total"), points().alias("_p"))
    return totals.orderBy(F.desc("_total"), issue).limit(k)


def top_issue_trends(df: DataFrame, k: int = 5, issue: str = "issue_category") -> DataFrame:
    """Monthly counts of the k most frequent issues."""
    monthly = df.where(F.col(issue).isNotNull()).groupBy("month", issue).agg(
        F.count("*").alias("n")
    )
    rows = _worst_series(monthly, issue, k).select(issue, F.explode("_p").alias("_s"))
    return rows.select(F.col("_s.month").alias("month"), issue, F.col("_s.value").alias("n"))


def network_series(df: DataFrame) -> DataFrame:
    """Long table of the three network series over the observed months."""
    per = df.groupBy("month").agg(
        F.count("*").alias("n"), F.count_if(is_negative()).alias("neg")
    )
    parts = F.array(
        F.struct(F.lit(VOLUME).alias("series_id"), F.col("n").cast("double").alias("value")),
        F.struct(F.lit(NEGATIVES).alias("series_id"), F.col("neg").cast("double").alias("value")),
        F.struct(F.lit(RATE).alias("series_id"), pct(F.col("neg"), F.col("n")).alias("value")),
    )
    return per.select("month", F.explode(parts).alias("s")).select("s.series_id", "month", "s.value")


def observed_months(df: DataFrame) -> Column:
    """Array of the months that occur; its size is bounded by the calendar."""
    return df.select("month").distinct().agg(F.collect_list("month")).scalar()


def issue_series(
    df: DataFrame, k: int = 4, issue: str = "issue_category", by: list[str] | None = None
) -> DataFrame:
    """Monthly negatives of the k worst issues, zero-filled over observed months.

    With ``by`` there is one series per combination of those columns instead,
    e.g. station and issue, for every combination that has negatives.
    """
    # One count holds both the negatives and, in its groups, the observed months.  Both sides
    # read "n" (always true for the months), else the optimizer would drop it from one of them and
    # Spark could not use one shuffle of the reviews for both.
    key = F.concat_ws("|", *by).alias("series_id") if by else F.col(issue)
    everything = df.groupBy(key, "month").agg(F.count_if(is_negative()).alias("n"))
    months = observed_months(everything.where("n >= 0"))
    counts = everything.where("n > 0")
    if by:
        filled = fill_spine(counts, months, "series_id")
        return filled.select("series_id", "month", F.col("n").cast("double").alias("value"))
    worst = _worst_series(counts.where(F.col(issue).isNotNull()), issue, k).withColumn("_m", months)
    rows = explode_once(
        worst.withColumnRenamed(issue, "series_id"), ["series_id"],
        on_spine(F.col("_p"), F.col("_m")), "_s",
    )
    return rows.select(
        "series_id", F.col("_s.month").alias("month"), F.col("_s.value").cast("double").alias("value")
    )


def long_enough(series: DataFrame, minimum: int = 6) -> DataFrame:
    """Series with at least ``minimum`` points; one row per series and month."""
    w = Window.partitionBy("series_id")
    return (
        series.withColumn("_points", F.count("*").over(w))
        .where(F.col("_points") >= minimum).drop("_points")
    )


def dated_trend(
    df: DataFrame, unit: str = "month", date: str = "_date", minimum: int | None = None
) -> DataFrame:
    """Reviews per period and sentiment; with a ``minimum``, empty below so many dated rows."""
    return dated_trends(df, [unit], date, minimum).drop("unit")


def dated_trends(
    df: DataFrame, units: list[str], date: str = "_date", minimum: int | None = None
) -> DataFrame:
    """``dated_trend`` for several units from one daily count, so the rows are read once."""
    daily = df.where(F.col(date).isNotNull()).groupBy(
        F.col(date).cast("date").alias("_day"), "sentiment").agg(F.count("*").alias("_n"))
    rows = daily.where(F.col("sentiment").isNotNull()).select(
        "_day", "sentiment", "_n", F.explode(F.array(*map(F.lit, units))).alias("unit"))
    period = F.coalesce(*[F.when(F.col("unit") == u, F.date_trunc(u, "_day").cast("date"))
                          for u in units])
    out = rows.groupBy("unit", period.alias("period"), "sentiment").agg(F.sum("_n").alias("n"))
    if minimum is None:
        return out
    # The guard adds up the daily counts once more, not the rows.
    return out.where(daily.agg(F.sum("_n")).scalar() >= minimum)

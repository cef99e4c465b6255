"""Row filters behind the views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt import lexicon as lx
from forecourt.functions.rules import nan_to_null
from forecourt.functions.text import not_blank


def facets(df: DataFrame, selected: Mapping[str, Sequence]) -> DataFrame:
    """Rows whose value is among the selected ones, for every facet given.

    A missing value never matches; a facet the table lacks is skipped.
    """
    out = df
    for name, values in selected.items():
        if name in df.columns:
            out = out.where(F.col(name).isin(list(values)))
    return out


def facet_values(df: DataFrame, name: str) -> DataFrame:
    """Sorted distinct values of a facet, missing ones left out."""
    return df.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name)


def date_range(
    df: DataFrame, column: str, low: str, high: str, inclusive_day: bool = False
) -> DataFrame:
    """Rows between two dates.

    The upper bound is the midnight that starts the last day, so later rows of
    that day drop out; ``inclusive_day`` keeps them.
    """
    return df.where(in_dates(F.col(column), low, high, inclusive_day))


def in_dates(ts: Column, low: str, high: str, inclusive_day: bool = False) -> Column:
    """The test of ``date_range`` as a column."""
    start, last = F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp")
    if inclusive_day:
        return (ts >= start) & (ts < F.lit(high).cast("date") + F.expr("INTERVAL 1 DAY"))
    return ts.between(start, last)


def with_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.where(not_blank(F.col(column)))


def browse(df: DataFrame, issue: str, sentiment: str | None = None) -> DataFrame:
    out = df.where(F.col("issue_category") == issue)
    return out if sentiment is None else out.where(F.col("sentiment") == sentiment)


def negatives_of_issue(
    df: DataFrame, issue: str, order: list[Column], limit: int = 10
) -> DataFrame:
    """The first negative reviews of an issue (a top-k list)."""
    return browse(df, issue, lx.NEGATIVE).orderBy(*order).limit(limit)


def rated(df: DataFrame) -> DataFrame:
    return df.where(F.col("sentiment") != lx.UNKNOWN)


def located(df: DataFrame, lat: str = "lat", lng: str = "lng") -> DataFrame:
    la, lo = nan_to_null(F.col(lat)), nan_to_null(F.col(lng))
    return df.where(la.isNotNull() & lo.isNotNull())


def with_evidence(
    df: DataFrame, column: str, minimum: int = lx.EVIDENCE_MIN_REVIEWS
) -> DataFrame:
    return df.where(F.col(column) >= minimum)


def critical_stations(
    ranking: DataFrame, threshold: float = lx.CRITICAL_NEGATIVE_PCT
) -> DataFrame:
    """How many stations reach a negative share."""
    return ranking.agg(F.count_if(F.col("negative_pct") >= threshold).alias("critical_stations"))


def mismatches(df: DataFrame, rating: str = "rating") -> DataFrame:
    """Reviews with a high rating and a negative text."""
    test = (F.col(rating) >= lx.MISMATCH_RATING) & (F.col("sentiment") == lx.NEGATIVE)
    return df.agg(F.count_if(test).alias("mismatches"))


def flags(
    df: DataFrame, fraud_issue: str = lx.FRAUD_ISSUE, praise_issue: str = lx.PRAISE_ISSUE
) -> DataFrame:
    """Fraud reviews, negative fraud reviews and praise of staff, in one pass."""
    fraud = F.col("issue_category") == fraud_issue
    praise = F.col("issue_category") == praise_issue
    return df.agg(
        F.count_if(fraud).alias("fraud_reviews"),
        F.count_if(fraud & (F.col("sentiment") == lx.NEGATIVE)).alias("fraud_negative"),
        F.count_if(praise & (F.col("sentiment") == lx.POSITIVE)).alias("staff_praise"),
    )


def one_station(df: DataFrame, name: str, column: str = "station_name") -> DataFrame:
    return df.where(F.col(column) == name)

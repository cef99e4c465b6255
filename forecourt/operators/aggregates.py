"""Aggregate views.

All of them are hash aggregations with map-side partial results, so a key that
holds a third of the rows costs one partial row per task.  Totals of a small
aggregate come from a scalar subquery instead of a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt import lexicon as lx
from forecourt.functions import rules


def is_sentiment(label: str) -> Column:
    return F.col("sentiment") == label


def is_negative() -> Column:
    return is_sentiment(lx.NEGATIVE)


def pct(part: Column, total: Column) -> Column:
    """Percentage as a double; NULL for an empty total."""
    return F.try_divide(part * F.lit(100.0), total)


def _counts() -> list[Column]:
    return [
        F.count_if(is_sentiment(label)).alias(label.lower())
        for label in lx.SENTIMENTS
    ]


def kpi(df: DataFrame, star: str | None = "bert_star", confidence: str | None = "confidence"):
    """Totals, shares, mean star and mean confidence."""
    aggs = [F.count("*").alias("reviews"), *_counts()]
    if star:
        aggs.append(F.avg(star).alias("avg_star"))
    if confidence:
        aggs.append((F.avg(confidence) * 100).alias("avg_confidence_pct"))
    out = df.agg(*aggs)
    return out.withColumns({
        f"{name}_pct": pct(F.col(name), F.col("reviews"))
        for name in ("positive", "neutral", "negative")
    })


def value_counts(df: DataFrame, column: str, share: bool = True) -> DataFrame:
    """Rows per value and their share in percent, one decimal."""
    if not share:
        return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    # Missing values count in the total, so they are a group until the shares are made;
    # the window runs over one row per value.
    everything = Window.partitionBy(F.lit(0))
    counts = df.groupBy(column).agg(F.count("*").alias("n")).withColumn(
        "share_pct", F.round(pct(F.col("n"), F.sum("n").over(everything)), 1))
    return counts.where(F.col(column).isNotNull())


def cross_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return df.where(both).groupBy(a, b).agg(F.count("*").alias("n"))


def cross_counts_of(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``cross_counts`` of several pairs in long form, with the rows read once.

    The rows are first counted over all columns involved; each pair then adds up its part
    of that cube.
    """
    columns = sorted({c for pair in pairs for c in pair})
    cube = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    views = F.array(*[F.struct(
        F.lit(a).alias("dim_a"), F.lit(b).alias("dim_b"), F.col(a).cast("string").alias("value_a"),
        F.col(b).cast("string").alias("value_b")) for a, b in pairs])
    rows = cube.select("_n", F.explode(views).alias("v")).select("v.*", "_n")
    return rows.where(F.col("value_a").isNotNull() & F.col("value_b").isNotNull()).groupBy(
        "dim_a", "dim_b", "value_a", "value_b").agg(F.sum("_n").alias("n"))


def negative_rate(df: DataFrame, by: str) -> DataFrame:
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(
        pct(F.count_if(is_negative()), F.count("*")).alias("negative_pct")
    )


def brand_scorecard(
    df: DataFrame, brand: str = "brand", station: str = "station_name",
    rating: str = "station_rating",
) -> DataFrame:
    out = df.where(F.col(brand).isNotNull()).groupBy(F.col(brand).alias("brand")).agg(
        F.count_distinct(station).alias("stations"),
        F.count("*").alias("reviews"),
        *_counts(),
        F.round(F.avg(rating), 2).alias("avg_station_rating"),
    )
    return out.withColumns({
        "positive_pct": F.round(pct(F.col("positive"), F.col("reviews")), 1),
        "negative_pct": F.round(pct(F.col("negative"), F.col("reviews")), 1),
    }).orderBy(F.desc("positive_pct"), "brand")


def urgency(
    df: DataFrame,
    order_key: Column,
    station: str = "station_name",
    rating: str = "station_rating",
    reviews: str = "station_reviews",
    zone: str = "zone",
    brand: str = "brand",
) -> DataFrame:
    """Stations by negative share, review count and distance from five stars.

    Zone, brand and review count are those of the station's first row.  The
    first step groups by station *and* these attributes, which keeps every
    buffer fixed-width (a hash aggregation without sorting the input); the
    second step picks the first row among the few combinations left.
    """
    present = set(df.columns)

    def column(name: str, default) -> Column:
        return F.col(name) if name in present else F.lit(default)

    rate = column(rating, lx.DEFAULT_STATION_RATING).cast("double")
    combos = (
        df.where(F.col(station).isNotNull())
        .select(
            F.col(station).alias("station"),
            column(zone, "—").alias("zone"),
            column(brand, "—").alias("brand"),
            column(reviews, lx.DEFAULT_STATION_REVIEWS).cast("double").alias("count"),
            rate.alias("rate"),
            F.when(is_negative(), 1).otherwise(0).alias("neg"),
            order_key.alias("key"),
        )
        .groupBy("station", "zone", "brand", "count")
        .agg(
            F.count("*").alias("n"),
            F.sum("neg").alias("neg"),
            F.sum("rate").alias("rate_sum"),
            F.count("rate").alias("rate_n"),
            F.min("key").alias("key"),
        )
    )
    first = F.min_by(F.struct("zone", "brand", "count"), F.struct("key", "zone", "brand", "count"))
    per = combos.groupBy("station").agg(
        first.alias("first"),
        F.sum("n").alias("nlp_reviews"),
        F.sum("neg").alias("neg"),
        F.try_divide(F.sum("rate_sum"), F.sum("rate_n")).alias("avg_rating"),
    )
    count = F.greatest(F.coalesce(F.col("first.count"), F.lit(1.0)), F.lit(1.0))
    neg_pct = pct(F.col("neg"), F.col("nlp_reviews"))
    # A station without any rating has no distance, so its factor is zero.
    gap = F.coalesce(F.greatest(F.lit(0.0), F.lit(5.0) - F.col("avg_rating")), F.lit(0.0))
    gap = F.when(F.col("avg_rating").isNull(), F.lit(0.0)).otherwise(gap)
    return per.select(
        "station",
        F.col("first.zone").alias("zone"),
        F.col("first.brand").alias("brand"),
        F.round("avg_rating", 2).alias("avg_rating"),
        count.cast("long").alias("google_reviews"),
        "nlp_reviews",
        F.round(neg_pct, 1).alias("negative_pct"),
        F.round(neg_pct * F.log1p(count) * gap, 1).alias("urgency_score"),
    )


def zone_stats(
    df: DataFrame, rating: str = "station_rating", address: str = "station_address"
) -> DataFrame:
    out = df.where(F.col("zone").isNotNull()).groupBy("zone").agg(
        F.count("sentiment").alias("reviews"),
        *_counts(),
        F.avg(rating).alias("avg_rating"),
        F.count_distinct(address).alias("stations"),
    )
    return out.withColumns({
        "pos_pct": pct(F.col("positive"), F.col("reviews")),
        "neg_pct": pct(F.col("negative"), F.col("reviews")),
    }).orderBy(F.desc("neg_pct"), "zone")


def station_zone_stats(df: DataFrame, rating: str = "_rating") -> DataFrame:
    out = df.where(F.col("zone").isNotNull()).groupBy("zone").agg(
        F.count(rating).alias("stations"),
        F.avg(rating).alias("avg_rating"),
        F.count_if(is_sentiment(lx.POSITIVE)).alias("positive"),
        F.count_if(is_negative()).alias("negative"),
    )
    return out.withColumns({
        "pos_pct": pct(F.col("positive"), F.col("stations")),
        "neg_pct": pct(F.col("negative"), F.col("stations")),
    }).orderBy(F.desc("avg_rating"), "zone")


def aspect_matrix(df: DataFrame, aspects: str = "aspects") -> DataFrame:
    """Aspect by polarity with the share of negatives; one pass, no join."""
    # An outer explode evaluates the map once, see session.explode_once.
    rows = df.select(F.explode_outer(aspects).alias("aspect", "polarity"))
    out = rows.where(F.col("aspect").isNotNull()).groupBy("aspect").agg(*[
        F.count_if(F.col("polarity") == p).alias(p.lower()) for p in lx.SENTIMENTS
    ], F.count("*").alias("_n"))
    share = F.when(F.col("negative") > 0, pct(F.col("negative"), F.col("_n")))
    return out.withColumn("negativity_pct", share).drop("_n").orderBy(
        F.desc_nulls_last("negativity_pct"), "aspect"
    )


def station_count(
    df: DataFrame, coordinates: Sequence[str] = ("lat", "lng"), name: str = "station_name",
    approximate: bool = False,
) -> DataFrame:
    """Distinct places by coordinates, or by name when there are none."""
    if set(coordinates) <= set(df.columns):
        complete = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in coordinates])
        key = F.when(complete, F.struct(*coordinates))
    else:
        key = F.col(name)
    if approximate:
        return df.agg(F.approx_count_distinct(F.when(key.isNotNull(), F.xxhash64(key))).alias("stations"))
    return df.agg(F.count_distinct(key).alias("stations"))


def pivot_counts(
    df: DataFrame, row: str, column: str, values: Sequence[str], other: str | None = None
) -> DataFrame:
    """Counts with one column per listed value, zero where there are none.

    With ``other`` a column of that name counts all further values.
    """
    rest = [] if other is None else [
        F.count_if(~F.col(column).isin(list(values))).alias(other)]
    return df.where(F.col(row).isNotNull()).groupBy(row).agg(*[
        F.count_if(F.col(column) == v).alias(str(v)) for v in values
    ], *rest)


def pivot_mean(
    df: DataFrame, row: str, column: str, value: str, values: Sequence[str],
    other: str | None = None,
) -> DataFrame:
    """Means with one column per listed value; with ``other`` one for all further values."""
    def mean(of: Column, name: str) -> Column:
        return F.coalesce(F.avg(F.when(of, F.col(value))), F.lit(0.0)).alias(name)
    rest = [] if other is None else [mean(~F.col(column).isin(list(values)), other)]
    return df.groupBy(row).agg(*[mean(F.col(column) == v, str(v)) for v in values], *rest)


def histogram(
    df: DataFrame, value: str, low: float, high: float, bins: int, by: str | None = None
) -> DataFrame:
    """Rows per fixed-width bin and their sum; the top edge belongs to the last bin."""
    width = (high - low) / bins
    slot = F.least(F.floor((F.col(value) - low) / width).cast("int"), F.lit(bins - 1))
    inside = df.where(F.col(value).between(low, high)).withColumn("bin", slot)
    keys = ["bin"] + ([by] if by else [])
    return inside.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).withColumns({
        "bin_low": F.lit(low) + F.col("bin") * width,
        "bin_high": F.lit(low) + (F.col("bin") + 1) * width,
    })


def station_issues(df: DataFrame, issue: str = "issue_category") -> DataFrame:
    """Reviews per issue of the station(s) in ``df``."""
    return cross_counts(df, "station_name", issue)


def station_detail(df: DataFrame, order_key: Column, rating: str = "station_rating"):
    """Mix, mean rating and first attributes of the station(s) in ``df``."""
    attrs = ["brand", "zone", "category"]
    combos = df.select(
        "station_name", *attrs, "sentiment", F.col(rating).alias("rate"), order_key.alias("key")
    ).groupBy("station_name", *attrs).agg(
        F.count("*").alias("reviews"), *_counts(), F.sum("rate").alias("rate_sum"),
        F.count("rate").alias("rate_n"), F.min("key").alias("key"),
    )
    first = F.min_by(F.struct(*attrs), F.struct("key", *attrs))
    return combos.groupBy("station_name").agg(
        F.sum("reviews").alias("reviews"),
        *[F.sum(c).alias(c) for c in ("positive", "neutral", "negative")],
        F.try_divide(F.sum("rate_sum"), F.sum("rate_n")).alias("avg_rating"),
        first.alias("first"),
    ).select("*", "first.*").drop("first")


def most_negative_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``most_negative`` for several columns in long form, with the rows read once."""
    cube = df.where(is_negative()).groupBy(*columns).agg(F.count("*").alias("_n"))
    values = F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).alias("value")) for c in columns])
    counts = cube.select("_n", F.explode(values).alias("v")).groupBy("v.dim", "v.value").agg(
        F.sum("_n").alias("negatives"))
    per_dim = Window.partitionBy("dim")
    first = per_dim.orderBy(F.col("value").isNull(), F.desc("negatives"), "value")
    return counts.withColumns({
        "share_pct": pct(F.col("negatives"), F.sum("negatives").over(per_dim)),
        "_place": F.row_number().over(first),
    }).where(F.col("value").isNotNull() & (F.col("_place") == 1)).drop("_place")


def most_negative(df: DataFrame, column: str) -> DataFrame:
    """The value with most negative reviews, and its share of all negatives."""
    counts = df.where(is_negative()).groupBy(column).agg(F.count("*").alias("negatives"))
    total = F.sum("negatives").over(Window.partitionBy(F.lit(0)))  # over one row per value
    return (
        counts.withColumn("share_pct", pct(F.col("negatives"), total))
        .where(F.col(column).isNotNull())
        .orderBy(F.desc("negatives"), column)
        .limit(1)
    )


def best_and_worst(table: DataFrame, name: str, score: str) -> DataFrame:
    """First and last row of a ranking by score (then name) and their gap."""
    key = F.struct((-F.col(score)).alias("s"), F.col(name).alias("n"))
    return table.agg(
        F.min_by(name, key).alias("best"),
        F.max(score).alias("best_score"),
        F.max_by(name, key).alias("worst"),
        F.min(score).alias("worst_score"),
        (F.max(score) - F.min(score)).alias("gap"),
    )


def low_evidence(df: DataFrame, column: str, minimum: int = lx.EVIDENCE_MIN_REVIEWS):
    return df.agg(F.count_if(F.col(column) < minimum).alias("low_evidence"))


def station_kpi(df: DataFrame, rating: str = "_rating") -> DataFrame:
    out = df.agg(F.count("*").alias("stations"), *_counts(), F.avg(rating).alias("avg_rating"))
    return out.withColumns({
        f"{name}_pct": pct(F.col(name), F.col("stations"))
        for name in ("positive", "neutral", "negative")
    })


def map_centre(df: DataFrame, lat: str = "lat", lng: str = "lng") -> DataFrame:
    return df.agg(F.avg(lat).alias("lat"), F.avg(lng).alias("lng"))


def city_rating(df: DataFrame, rating: str = "_rating") -> DataFrame:
    mean = df.agg(F.avg(rating).alias("avg_rating"))
    return mean.withColumn("band", rules.city_band(F.col("avg_rating")))


def severity_of(df: DataFrame, thresholds=lx.SEVERITY_NETWORK) -> DataFrame:
    share = df.agg(pct(F.count_if(is_negative()), F.count("*")).alias("negative_pct"))
    return share.withColumn("severity", rules.severity(F.col("negative_pct"), thresholds))

"""Filters (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt import lexicon as lx
from forecourt.catalog import query
from forecourt.catalog.aggregate_queries import _URGENCY, stations, urgency_fact
from forecourt.catalog.tables import RF, ST, TF, read, review_fact, station_sheet, text_fact
from forecourt.operators import filters
from forecourt.sources.tabular import normalize_stations


@query("f01_facets", RF + """
SELECT key, brand, zone, category, sentiment FROM rf
WHERE brand IN ('Brand#1', 'Brand#7', 'Brand#12') AND zone IN ('ASIA', 'EUROPE')
  AND category IN ('A', 'N') AND sentiment IN ('Negative', 'Neutral')""")
def f01(spark, d):
    df = review_fact(spark, d, "key", "brand", "zone", "category", "sentiment")
    return filters.facets(df, {
        "brand": ["Brand#1", "Brand#7", "Brand#12"], "zone": ["ASIA", "EUROPE"],
        "category": ["A", "N"], "sentiment": ["Negative", "Neutral"], "absent": ["x"]})


@query("f02_facet_values", RF + """
SELECT DISTINCT brand FROM rf WHERE brand IS NOT NULL ORDER BY brand""")
def f02(spark, d):
    return filters.facet_values(review_fact(spark, d, "brand"), "brand")


@query("f03_station_facets", ST + """
SELECT title, zone, fuel_type, sentiment FROM st WHERE sentiment IN ('Negative', 'Neutral')
  AND zone IN ('South Mumbai', 'North Suburbs') AND fuel_type IN ('CNG', 'Petrol / Diesel')""")
def f03(spark, d):
    out = filters.facets(stations(spark, d), {
        "zone": ["South Mumbai", "North Suburbs"], "fuel_type": ["CNG", "Petrol / Diesel"],
        "sentiment": ["Negative", "Neutral"]})
    return out.select(F.col("_title").alias("title"), "zone", "fuel_type", "sentiment")


@query("f04_review_facets", RF + """
SELECT key, sentiment, issue_category, station_name FROM rf WHERE sentiment = 'Positive'
  AND issue_category IN ('ECONOMY', 'PROMO') AND station_name LIKE '%5'""")
def f04(spark, d):
    df = review_fact(spark, d, "key", "sentiment", "issue_category", "station_name")
    outlets = read(spark, d, "supplier").where("s_name LIKE '%5'").select(
        F.col("s_name").alias("station_name"))
    from forecourt.operators.joins import members
    out = filters.facets(df, {"sentiment": ["Positive"], "issue_category": ["ECONOMY", "PROMO"]})
    return members(out, outlets, "station_name")


@query("f05_date_range", """
SELECT event_id, ts, ts <= TIMESTAMP '2024-01-20' AS strict FROM events
WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-21'""")
def f05(spark, d):
    events = read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    whole = filters.date_range(events, "ts", "2024-01-10", "2024-01-20", inclusive_day=True)
    return whole.withColumn("strict", filters.in_dates(F.col("ts"), "2024-01-10", "2024-01-20"))


@query("f06_non_empty_text", r"""
SELECT doc_id, md5(text) AS text_md5 FROM (SELECT doc_id,
  CASE WHEN doc_id % 5 = 1 THEN chr(160) || '  ' || chr(9) WHEN doc_id % 5 = 2 THEN NULL ELSE text END
  AS text FROM documents) WHERE text IS NOT NULL AND regexp_matches(text, '[^\s\x{a0}]')""")
def f06(spark, d):
    text = F.when(F.col("doc_id") % 5 == 1, "\u00a0  \t").when(F.col("doc_id") % 5 != 2, F.col("text"))
    df = read(spark, d, "documents").select("doc_id", text.alias("text"))
    return filters.with_text(df).select("doc_id", F.md5("text").alias("text_md5"))


@query("f07_browse", RF + """
SELECT key, issue_category, sentiment FROM rf
WHERE issue_category = 'ECONOMY' AND sentiment = 'Neutral'""")
def f07(spark, d):
    return filters.browse(review_fact(spark, d, "key", "issue_category", "sentiment"), "ECONOMY",
                          lx.NEUTRAL)


@query("f08_negatives_of_issue", RF + """
SELECT key, issue_category, confidence FROM rf
WHERE issue_category = 'ECONOMY' AND sentiment = 'Negative' ORDER BY key, confidence LIMIT 10""")
def f08(spark, d):
    df = review_fact(spark, d, "key", "issue_category", "sentiment", "confidence")
    return filters.negatives_of_issue(
        df, "ECONOMY", [F.col("key"), F.col("confidence")]).drop("sentiment")


@query("f09_rated", TF + "SELECT doc_id, sentiment FROM tf WHERE sentiment <> 'Unknown'")
def f09(spark, d):
    return filters.rated(text_fact(spark, d)).select("doc_id", "sentiment")


@query("f10_located", ST + """
SELECT title, lat, lng FROM st WHERE lat IS NOT NULL AND lng IS NOT NULL""")
def f10(spark, d):
    out = filters.located(normalize_stations(station_sheet(spark, d)), "_lat", "_lng")
    return out.select(F.col("_title").alias("title"), F.col("_lat").alias("lat"),
                      F.col("_lng").alias("lng"))


@query("f11_with_evidence", ST + "SELECT title, review_count FROM st WHERE review_count >= 50")
def f11(spark, d):
    out = filters.with_evidence(normalize_stations(station_sheet(spark, d)), "_review_count")
    return out.select(F.col("_title").alias("title"), F.col("_review_count").alias("review_count"))


@query("f12_critical_stations", RF + _URGENCY + """
SELECT count(*) FILTER (negative_pct >= 40) AS critical_stations FROM pq""")
def f12(spark, d):
    return filters.critical_stations(urgency_fact(spark, d))


@query("f13_mismatches", RF + """
SELECT count(*) FILTER (l_quantity / 10 >= 4 AND sentiment = 'Negative') AS mismatches FROM rf""")
def f13(spark, d):
    df = review_fact(spark, d, "confidence", "sentiment")
    return filters.mismatches(df.withColumn("rating", F.col("confidence") * 5))


@query("f14_flags", RF + """
SELECT count(*) FILTER (issue_category = 'PROMO') AS fraud_reviews,
  count(*) FILTER (issue_category = 'PROMO' AND sentiment = 'Negative') AS fraud_negative,
  count(*) FILTER (issue_category = 'ECONOMY' AND sentiment = 'Positive') AS staff_praise FROM rf""")
def f14(spark, d):
    return filters.flags(review_fact(spark, d, "issue_category", "sentiment"), "PROMO", "ECONOMY")


@query("f15_one_station", RF + """
SELECT key, station_name, sentiment FROM rf WHERE station_name = 'Supplier#000000003'""")
def f15(spark, d):
    df = review_fact(spark, d, "key", "station_name", "sentiment")
    return filters.one_station(df, "Supplier#000000003")

"""Aggregates (A), ranks (W), orderings (O), joins (J), sets (U) and P1."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from forecourt.catalog import query
from forecourt.catalog.tables import RF, ST, TF, read, review_fact, station_sheet, text_fact
from forecourt.functions import rules
from forecourt.operators import aggregates as ag
from forecourt.operators import joins, ranking
from forecourt.operators.filters import rated
from forecourt.plans.overview import overview
from forecourt.sources.reviews import keep_first, unseen
from forecourt.sources.tabular import normalize_stations


def stations(spark, d):
    return rated(normalize_stations(station_sheet(spark, d)))


def rounded(df, *columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("a01_kpi", RF + """
SELECT count(*) AS reviews,
  count(*) FILTER (sentiment = 'Positive') AS positive,
  count(*) FILTER (sentiment = 'Neutral') AS neutral,
  count(*) FILTER (sentiment = 'Negative') AS negative,
  round(avg(bert_star), 4) AS avg_star, round(avg(confidence) * 100, 4) AS avg_confidence_pct,
  round(100.0 * count(*) FILTER (sentiment = 'Positive') / count(*), 4) AS positive_pct,
  round(100.0 * count(*) FILTER (sentiment = 'Neutral') / count(*), 4) AS neutral_pct,
  round(100.0 * count(*) FILTER (sentiment = 'Negative') / count(*), 4) AS negative_pct
FROM rf""")
def a01(spark, d):
    df = review_fact(spark, d, "sentiment", "bert_star", "confidence")
    return rounded(ag.kpi(df), "avg_star", "avg_confidence_pct", "positive_pct", "neutral_pct",
                   "negative_pct")


@query("a02_value_counts", RF + """
SELECT issue_category, count(*) AS n,
  round(100.0 * count(*) / (SELECT count(*) FROM rf), 1) AS share_pct
FROM rf GROUP BY issue_category""")
def a02(spark, d):
    return ag.value_counts(review_fact(spark, d, "issue_category"), "issue_category")


_PAIRS = [("bert_star", "sentiment"), ("issue_category", "sentiment"), ("rating", "sentiment"),
          ("brand", "issue_category"), ("zone", "sentiment")]


@query("a03_cross_counts", RF + " UNION ALL ".join(
    f"SELECT '{a}' AS dim_a, '{b}' AS dim_b, CAST({a} AS VARCHAR) AS value_a, "
    f"CAST({b} AS VARCHAR) AS value_b, count(*) AS n FROM rf GROUP BY {a}, {b}"
    for a, b in _PAIRS))
def a03(spark, d):
    columns = sorted({c for pair in _PAIRS for c in pair})
    return ag.cross_counts_of(review_fact(spark, d, *columns), _PAIRS)


@query("a04_negative_rate", RF + """
SELECT issue_category, round(avg(CASE WHEN sentiment = 'Negative' THEN 1 ELSE 0 END) * 100, 4)
  AS negative_pct
FROM rf GROUP BY issue_category""")
def a04(spark, d):
    df = review_fact(spark, d, "issue_category", "sentiment")
    return rounded(ag.negative_rate(df, "issue_category"), "negative_pct")


_SCORECARD = """
SELECT brand, count(DISTINCT station_name) AS stations, count(*) AS reviews,
  count(*) FILTER (sentiment = 'Positive') AS positive,
  count(*) FILTER (sentiment = 'Neutral') AS neutral,
  count(*) FILTER (sentiment = 'Negative') AS negative,
  round(avg(station_rating), 2) AS avg_station_rating,
  round(100.0 * count(*) FILTER (sentiment = 'Positive') / count(*), 1) AS positive_pct,
  round(100.0 * count(*) FILTER (sentiment = 'Negative') / count(*), 1) AS negative_pct
FROM rf GROUP BY brand"""


def _scorecard(spark, d):
    return ag.brand_scorecard(
        review_fact(spark, d, "brand", "station_name", "sentiment", "station_rating"))


@query("a05_brand_scorecard", RF + _SCORECARD)
def a05(spark, d):
    return _scorecard(spark, d)


_URGENCY = """, first_rows AS (
  SELECT station_name, zone, brand, station_reviews,
    row_number() OVER (PARTITION BY station_name ORDER BY key, zone, brand) AS rn
  FROM rf
), per AS (
  SELECT station_name, count(*) AS n, count(*) FILTER (sentiment = 'Negative') AS neg,
    avg(rating) AS avg_rating
  FROM rf GROUP BY station_name
), pq AS (
  SELECT p.station_name AS station, f.zone, f.brand, round(avg_rating, 2) AS avg_rating,
    CAST(greatest(1, station_reviews) AS BIGINT) AS google_reviews, n AS nlp_reviews,
    round(100.0 * neg / n, 1) AS negative_pct,
    round(100.0 * neg / n * ln(1 + greatest(1, station_reviews)) * greatest(0, 5 - avg_rating), 1)
      AS urgency_score
  FROM per p JOIN first_rows f ON p.station_name = f.station_name AND f.rn = 1
)
"""


def urgency_fact(spark, d):
    fact = review_fact(spark, d, "station_name", "zone", "brand", "rating", "station_reviews",
                       "sentiment", "key")
    return ag.urgency(fact, F.col("key"), rating="rating")


@query("a06_urgency", RF + _URGENCY + "SELECT * FROM pq")
def a06(spark, d):
    return urgency_fact(spark, d)


_ZONES = """
SELECT zone, count(*) AS reviews,
  count(*) FILTER (sentiment = 'Positive') AS positive,
  count(*) FILTER (sentiment = 'Neutral') AS neutral,
  count(*) FILTER (sentiment = 'Negative') AS negative,
  round(avg(station_rating), 4) AS avg_rating, count(DISTINCT station_address) AS stations,
  round(100.0 * count(*) FILTER (sentiment = 'Positive') / count(*), 4) AS pos_pct,
  round(100.0 * count(*) FILTER (sentiment = 'Negative') / count(*), 4) AS neg_pct
FROM rf GROUP BY zone"""


def _zones(spark, d):
    df = review_fact(spark, d, "zone", "sentiment", "station_rating", "station_address")
    return ag.zone_stats(df)


@query("a07_zone_stats", RF + _ZONES)
def a07(spark, d):
    return rounded(_zones(spark, d), "avg_rating", "pos_pct", "neg_pct")


@query("a08_station_zone_stats", ST + """
SELECT zone, count(rating) AS stations, round(avg(rating), 4) AS avg_rating,
  count(*) FILTER (sentiment = 'Positive') AS positive,
  count(*) FILTER (sentiment = 'Negative') AS negative,
  round(100.0 * count(*) FILTER (sentiment = 'Positive') / count(rating), 4) AS pos_pct,
  round(100.0 * count(*) FILTER (sentiment = 'Negative') / count(rating), 4) AS neg_pct
FROM st WHERE sentiment <> 'Unknown' GROUP BY zone""")
def a08(spark, d):
    return rounded(ag.station_zone_stats(stations(spark, d)), "avg_rating", "pos_pct", "neg_pct")


@query("a11_station_count", RF + """
SELECT count(*) AS stations FROM (SELECT DISTINCT lat, lng FROM rf
  WHERE lat IS NOT NULL AND lng IS NOT NULL)""")
def a11(spark, d):
    return ag.station_count(review_fact(spark, d, "lat", "lng"))


_TYPES = ["ECONOMY", "STANDARD", "SMALL", "MEDIUM", "LARGE", "PROMO"]


@query("a12_zone_issue_pivot", RF + "SELECT zone, " + ", ".join(
    f"count(*) FILTER (issue_category = '{t}') AS \"{t}\"" for t in _TYPES)
    + " FROM rf GROUP BY zone")
def a12(spark, d):
    return ag.pivot_counts(review_fact(spark, d, "zone", "issue_category"), "zone",
                           "issue_category", _TYPES)


@query("a12_pivot_with_rest", RF + """
SELECT zone, count(*) FILTER (issue_category = 'ECONOMY') AS "ECONOMY",
  count(*) FILTER (issue_category <> 'ECONOMY') AS rest FROM rf GROUP BY zone""")
def a12_rest(spark, d):
    return ag.pivot_counts(review_fact(spark, d, "zone", "issue_category"), "zone",
                           "issue_category", ["ECONOMY"], other="rest")


_BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query("a12_urgency_pivot", RF + _URGENCY + "SELECT zone, " + ", ".join(
    f"round(coalesce(avg(urgency_score) FILTER (brand = '{b}'), 0), 4) AS \"{b}\"" for b in _BRANDS)
    + " FROM pq GROUP BY zone")
def a12b(spark, d):
    out = ag.pivot_mean(urgency_fact(spark, d), "zone", "brand", "urgency_score", _BRANDS)
    return out.select("zone", *[F.round(F.col(f"`{b}`"), 4).alias(b) for b in _BRANDS])


@query("a13_negative_histogram", RF + _URGENCY + """
SELECT CAST(least(floor(negative_pct / (100.0 / 15)), 14) AS INTEGER) AS bin, count(*) AS n,
  (SELECT round(avg(negative_pct), 4) FROM pq) AS mean
FROM pq GROUP BY 1""")
def a13(spark, d):
    bins = ag.histogram(urgency_fact(spark, d), "negative_pct", 0.0, 100.0, 15)
    whole = Window.partitionBy(F.lit(0))  # over the bins
    mean = F.round(F.sum("total").over(whole) / F.sum("n").over(whole), 4)
    return bins.select("bin", "n", mean.alias("mean"))


@query("a13_rating_histogram", ST + """
SELECT sentiment, CAST(least(floor((rating - 1.0) / CAST(0.2 AS DOUBLE)), 19) AS INTEGER) AS bin,
  count(*) AS n
FROM st WHERE sentiment <> 'Unknown' AND rating BETWEEN 1 AND 5 GROUP BY 1, 2""")
def a13b(spark, d):
    return ag.histogram(stations(spark, d), "_rating", 1.0, 5.0, 20, "sentiment").select(
        "sentiment", "bin", "n")


@query("a14_station_detail", RF + """, f AS (
  SELECT station_name, brand, zone, category,
    row_number() OVER (PARTITION BY station_name ORDER BY key, brand, zone, category) AS rn FROM rf)
SELECT rf.station_name, count(*) AS reviews,
  count(*) FILTER (sentiment = 'Positive') AS positive,
  count(*) FILTER (sentiment = 'Neutral') AS neutral,
  count(*) FILTER (sentiment = 'Negative') AS negative,
  round(avg(station_rating), 4) AS avg_rating, any_value(f.brand) AS brand,
  any_value(f.zone) AS zone, any_value(f.category) AS category
FROM rf JOIN f ON rf.station_name = f.station_name AND f.rn = 1 GROUP BY rf.station_name""")
def a14(spark, d):
    df = review_fact(spark, d, "station_name", "brand", "zone", "category", "sentiment",
                     "station_rating", "key")
    return rounded(ag.station_detail(df, F.col("key")), "avg_rating")


@query("a14_station_issues", RF + """
SELECT station_name, issue_category, count(*) AS n FROM rf GROUP BY 1, 2""")
def a14_issues(spark, d):
    return ag.station_issues(review_fact(spark, d, "station_name", "issue_category"))


@query("a15_modes", RF + """
(SELECT 'zone' AS dim, zone AS value, count(*) AS negatives,
  round(100.0 * count(*) / (SELECT count(*) FROM rf WHERE sentiment = 'Negative'), 4) AS share_pct
FROM rf WHERE sentiment = 'Negative' GROUP BY zone ORDER BY negatives DESC, zone LIMIT 1)
UNION ALL
(SELECT 'issue_category', issue_category, count(*) AS negatives,
  round(100.0 * count(*) / (SELECT count(*) FROM rf WHERE sentiment = 'Negative'), 4)
FROM rf WHERE sentiment = 'Negative' GROUP BY issue_category
ORDER BY negatives DESC, issue_category LIMIT 1)""")
def a15(spark, d):
    fact = review_fact(spark, d, "zone", "issue_category", "sentiment")
    return rounded(ag.most_negative_of(fact, ["zone", "issue_category"]), "share_pct")


@query("a16_best_and_worst", RF + f""", sc AS ({_SCORECARD})
SELECT (SELECT brand FROM sc ORDER BY positive_pct DESC, brand LIMIT 1) AS best,
  max(positive_pct) AS best_score,
  (SELECT brand FROM sc ORDER BY positive_pct, brand DESC LIMIT 1) AS worst,
  min(positive_pct) AS worst_score, round(max(positive_pct) - min(positive_pct), 4) AS gap
FROM sc""")
def a16(spark, d):
    return rounded(ag.best_and_worst(_scorecard(spark, d), "brand", "positive_pct"), "gap")


@query("a17_low_evidence", ST + """
SELECT count(*) FILTER (review_count < 50) AS low_evidence FROM st WHERE sentiment <> 'Unknown'""")
def a17(spark, d):
    return ag.low_evidence(stations(spark, d), "_review_count")


@query("a18_station_kpi", ST + """
SELECT count(*) AS stations, count(*) FILTER (sentiment = 'Positive') AS positive,
  count(*) FILTER (sentiment = 'Neutral') AS neutral,
  count(*) FILTER (sentiment = 'Negative') AS negative, round(avg(rating), 4) AS avg_rating,
  round(100.0 * count(*) FILTER (sentiment = 'Positive') / count(*), 4) AS positive_pct,
  round(100.0 * count(*) FILTER (sentiment = 'Neutral') / count(*), 4) AS neutral_pct,
  round(100.0 * count(*) FILTER (sentiment = 'Negative') / count(*), 4) AS negative_pct
FROM st WHERE sentiment <> 'Unknown'""")
def a18(spark, d):
    return rounded(ag.station_kpi(stations(spark, d)), "avg_rating", "positive_pct",
                   "neutral_pct", "negative_pct")


@query("a19_map_centre", RF + "SELECT round(avg(lat), 4) AS lat, round(avg(lng), 4) AS lng FROM rf")
def a19(spark, d):
    return rounded(ag.map_centre(review_fact(spark, d, "lat", "lng")), "lat", "lng")


@query("a20_label_frequency", TF + """
SELECT sentiment AS label, count(*) AS reviews FROM tf GROUP BY sentiment""")
def a20(spark, d):
    from forecourt.operators.topics import topic_frequency
    return topic_frequency(text_fact(spark, d).withColumnRenamed("sentiment", "label"))


@query("a21_city_band", ST + """
SELECT round(avg(rating), 4) AS avg_rating,
  CASE WHEN avg(rating) >= 3.6 THEN 'above' WHEN avg(rating) < 3.0 THEN 'below' ELSE 'at' END AS band
FROM st WHERE sentiment <> 'Unknown'""")
def a21(spark, d):
    return rounded(ag.city_rating(stations(spark, d)), "avg_rating")


_VIEWS = [(), ("sentiment",), ("issue_category",), ("issue_category", "sentiment"),
          ("bert_star", "sentiment"), ("zone", "sentiment"), ("brand", "issue_category")]


def _view_sql(view):
    dims = ["bert_star", "brand", "issue_category", "sentiment", "zone"]
    cols = ", ".join((c if c in view else f"NULL AS {c}") for c in dims)
    group = f" GROUP BY {', '.join(view)}" if view else ""
    return (f"SELECT {cols}, count(*) AS n, count(*) FILTER (rf.sentiment = 'Negative') AS negatives,"
            f" '{'+'.join(view) or 'total'}' AS view FROM rf{group}")


@query("p01_overview", RF + " UNION ALL ".join(_view_sql(v) for v in _VIEWS))
def p01(spark, d):
    return overview(review_fact(spark, d, "sentiment", "issue_category", "bert_star", "zone", "brand"))


# Windows and ranks -----------------------------------------------------------


@query("w01_urgency_rank", RF + _URGENCY + """
SELECT row_number() OVER (ORDER BY urgency_score DESC, station) AS rank, station, urgency_score
FROM pq QUALIFY rank <= 20""")
def w01(spark, d):
    return ranking.top_ranked(urgency_fact(spark, d), "urgency_score", "station").select(
        "rank", "station", "urgency_score")


@query("w02_first_in_group", RF + """
SELECT station_name, zone AS first_zone, brand AS first_brand, key FROM (
  SELECT *, row_number() OVER (PARTITION BY station_name ORDER BY key, zone, brand) AS rn FROM rf)
WHERE rn = 1""")
def w02(spark, d):
    df = review_fact(spark, d, "station_name", "zone", "brand", "key")
    combos = df.groupBy("station_name", "zone", "brand").agg(F.min("key").alias("key"))
    order = F.struct("key", "zone", "brand")
    return combos.groupBy("station_name").agg(
        F.min_by("zone", order).alias("first_zone"), F.min_by("brand", order).alias("first_brand"),
        F.min("key").alias("key"))


@query("w03_top_per_group", RF + """
SELECT zone, brand, n, rank FROM (
  SELECT zone, brand, count(*) AS n,
    row_number() OVER (PARTITION BY zone ORDER BY count(*) DESC, brand) AS rank
  FROM rf GROUP BY zone, brand) WHERE rank <= 3""")
def w03(spark, d):
    counts = ag.cross_counts(review_fact(spark, d, "zone", "brand"), "zone", "brand")
    return ranking.top_per_group(counts, "zone", "n", "brand", 3)


_ALL = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate"]


@query("w04_keep_first", f"""
SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (
  PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_ALL)}) AS rn FROM lineitem)
WHERE rn = 1""")
def w04(spark, d):
    return keep_first(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"],
                      [F.col(c) for c in _ALL])


# Orderings and limits --------------------------------------------------------


@query("o01_scorecard_order", ST + """
SELECT title AS "Station", rating AS "Avg Rating", review_count AS "Total Reviews",
  sentiment AS "Sentiment", zone AS "Zone", fuel_type AS "Fuel Type", address AS "Address"
FROM st WHERE sentiment <> 'Unknown' ORDER BY rating DESC, title""")
def o01(spark, d):
    from forecourt import lexicon as lx
    from forecourt.sources.tabular import display
    return ranking.ordered(display(stations(spark, d), lx.STATION_SCORECARD_HEADERS),
                           F.desc("Avg Rating"), "Station")


@query("o02_bottom", ST + """
SELECT title, rating FROM st WHERE sentiment <> 'Unknown' ORDER BY rating, title LIMIT 15""")
def o02(spark, d):
    return ranking.bottom(stations(spark, d), "_rating", "_title").select(
        F.col("_title").alias("title"), F.col("_rating").alias("rating"))


@query("o03_best_with_evidence", ST + """
(SELECT title, rating, 'top' AS list FROM st WHERE review_count >= 50 AND rating IS NOT NULL
 ORDER BY rating DESC, title LIMIT 5) UNION ALL
(SELECT title, rating, 'bottom' FROM st WHERE review_count >= 50 AND rating IS NOT NULL
 ORDER BY rating, title LIMIT 5)""")
def o03(spark, d):
    return ranking.best_with_evidence(stations(spark, d)).select(
        F.col("_title").alias("title"), F.col("_rating").alias("rating"), "list")


@query("o04_top_issue_trends", RF + """
SELECT month, issue_category, count(*) AS n FROM rf WHERE issue_category IN (
  SELECT issue_category FROM rf GROUP BY issue_category ORDER BY count(*) DESC, issue_category LIMIT 5)
GROUP BY month, issue_category""")
def o04(spark, d):
    from forecourt.operators.series import top_issue_trends
    return top_issue_trends(review_fact(spark, d, "month", "issue_category"))


@query("o05_top_negative_issues", RF + """
SELECT issue_category, count(*) AS n FROM rf WHERE sentiment = 'Negative'
GROUP BY issue_category ORDER BY n DESC, issue_category LIMIT 4""")
def o05(spark, d):
    df = review_fact(spark, d, "issue_category", "sentiment")
    return ranking.top_values(df.where(ag.is_negative()), "issue_category", 4)


# Joins and set operations ----------------------------------------------------


@query("j01_calendar_spine", RF + """, m AS (SELECT DISTINCT month FROM rf),
b AS (SELECT DISTINCT brand AS series_id FROM rf WHERE sentiment = 'Negative'),
c AS (SELECT brand, month, count(*) AS n FROM rf WHERE sentiment = 'Negative' GROUP BY ALL)
SELECT b.series_id, m.month, coalesce(n, 0) AS n
FROM b CROSS JOIN m LEFT JOIN c ON c.brand = b.series_id AND c.month = m.month""")
def j01(spark, d):
    from forecourt.operators.series import observed_months
    df = review_fact(spark, d, "brand", "month", "sentiment")
    counts = df.where(ag.is_negative()).groupBy(F.col("brand").alias("series_id"), "month").agg(
        F.count("*").alias("n"))
    return joins.fill_spine(counts, observed_months(df), "series_id")


@query("j02_aligned_division", RF + """
SELECT issue_category, round(100.0 * neg / n, 4) AS negative_pct FROM (
  SELECT issue_category, count(*) AS n FROM rf GROUP BY 1) LEFT JOIN (
  SELECT issue_category, count(*) AS neg FROM rf WHERE sentiment = 'Negative' GROUP BY 1)
  USING (issue_category)""")
def j02(spark, d):
    df = review_fact(spark, d, "issue_category", "sentiment")
    neg = F.count_if(ag.is_negative())
    return df.groupBy("issue_category").agg(
        F.round(F.when(neg > 0, ag.pct(neg, F.count("*"))), 4).alias("negative_pct"))


@query("j03_lookup_default", RF + """
SELECT key, CASE category WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE 'none' END AS colour,
  coalesce(n_name, '#94a3b8') AS named
FROM rf LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON rf.station_address = n.n_name""")
def j03(spark, d):
    df = review_fact(spark, d, "key", "category", "station_address")
    dim = read(spark, d, "nation").where("n_regionkey < 3").select(
        F.col("n_name").alias("station_address"), F.col("n_name").alias("named"))
    out = joins.lookup_join(df, dim, "station_address", "named", "#94a3b8")
    colour = joins.lookup(F.col("category"), {"A": "accepted", "R": "returned"}, "none")
    return out.select("key", colour.alias("colour"), "named")


@query("j04_membership", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (
  SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def j04(spark, d):
    keys = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("o_custkey"))
    return joins.members(read(spark, d, "orders").select("o_orderkey", "o_custkey"), keys, "o_custkey")


@query("j05_anti_membership", """
SELECT c_custkey AS custkey FROM customer WHERE NOT EXISTS (
  SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def j05(spark, d):
    customers = read(spark, d, "customer").select(F.col("c_custkey").alias("custkey"))
    partial = read(spark, d, "orders").where("o_orderstatus = 'P'")
    return unseen(customers, partial.select(F.col("o_custkey").alias("custkey")), ["custkey"])


@query("u01_concatenate", """
SELECT 'documents' AS origin, text FROM documents UNION ALL
SELECT 'benchmark', text FROM benchmark UNION ALL SELECT 'conversations', text FROM conversations""")
def u01(spark, d):
    parts = [read(spark, d, t).select(F.lit(t).alias("origin"), "text")
             for t in ("documents", "benchmark", "conversations")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("u03_word_overlap", r"""
SELECT a.doc_id, len(list_intersect(
  list_distinct(regexp_extract_all(lower(a.text), '[\p{L}\p{N}_]{2,}')),
  ['the', 'and', 'der', 'die', 'les', 'des', 'que', 'los'])) AS overlap FROM documents a""")
def u03(spark, d):
    from forecourt.catalog.tables import documents
    from forecourt.functions.text import word_tokens
    words = F.array(*map(F.lit, ["the", "and", "der", "die", "les", "des", "que", "los"]))
    n = F.size(F.array_intersect(word_tokens(F.col("text"), []), words)).cast("long")
    return documents(spark, d).select("doc_id", n.alias("overlap"))


@query("u04_common_columns", """
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1 UNION ALL
  SELECT doc_id, count(*) FROM labels GROUP BY 1) GROUP BY doc_id""")
def u04(spark, d):
    a, b = read(spark, d, "documents"), read(spark, d, "labels")
    shared = joins.common_columns(a, b)
    return a.select(*shared).unionByName(b.select(*shared)).groupBy(*shared).agg(
        F.count("*").alias("n"))

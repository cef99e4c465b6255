"""Data-quality rules (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt.catalog import query
from forecourt.catalog.tables import RF, read, review_fact
from forecourt.functions import rules
from forecourt.operators import quality

_CUSTOMERS = """
WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey <> 7 THEN CAST(18.85 AS DOUBLE) + c_acctbal / 20000 END
  AS lat, CAST(72.77 AS DOUBLE) + c_nationkey * CAST(0.01 AS DOUBLE) AS lng FROM customer)
"""


@query("d01_bounding_box", _CUSTOMERS + """
SELECT c_custkey, coalesce(lat >= CAST(18.89 AS DOUBLE) AND lat <= CAST(19.28 AS DOUBLE)
  AND lng >= CAST(72.77 AS DOUBLE) AND lng <= CAST(73.00 AS DOUBLE), false) AS accepted FROM c""")
def d01(spark, d):
    df = read(spark, d, "customer").select(
        "c_custkey",
        F.when(F.col("c_nationkey") != 7, F.lit(18.85) + F.col("c_acctbal") / 20000).alias("lat"),
        (F.lit(72.77) + F.col("c_nationkey") * 0.01).alias("lng"))
    return quality.with_bounds(df).select("c_custkey", "accepted")


@query("d02_category_mismatch", RF + """
SELECT key, brand = 'Brand#5' AND category <> 'A' AS mismatch FROM rf""")
def d02(spark, d):
    df = review_fact(spark, d, "key", "brand", "category")
    flag = quality.category_mismatch(F.col("brand"), F.col("category"), "Brand#5", "A")
    return df.select("key", flag.alias("mismatch"))


@query("d03_low_review_count", """
SELECT c_custkey, coalesce(n, 0) AS n, coalesce(n, 0) < 10 AS low FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def d03(spark, d):
    counts = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"))
    df = read(spark, d, "customer").select("c_custkey").join(counts, "c_custkey", "left")
    return df.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"),
                     quality.low_review_count(F.col("n")).alias("low"))


@query("d04_audit_sample", """
SELECT p_partkey, brand FROM (SELECT p_partkey, p_brand AS brand, ticket,
    row_number() OVER (PARTITION BY p_brand ORDER BY ticket, p_partkey) AS turn
  FROM (SELECT *, md5(CAST(p_partkey AS VARCHAR) || '|42') AS ticket FROM part))
ORDER BY turn, ticket, p_partkey LIMIT 30""")
def d04(spark, d):
    stations = read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    return quality.audit_sample(stations, "p_partkey", "brand")


@query("d05_ambiguous", RF + "SELECT key, confidence, confidence < 0.35 AS ambiguous FROM rf")
def d05(spark, d):
    return review_fact(spark, d, "key", "confidence").withColumn(
        "ambiguous", quality.ambiguous(F.col("confidence")))


@query("d06_unmatched_brand", RF + """
SELECT key, item FROM rf WHERE item NOT LIKE '%red%' AND item NOT LIKE '%ring%'""")
def d06(spark, d):
    brand = rules.brand(F.col("item"), [("red", "Red"), ("ring", "Ring")])
    df = review_fact(spark, d, "key", "item").withColumn("brand", brand)
    return quality.unmatched_brand(df).drop("brand")

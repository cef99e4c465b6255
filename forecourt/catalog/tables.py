"""Adapters from the given tables to the review model, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.functions.rules import star_sentiment
from forecourt.session import dealt

REFERENCE = "2002-01-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return dealt(read(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text"))))


_ORDER = {"bert_star", "rating", "sentiment", "ts", "month", "date_relative"}
_PART = {"brand", "issue_category", "item"}
_SUPPLIER = {"station_name", "station_rating", "station_reviews", "lat"}
_NATION = {"station_address", "lng"}
_REGION = {"zone"}
_LINEITEM = {
    "key": ("l_orderkey", "l_linenumber"), "review_id": ("l_orderkey", "l_linenumber"),
    "category": ("l_returnflag",), "confidence": ("l_quantity",),
    "date_relative": ("l_quantity", "l_returnflag"),
}


def review_fact(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """Line items as reviews, joined only with the tables the fields need.

    Every foreign key has exactly one match, so leaving a table out changes no
    row.  Spark picks the join: small dimensions are broadcast by measured size,
    large ones shuffle with run-time skew handling.
    """
    need = set(fields)
    columns = sorted({c for f in fields for c in _LINEITEM.get(f, ())} | {
        c for group, c in ((_ORDER, "l_orderkey"), (_PART, "l_partkey"),
                           (_SUPPLIER | _NATION | _REGION, "l_suppkey")) if need & group})
    df = read(spark, sf_dir, "lineitem").select(*columns)
    if "date_relative" in need:
        df = dealt(df)
    if need & _ORDER:
        orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if need & _PART:
        df = df.join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if need & (_SUPPLIER | _NATION | _REGION):
        df = df.join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    if need & (_NATION | _REGION):
        df = df.join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    if need & _REGION:
        df = df.join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    star = F.substring("o_orderpriority", 1, 1).cast("int")
    back = (
        (F.year(F.lit(REFERENCE).cast("date")) - F.year("o_orderdate")) * 12
        + F.month(F.lit(REFERENCE).cast("date")) - F.month("o_orderdate")
    )
    if "date_relative" in need:
        df = df.withColumn("back", back)
        back = F.col("back")
    relative = (
        F.when(F.col("l_quantity") == 1, F.lit("2 days ago"))
        .when(back == 0, F.lit("3 weeks ago"))
        .when(back == 1, F.lit("a month ago"))
        .when(back == 12, F.lit("Edited a year ago"))
        .when(back % 12 == 0, F.concat((back / 12).cast("int").cast("string"), F.lit(" years ago")))
        .when(F.col("l_returnflag") == "A",
              F.concat(F.lit("Edited "), back.cast("string"), F.lit(" months ago")))
        .otherwise(F.concat(back.cast("string"), F.lit(" months ago")))
    )
    exprs = {
        "key": lambda: F.col("l_orderkey") * 8 + F.col("l_linenumber"),
        "review_id": lambda: F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")),
        "category": lambda: F.col("l_returnflag"),
        "confidence": lambda: F.col("l_quantity") / 50,
        "bert_star": lambda: star,
        "rating": lambda: star.cast("double"),
        "sentiment": lambda: star_sentiment(star),
        "ts": lambda: F.col("o_orderdate").cast("timestamp"),
        "month": lambda: F.trunc("o_orderdate", "month"),
        "date_relative": lambda: relative,
        "brand": lambda: F.col("p_brand"),
        "issue_category": lambda: F.col("p_type"),
        "item": lambda: F.col("p_name"),
        "station_name": lambda: F.col("s_name"),
        "station_rating": lambda: F.col("s_acctbal") / 2750 + 1.5,
        "station_reviews": lambda: (F.col("s_suppkey") * 37 % 900).cast("double"),
        "lat": lambda: F.lit(18.85) + F.col("s_acctbal") / 20000,
        "station_address": lambda: F.col("n_name"),
        "lng": lambda: F.lit(72.77) + F.col("s_nationkey") * 0.01,
        "zone": lambda: F.col("r_name"),
    }
    return df.select([exprs[f]().alias(f) for f in fields])


# The same relation for the SQL side, written on its own.
RF = """
WITH rf AS (
  SELECT *,
    CASE WHEN bert_star <= 2 THEN 'Negative' WHEN bert_star = 3 THEN 'Neutral'
         ELSE 'Positive' END AS sentiment,
    CAST(bert_star AS DOUBLE) AS rating,
    CASE WHEN l_quantity = 1 THEN '2 days ago'
         WHEN back = 0 THEN '3 weeks ago'
         WHEN back = 1 THEN 'a month ago'
         WHEN back = 12 THEN 'Edited a year ago'
         WHEN back % 12 = 0 THEN CAST(back // 12 AS VARCHAR) || ' years ago'
         WHEN l_returnflag = 'A' THEN 'Edited ' || CAST(back AS VARCHAR) || ' months ago'
         ELSE CAST(back AS VARCHAR) || ' months ago' END AS date_relative
  FROM (
    SELECT l_orderkey * 8 + l_linenumber AS key,
      CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS review_id,
      l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus,
      l_returnflag AS category, l_quantity / 50 AS confidence,
      CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS bert_star,
      o_orderdate AS ts, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
      (2002 - year(o_orderdate)) * 12 + 1 - month(o_orderdate) AS back,
      p_brand AS brand, p_type AS issue_category, p_name AS item,
      s_name AS station_name, s_acctbal / 2750 + CAST(1.5 AS DOUBLE) AS station_rating,
      CAST(s_suppkey * 37 % 900 AS DOUBLE) AS station_reviews,
      CAST(18.85 AS DOUBLE) + s_acctbal / 20000 AS lat,
      CAST(72.77 AS DOUBLE) + s_nationkey * CAST(0.01 AS DOUBLE) AS lng,
      n_name AS station_address, r_name AS zone
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN part ON l_partkey = p_partkey
    JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
  )
)
"""


def text_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as reviews; the label, where there is one, is the sentiment."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    labels = read(spark, sf_dir, "labels").withColumn("labelled", F.lit(True))
    sentiment = (
        F.when(F.col("labelled").isNull(), "Unknown")
        .when(F.col("toxic") == 1, "Negative")
        .when(F.col("quality") == 1, "Positive")
        .otherwise("Neutral")
    )
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "text", F.col("lang").alias("zone"), F.col("source").alias("station_name"),
        sentiment.alias("sentiment"),
    )


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``text_fact`` without what the labels say, so that no text meets them in a shuffle.

    A document is there as often as it has labels, at least once.  Where one has several, the documents whose
    ids may be such, by a table of 2^24 slots (at most 2^19 rows), meet these ids.
    """
    def slot(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(1 << 24))

    def bit(c: str) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), slot(c).bitwiseAND(F.lit(31)).cast("int"))

    docs = documents(spark, sf_dir, "doc_id", "text")
    more = read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("labelled_id")).agg(
        F.count("*").alias("n")).where("n > 1 and labelled_id is not null")
    if more.isEmpty():
        return docs
    words = more.groupBy(F.shiftright(slot("labelled_id"), 5).alias("word")).agg(F.bit_or(bit("labelled_id")).alias("ones"))
    marked = docs.join(F.broadcast(words), F.shiftright(slot("doc_id"), 5) == F.col("word"), "left").withColumn(
        "hit", F.coalesce(F.col("ones").bitwiseAND(bit("doc_id")) != 0, F.lit(False)))
    several = marked.where("hit").join(more, F.col("doc_id") == F.col("labelled_id"), "left").select(
        "doc_id", "text", F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1)).cast("int"))).alias("i"))
    return marked.where(~F.col("hit")).select("doc_id", "text").unionByName(several.drop("i"))


TF = """
WITH tf AS (
  SELECT d.doc_id, d.text, d.lang AS zone, d.source AS station_name,
    CASE WHEN l.doc_id IS NULL THEN 'Unknown' WHEN toxic = 1 THEN 'Negative'
         WHEN quality = 1 THEN 'Positive' ELSE 'Neutral' END AS sentiment
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)
"""


def station_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as an uploaded sheet: odd headers, numbers as text, bad values."""
    df = read(spark, sf_dir, "supplier").join(
        read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    cents = F.floor((F.col("s_acctbal") + 1000) / 11000 * 400).cast("int") + 100
    number = F.concat(
        F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")
    )
    return df.select(
        F.col("s_name").alias("Title"),
        F.when(F.col("s_suppkey") % 10 == 3, "n/a").otherwise(number).alias("TotalScore"),
        F.when(F.col("s_suppkey") % 7 != 2, (F.col("s_suppkey") * 37 % 900).cast("string"))
        .alias("reviewsCount"),
        F.col("n_name").alias("Address"),
        F.when(F.col("s_suppkey") % 11 != 5, F.lit(18.85) + F.col("s_acctbal") / 20000).alias("lat"),
        (F.lit(72.77) + F.col("s_nationkey") * 0.01).alias("lng"),
        F.when(F.col("s_nationkey") % 4 == 0, "Compressed natural gas station")
        .when(F.col("s_nationkey") % 4 != 1, "Gas station").alias("categoryName"),
    )


ST = """
WITH sheet AS (
  SELECT s_suppkey, s_name AS title,
    CASE WHEN s_suppkey % 10 = 3 THEN NULL
         ELSE (CAST(floor((s_acctbal + 1000) / 11000 * 400) AS INTEGER) + 100) / 100.0 END
      AS rating,
    CASE WHEN s_suppkey % 7 = 2 THEN 1.0
         ELSE CAST(greatest(s_suppkey * 37 % 900, 1) AS DOUBLE) END AS review_count,
    n_name AS address,
    CASE WHEN s_suppkey % 11 <> 5 THEN CAST(18.85 AS DOUBLE) + s_acctbal / 20000 END AS lat,
    CAST(72.77 AS DOUBLE) + s_nationkey * CAST(0.01 AS DOUBLE) AS lng,
    CASE WHEN s_nationkey % 4 = 0 THEN 'CNG' ELSE 'Petrol / Diesel' END AS fuel_type
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
), st AS (
  SELECT title, CAST(rating AS DOUBLE) AS rating, review_count, address, lat, lng, fuel_type,
    CASE WHEN rating IS NULL THEN 'Unknown' WHEN rating <= 2.5 THEN 'Negative'
         WHEN rating <= 3.5 THEN 'Neutral' ELSE 'Positive' END AS sentiment,
    CASE WHEN lat IS NULL OR lng IS NULL THEN 'Unknown'
         WHEN lat < CAST(18.970 AS DOUBLE) THEN 'South Mumbai'
         WHEN lat < CAST(19.050 AS DOUBLE) THEN 'Central Mumbai'
         WHEN lat < CAST(19.150 AS DOUBLE) AND lng < CAST(72.880 AS DOUBLE) THEN 'Western Suburbs'
         WHEN lat < CAST(19.150 AS DOUBLE) THEN 'Eastern Suburbs'
         ELSE 'North Suburbs' END AS zone
  FROM sheet
)
"""


def sql_list(values) -> str:
    """A list of words as SQL literals."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)

"""Structured Streaming (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt import lexicon as lx
from forecourt.catalog import query
from forecourt.catalog.rule_queries import ENRICHED_SQL, ISSUES, rounded_scores
from forecourt.catalog.source_queries import as_reviews
from forecourt.catalog.tables import read
from forecourt.plans.enrich import export_tags
from forecourt.session import work_dir
from forecourt.streaming import ingest


def table_stream(spark, d, name):
    schema = read(spark, d, name).schema
    return ingest.read_table_stream(spark, d, schema, f"{name}.parquet")


@query("x01_ingest", """
SELECT CAST(doc_id AS VARCHAR) AS review_id, source AS station_name, md5(text) AS text_md5
FROM documents""")
def x01(spark, d):
    """Documents as JSON lines, then read as a stream."""
    path = work_dir(spark, "x01")
    as_reviews(spark, d).write.json(path)
    rows = ingest.read_review_stream(spark, path, layout="line")
    rows = rows.select("review_id", "station_name", F.md5("text").alias("text_md5"))
    return ingest.run_available(rows, "x01")


@query("x02_dedupe", """
SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def x02(spark, d):
    """Line items and bit-identical copies of half of them, in about three batches of files."""
    path, keys = work_dir(spark, "x02"), ["l_orderkey", "l_linenumber"]
    li = read(spark, d, "lineitem")
    copies = li.unionByName(li.where("l_quantity > 25"))
    # Every task of the scan deals its rows over three files, so no file or task grows with the table.
    copies.withColumn("third", F.floor(F.rand(42) * 3).cast("int")).write.partitionBy("third").parquet(path)
    files = len(spark.read.schema(li.schema).parquet(path).inputFiles())
    rows = spark.readStream.schema(li.schema).option("maxFilesPerTrigger", max(1, -(-files // 3))).option(
        "pathGlobFilter", "*.parquet").parquet(path)
    return ingest.dedupe_into(rows, keys, "x02").select(*keys)


@query("x02_windowed_dedupe", """
SELECT event_id FROM events GROUP BY event_id""")
def x02b(spark, d):
    """Events twice in one batch: equal copies are reduced in several groups first."""
    events = table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = events.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(0)))).drop("copy")
    return ingest.run_available(ingest.dedupe_stream(twice, ["event_id"], "ts").select("event_id"), "x02b")


@query("x03_enrich", ENRICHED_SQL)
def x03(spark, d):
    docs = table_stream(spark, d, "documents").select("doc_id", "text")
    rows = export_tags(ingest.enrich_stream(docs, lexicon=lx.Lexicon(issues=ISSUES))).drop("text")
    return rounded_scores(ingest.run_available(rows, "x03"))


@query("x04_windowed_counts", """
SELECT day AS window_start, day + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n
FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type FROM events)
WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)
GROUP BY day, event_type""")
def x04(spark, d):
    events = table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.run_available(ingest.windowed_counts(events, "ts", "event_type"), "x04")


_BATCHES = 3


@query("x04_late_rows", """
WITH span AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM events),
e AS (SELECT event_type, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN event_id % 10 = 0 THEN 2
  ELSE least(2, 3 * (epoch_us(ts) - a) // (b - a + 1)) END AS batch FROM events, span),
marks AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  - INTERVAL 1 DAY AS mark FROM e GROUP BY batch),
told AS (SELECT event_type, date_trunc('day', ts) AS day, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= mark, false) AS late
  FROM e JOIN marks USING (batch))
SELECT 'late' AS kind, NULL AS window_start, event_type, count(*) AS n FROM told WHERE late GROUP BY event_type
UNION ALL SELECT 'closed', CAST(day AS TIMESTAMP), event_type, count(*) FROM told
WHERE NOT late AND day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM e) GROUP BY day, event_type""")
def x04_late(spark, d):
    """Events in three batches by time, a tenth of them held back to the last: late rows have a table of their own."""
    events = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    a, b = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    third = F.least(F.lit(2), F.floor((F.unix_micros("ts") - a) * _BATCHES / (b - a + 1)))
    events = events.withColumn("batch", F.when(F.col("event_id") % 10 == 0, 2).otherwise(third))
    path, out, checkpoint = (work_dir(spark, f"x04-{n}") for n in ("in", "out", "checkpoint"))
    for k in range(_BATCHES):
        events.where(F.col("batch") == k).drop("batch").write.mode("append").parquet(path)
        stream = ingest.read_table_stream(spark, path, events.drop("batch").schema)
        closed, late = ingest.windowed_counts_and_late(stream, "ts", "event_type", "x04", output=out, checkpoint=checkpoint)
    lost = late.groupBy("event_type").agg(F.count("*").alias("n")).select(
        F.lit("late").alias("kind"), F.lit(None).cast("timestamp").alias("window_start"), "event_type", "n")
    return lost.unionByName(closed.select(F.lit("closed").alias("kind"), "window_start", "event_type", "n"))

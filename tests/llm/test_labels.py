"""Labelled training rows."""

from zlib import crc32

from pyspark.sql import functions as F

from forecourt.llm.labels import labelled


def trains(i):
    return crc32(str(i).encode()) % 3 != 1


def test_every_label_is_learned_from_however_many_there_are(spark):
    n = 320_000
    docs = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")).where(F.col("doc_id") < n)
    rows = labelled(docs, labels, "toxic", "text").agg(
        F.count("*").alias("n"), F.sum("label").alias("toxic"), F.sum(F.col("text").cast("long")).alias("ids")).first()
    known = [i for i in range(n) if trains(i)]
    assert len(known) > 200_000
    assert tuple(rows) == (len(known), sum(i % 2 for i in known), sum(known))


def test_repeated_and_null_ids_and_ids_of_another_type(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in [*range(40), 2, 2, None]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(2, 1), (None, 1), (31, None)], "doc_id int, toxic int")
    want = sorted((f"t{i}", int(i % 2 or i == 2), crc32(str(i).encode()) % 3) for i in [*range(30), 2, 2] if trains(i))
    for known in (labels, labels.withColumn("doc_id", F.col("doc_id").cast("long"))):
        assert sorted(map(tuple, labelled(docs, known, "toxic", "text").collect())) == want


def test_few_labels_meet_the_texts_as_many_do(spark):
    """The join is the same at any size, so what it writes grows with the input."""
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    rows = labelled(docs, labels, "toxic", "text")
    want = sorted((f"t{i}", i % 2, crc32(str(i).encode()) % 3) for i in range(30) if trains(i))
    assert sorted(map(tuple, rows.collect())) == want
    assert "strategy=merge" in rows._jdf.queryExecution().optimizedPlan().toString()

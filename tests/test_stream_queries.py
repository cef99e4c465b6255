"""The registered stream queries on rows of their own."""

from pyspark.sql import functions as F

from forecourt.catalog import stream_queries

LINES = "l_orderkey long, l_linenumber int, l_quantity double"


def run(spark, monkeypatch, tmp_path, rows):
    """The keys found, their number, and the rows of each staged file."""
    rows.write.parquet(str(tmp_path / "in" / "lineitem.parquet"))
    monkeypatch.setattr(stream_queries, "work_dir", lambda _, name: str(tmp_path / name))
    found = stream_queries.x02(spark, str(tmp_path / "in"))
    staged = spark.read.schema(LINES).parquet(str(tmp_path / "x02")).groupBy(F.input_file_name()).count().collect()
    return sorted((tuple(r) for r in found.collect()), key=str), [r["count"] for r in staged]


def test_more_files_are_staged_for_a_larger_table(spark, monkeypatch, tmp_path):
    rows = spark.range(6000).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") % 50).cast("double").alias("l_quantity"))
    monkeypatch.setitem(stream_queries.__dict__, "read", lambda s, d, name: s.read.parquet(f"{d}/{name}.parquet").repartition(12))
    found, staged = run(spark, monkeypatch, tmp_path, rows)
    assert found == sorted(((i, 1) for i in range(6000)), key=str)
    # Half of the rows come twice; thirds of them would be files of 2,900 rows.
    assert sum(staged) == 6000 + 6000 * 24 // 50 and max(staged) < 1000


def test_null_keys_and_an_empty_table(spark, monkeypatch, tmp_path):
    rows = spark.createDataFrame([(1, 1, 30.0), (1, 1, 30.0), (None, None, 40.0), (2, 1, None)], LINES)
    rows = rows.coalesce(1)
    assert run(spark, monkeypatch, tmp_path / "some", rows)[0] == [(1, 1), (2, 1), (None, None)]
    monkeypatch.undo()
    assert run(spark, monkeypatch, tmp_path / "none", rows.where("false")) == ([], [])

"""Scans, sinks, identity and header resolution on small invented files."""

import json

import pytest
from pyspark.sql import functions as F

from forecourt import lexicon as lx
from forecourt.functions import rules
from forecourt.plans import enrich as en
from forecourt.session import work_dir
from forecourt.sources import pages, reviews, tabular


def review(i, **given):
    row = {f.name: None for f in reviews.REVIEW_SCHEMA.fields}
    row.update(review_id=f"r{i}", station_name="S", text=f"text {i}", rating=4.0, zone="z")
    row.update(given)
    return row


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "002_b.json").write_text(json.dumps([review(1, text="later copy"), review(3)]))
    (tmp_path / "001_a.json").write_text(json.dumps(
        [review(1, text="first\ncopy ★"), review(1, text="second copy"), review(2, rating=float("nan"))]))
    (tmp_path / "003_c.json").write_text("[]")
    (tmp_path / "notes.txt").write_text("ignored")
    return str(tmp_path)


def test_scan_and_keep_first(spark, folder):
    rows = reviews.read_review_json(spark, folder)
    assert rows.count() == 5
    once = reviews.keep_first(rows, ["review_id"], [F.col("file"), F.col("pos")])
    got = {r["review_id"]: r for r in once.collect()}
    assert set(got) == {"r1", "r2", "r3"}
    assert got["r1"]["text"] == "first\ncopy ★"
    assert got["r2"]["rating"] is None


def test_keep_first_ignores_partitioning(spark, folder):
    rows = reviews.read_review_json(spark, folder)
    order = [F.col("file"), F.col("pos")]
    a = reviews.keep_first(rows.repartition(7), ["review_id"], order)
    b = reviews.keep_first(rows.coalesce(1), ["review_id"], order)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    again = reviews.keep_first(a, ["review_id"], order)
    assert sorted(map(str, again.collect())) == sorted(map(str, a.collect()))


def test_broken_documents_are_set_aside(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"review_id": ')
    (tmp_path / "y.json").write_text(json.dumps([review(1)]))
    assert [r["review_id"] for r in reviews.read_review_json(spark, str(tmp_path)).collect()] == ["r1"]
    bad = reviews.rejects(spark, str(tmp_path)).collect()
    assert [(r["file"].rsplit("/", 1)[-1], r["record"]) for r in bad] == [("x.json", '[{"review_id": ')]


def test_a_hot_station_is_read_by_several_tasks(spark, tmp_path):
    lines = "\n".join(json.dumps(review(i, station_name="hot")) for i in range(4000))
    (tmp_path / "hot.json").write_text(lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        rows = reviews.read_review_json(spark, str(tmp_path), layout="line")
        tasks = {r[0] for r in rows.select(F.spark_partition_id()).distinct().collect()}
        assert rows.count() == 4000 and len(tasks) > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_record_ids_of_the_shipped_layout(spark):
    """The id is the md5 of name, coordinates in shortest form, author and text."""
    import hashlib
    points = [(19.076, 72.877), (19.0, 72.5), (-0.00001, 1e16), (123456789.125, 0.001), (None, 1e7)]
    rows = [("Pump", a, b, "A. B.", "ok") for a, b in points]
    df = spark.createDataFrame(rows, "n string, lat double, lng double, a string, t string")
    got = [r[0] for r in df.select(rules.record_id(*map(F.col, df.columns))).collect()]
    assert got == [hashlib.md5("|".join(map(str, r)).encode()).hexdigest() for r in rows]


def test_a_page_of_301_blocks(spark):
    html = "".join(f"<article><p>text {i}</p></article>" for i in range(301))
    page_rules = pages.PageRules((pages.Select("article"),), text=(pages.Select("p"),))
    df = spark.createDataFrame([(1, html)], "id int, html string")
    assert pages.extract_records(df, "html", ["id"], page_rules).count() == 301


def test_line_layout(spark, tmp_path):
    (tmp_path / "part").write_text("\n".join(json.dumps([review(i), review(i + 10)]) for i in range(5)))
    rows = reviews.read_review_json(spark, str(tmp_path), layout="line")
    assert rows.count() == 10 and rows.select("file", "pos").distinct().count() == 10
    with pytest.raises(ValueError):
        reviews.read_review_json(spark, str(tmp_path), layout="block")


def test_merge_passes(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "id string, n int")
    b = spark.createDataFrame([("x", 4), ("z", 6), ("z", 5)], "id string, n int")
    out = reviews.merge_passes(a, b, ["id"], [F.col("n")])
    assert sorted(map(tuple, out.collect())) == [("x", 1), ("x", 2), ("y", 3), ("z", 5)]


def test_csv_round_trip(spark):
    rows = [("a\nb", 'say "hi", ok', 1.5), (None, "", None), ("c\r\ne", " d ", float("nan"))]
    df = spark.createDataFrame(rows, "t string, u string, v double")
    path = work_dir(spark, "csv")
    tabular.write_csv(df, path)
    got = sorted(map(tuple, tabular.read_csv(spark, path, df.schema, multi_line=True).collect()), key=str)
    assert got == sorted([("a\nb", 'say "hi", ok', 1.5), (None, None, None), ("c\r\ne", " d ", None)], key=str)


def test_station_json_round_trip(spark):
    df = spark.createDataFrame([("a", "k1"), ("b", "k1"), ("c", "k2")], "t string, station_key string")
    path = work_dir(spark, "json")
    reviews.write_station_json(df, path)
    assert sorted(map(tuple, reviews.read_station_json(spark, path, df.schema).collect())) == sorted(
        map(tuple, df.collect()))


def test_headers():
    got = tabular.resolve_headers([" Stars ", "TEXT", "Review_Text_Final", "x"], lx.REVIEW_COLUMNS)
    assert got == {"Review_Text_Final": "_review_text", " Stars ": "_rating"}
    assert tabular.has_review_text(["Comment "]) and not tabular.has_review_text(["title", "rating"])


def test_normalize_stations(spark):
    df = spark.createDataFrame(
        [("HP", "4.1", None, "19.0", "72.9", "Compressed gas"), ("B", "bad", "0", "x", "72.9", None)],
        "Name string, Rating string, numReviews string, latitude string, lon string, category string")
    a, b = tabular.normalize_stations(df).orderBy(F.desc("_title")).collect()
    assert (a["sentiment"], a["zone"], a["fuel_type"], a["_review_count"]) == (
        "Positive", "Central Mumbai", "CNG", 1.0)
    assert (b["sentiment"], b["zone"], b["fuel_type"], b["_review_count"]) == (
        "Unknown", "Unknown", "Petrol / Diesel", 1.0)


def test_normalize_reviews(spark):
    df = spark.createDataFrame([("fine", "2026-01-02T03:04:05+02:00"), ("x", "soon")],
                               "Body string, Publishat string")
    out, back = tabular.normalize_reviews(df)
    got = [str(r["_date"]) for r in out.orderBy("_review_text").collect()]
    assert got == ["2026-01-02 01:04:05", "None"]
    assert back == {"_review_text": "Body", "_date": "Publishat"}


def test_station_defaults(spark):
    sheet = spark.createDataFrame([(1, "Compressed natural gas"), (2, None)], "idx int, categoryName string")
    rows = reviews.tag_stations(reviews.station_defaults(sheet)).orderBy("idx").collect()
    assert rows[0]["title"] == "Station_1" and rows[0]["category"] == "CNG Station"
    assert (rows[1]["lat"], rows[1]["lng"], rows[1]["review_count"]) == (19.076, 72.877, 0.0)
    assert rows[1]["station_key"] == "002_station_2" and rows[1]["zone"] == "Western Suburbs"


PAGE = """
<div class="x" data-review-id="1"><div class="d4r55 q">Ann &amp; Bo</div>
<span role="img" aria-label="4.5 stars"></span><span class="rsqaWe">2 months ago</span>
<span class="wiI7pd">Good <b>pump</b></span></div>
<div data-review-id="2"><span class="wiI7pd"> </span><span class="review-full-text">Second choice</span></div>
<div data-review-id="3"><span aria-label="1 star"></span></div>
"""


def test_page_records(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>no reviews</p>"), (3, None)], "id int, html string")
    rows = pages.extract_records(df, "html", ["id"]).orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [
        (1, 0, "Ann & Bo", 4.5, "Good pump", "2 months ago"), (1, 1, "", None, "Second choice", "")]
    assert pages.extract_records(df, "html", ["id"], cap=1).count() == 1


def test_enrich_and_refresh(spark):
    raw = spark.createDataFrame(
        [("a", "Ann", "rude staff, terrible and slow"), ("b", "Bo", "good clean helpful"),
         ("c", "Cy", "  "), ("d", "Di", "good best excellent but no CNG")],
        "review_id string, author_name string, text string")
    out = {r["review_id"]: r for r in en.enrich(raw).collect()}
    assert set(out) == {"a", "b", "d"}
    assert [out[k]["sentiment"] for k in "abd"] == ["Negative", "Positive", "Negative"]
    assert out["d"]["bert_star"] == 2 and out["a"]["issue_category"] == "Staff Behaviour"
    assert out["a"]["author_name"] != "Ann" and len(out["a"]["author_name"]) == 64
    assert "author_name" not in en.enrich(raw, author="drop").columns
    known = en.enrich(raw.where("review_id = 'a'")).withColumn("quality_score", F.lit(-1))
    both = {r["review_id"]: r["quality_score"] for r in en.refresh(raw, known).collect()}
    assert set(both) == {"a", "b", "d"} and both["a"] == -1
    path = work_dir(spark, "enriched")
    en.enrich(raw.where("review_id = 'a'")).withColumn("zone", F.lit("z")).write.partitionBy("zone").parquet(path)
    for _ in range(2):  # the second run finds nothing new
        en.append_new(spark, raw.withColumn("zone", F.lit("y")), path)
    assert sorted(r["review_id"] for r in spark.read.parquet(path).collect()) == ["a", "b", "d"]

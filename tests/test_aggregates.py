"""Aggregates against plain Python on a small fact table with a hot group."""

import math
import random

import pytest
from pyspark.sql import functions as F

from forecourt.operators import aggregates as ag
from forecourt.operators import filters, joins, quality, ranking
from forecourt.plans.overview import overview

COLUMNS = ("key long, station_name string, brand string, zone string, category string, "
           "sentiment string, issue_category string, bert_star int, station_rating double, "
           "station_reviews double, confidence double")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(600):
        station = "hot" if i % 3 == 0 else f"s{rng.randrange(12)}"
        out.append((
            i, station, rng.choice(["A", "B", "C", None]), rng.choice(["N", "S"]),
            rng.choice(["c", "p"]), rng.choice(["Positive", "Neutral", "Negative"]),
            rng.choice(["q", "r", "Other"]), rng.randrange(1, 6),
            rng.choice([3.0, 4.0, None]), float(rng.randrange(0, 90)), rng.random()))
    return out


@pytest.fixture(scope="module")
def fact(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(8).cache()


def test_urgency(fact, rows):
    got = {r["station"]: r for r in ag.urgency(fact, F.col("key")).collect()}
    stations = {}
    for r in sorted(rows):
        stations.setdefault(r[1], []).append(r)
    assert set(got) == set(stations)
    for name, group in stations.items():
        first = group[0]
        neg = sum(r[5] == "Negative" for r in group) / len(group) * 100
        rated = [r[8] for r in group if r[8] is not None]
        count = max(1.0, first[9])
        score = neg * math.log1p(count) * max(0, 5 - sum(rated) / len(rated))
        g = got[name]
        assert (g["zone"], g["brand"], g["google_reviews"], g["nlp_reviews"]) == (
            first[3], first[2], int(count), len(group))
        assert g["urgency_score"] == pytest.approx(score, abs=0.051)


def test_urgency_without_ratings(spark):
    df = spark.createDataFrame([(1, "s", "Negative", None)],
                               "key int, station_name string, sentiment string, station_rating double")
    r = ag.urgency(df, F.col("key")).first()
    assert r["urgency_score"] == 0.0 and r["google_reviews"] == 10 and r["zone"] == "—"
    r = ag.urgency(df.drop("station_rating"), F.col("key")).first()
    assert r["avg_rating"] == 3.5 and r["urgency_score"] == round(100 * math.log1p(10) * 1.5, 1)


def test_counts_agree(fact):
    total = fact.count()
    values = {r["sentiment"]: r["n"] for r in ag.value_counts(fact, "sentiment").collect()}
    assert sum(values.values()) == total
    cross = ag.cross_counts(fact, "issue_category", "sentiment").groupBy("sentiment").agg(
        F.sum("n").alias("n")).collect()
    assert {r["sentiment"]: r["n"] for r in cross} == values
    share = sum(r["share_pct"] for r in ag.value_counts(fact, "issue_category").collect())
    assert share == pytest.approx(100, abs=0.2)


def test_overview_matches_single_views(fact):
    out = overview(fact).collect()
    assert [r["n"] for r in out if r["view"] == "total"] == [fact.count()]
    one = {(r["zone"], r["sentiment"]): r["n"] for r in out if r["view"] == "zone+sentiment"}
    assert one == {(r["zone"], r["sentiment"]): r["n"]
                   for r in ag.cross_counts(fact, "zone", "sentiment").collect()}


def test_partitioning_does_not_matter(fact):
    for make in (lambda d: ag.brand_scorecard(d), lambda d: ag.kpi(d),
                 lambda d: ag.urgency(d, F.col("key")), lambda d: ag.station_detail(d, F.col("key"))):
        def clean(df):
            return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())
        assert clean(make(fact.coalesce(1))) == clean(make(fact.repartition(8)))


def test_scorecard_order(fact):
    got = [(-r["positive_pct"], r["brand"]) for r in ag.brand_scorecard(fact).collect()]
    assert got == sorted(got) and len(got) == 3


def test_best_and_worst(spark):
    t = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 1.0), ("d", 1.0)], "n string, s double")
    r = ag.best_and_worst(t, "n", "s").first()
    assert (r["best"], r["worst"], r["gap"]) == ("a", "d", 1.0)


def test_station_count(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (1.0, 2.0, "b"), (None, 2.0, "c")],
                               "lat double, lng double, station_name string")
    assert ag.station_count(df).first()[0] == 1
    assert ag.station_count(df.drop("lat")).first()[0] == 3
    assert ag.station_count(df, approximate=True).first()[0] == 1


def test_histogram(spark):
    df = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (100.0,), (None,), (101.0,)], "v double")
    got = {r["bin"]: r["n"] for r in ag.histogram(df, "v", 0.0, 100.0, 10).collect()}
    assert got == {0: 2, 1: 1, 9: 1}


def test_pivot(fact):
    got = ag.pivot_counts(fact, "zone", "issue_category", ["q", "absent"]).collect()
    assert len(got) == 2 and all(r["absent"] == 0 and r["q"] > 0 for r in got)


def test_most_negative_and_ranks(fact, rows):
    neg = {}
    for r in rows:
        if r[5] == "Negative":
            neg[r[6]] = neg.get(r[6], 0) + 1
    top = ag.most_negative(fact, "issue_category").first()
    assert (top["issue_category"], top["negatives"]) == min(neg.items(), key=lambda x: (-x[1], x[0]))
    ranked = ranking.top_ranked(ag.urgency(fact, F.col("key")), "urgency_score", "station", 5).collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3, 4, 5]


def test_filters(fact, rows):
    got = filters.facets(fact, {"brand": ["A", "B"], "zone": ["N"], "nowhere": [1]})
    assert got.count() == sum(r[2] in ("A", "B") and r[3] == "N" for r in rows)
    assert [r[0] for r in filters.facet_values(fact, "brand").collect()] == ["A", "B", "C"]


def test_date_range(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-03 00:00:00",),
                                ("2024-01-03 23:00:00",), ("2024-01-04 00:00:00",)], "t string")
    df = df.select(F.col("t").cast("timestamp").alias("t"))
    assert filters.date_range(df, "t", "2024-01-01", "2024-01-03").count() == 2
    assert filters.date_range(df, "t", "2024-01-01", "2024-01-03", inclusive_day=True).count() == 3


def test_lookup_and_spine(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    assert [r[0] for r in df.select(joins.lookup(F.col("k"), {"a": "1"}, "?")).collect()] == ["1", "?", "?"]
    counts = spark.createDataFrame([("x", "2024-01-01", 3), ("y", "2024-03-01", 1)],
                                   "g string, m string, n long")
    counts = counts.withColumn("m", F.to_date("m"))
    months = counts.select("m").distinct().agg(F.collect_list("m")).scalar()
    got = {(r["g"], str(r["m"])): r["n"] for r in joins.fill_spine(counts, months, "g", "m").collect()}
    assert got == {("x", "2024-01-01"): 3, ("x", "2024-03-01"): 0,
                   ("y", "2024-01-01"): 0, ("y", "2024-03-01"): 1}


def test_audit_sample(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "big").otherwise(
        F.concat(F.lit("b"), F.col("id") % 5)).alias("brand"))
    a = quality.audit_sample(df.repartition(7), "id", "brand")
    b = quality.audit_sample(df.coalesce(1), "id", "brand")
    assert sorted(a.collect()) == sorted(b.collect())
    sizes = {r["brand"]: r["count"] for r in a.groupBy("brand").count().collect()}
    assert sum(sizes.values()) == 30 and set(sizes.values()) == {5}
    c = quality.audit_sample(df, "id", "brand", seed=7)
    assert sorted(c.collect()) != sorted(a.collect())
    few = df.where("id > 995")
    assert quality.audit_sample(few, "id", "brand").count() == 4


def test_quality_flags(spark):
    df = spark.createDataFrame([(18.9, 72.8), (18.8, 72.8), (None, 72.8)], "lat double, lng double")
    ok, bad = quality.split_by_bounds(df)
    assert ok.count() == 1 and bad.count() == 2


def test_urgency_plan_has_no_full_sort(fact):
    """The first step over the reviews is a hash aggregation."""
    plan = ag.urgency(fact, F.col("key"))._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    deepest = [x for x in lines if "Aggregate(" in x][-1]
    assert "HashAggregate" in deepest


def test_first_row_is_pruned_before_the_shuffle(spark, sf):
    from forecourt.sources.reviews import keep_first
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    plan = keep_first(li, ["l_orderkey"], [F.col("l_linenumber")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2

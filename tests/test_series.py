"""Monthly series and forecasts."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from forecourt.operators import forecast as fc
from forecourt.operators import series as ts


def simulate(n, phi, theta, seed):
    rng = np.random.default_rng(seed)
    e, w = rng.normal(size=n), np.zeros(n)
    for t in range(1, n):
        w[t] = phi * w[t - 1] + e[t] + theta * e[t - 1]
    return np.cumsum(w)


def in_rows(spark, *series):
    rows = [(f"s{k}", m, float(v)) for k, y in enumerate(series) for m, v in zip(months(len(y)), y, strict=True)]
    return spark.createDataFrame(rows, "series_id string, month date, value double")


def test_coefficients_are_recovered(spark):
    truth = [(0.6, 0.3), (-0.5, -0.3), (0.2, -0.4), (0.5, 0.0)]
    df = in_rows(spark, *[simulate(1500, phi, theta, 4) for phi, theta in truth])
    got = {r["series_id"]: r for r in fc.fit(df).collect()}
    for k, (phi, theta) in enumerate(truth):
        r = got[f"s{k}"]
        assert (r["phi"], r["theta"]) == pytest.approx((phi, theta), abs=0.25)
        assert r["variance"] == pytest.approx(1, abs=0.12)


def test_interval_coverage(spark):
    data = [simulate(121, 0.5, 0.2, seed) for seed in range(150)]
    out = fc.forecast(in_rows(spark, *[y[:120] for y in data]), steps=1).collect()
    hits = sum(r["lower"] <= data[int(r["series_id"][1:])][120] <= r["upper"] for r in out)
    assert len(out) == 150 and 0.70 <= hits / 150 <= 0.90


def test_seasonal_pattern_is_followed(spark):
    t = np.arange(96)
    y = 100 + 20 * np.sin(2 * np.pi * t / 12) + np.random.default_rng(0).normal(scale=0.5, size=96)
    out = fc.forecast(in_rows(spark, y[:84], y[:13]), 12, seasonal=True).collect()
    mean = {r["step"]: r["mean"] for r in out if r["series_id"] == "s0"}
    assert max(abs(mean[h] - y[83 + h]) for h in range(1, 13)) < 6
    short = [r for r in out if r["series_id"] == "s1"]
    assert len(short) == 12 and {r["reason"] for r in short} == {fc.TOO_SHORT}
    with pytest.raises(ValueError):
        fc.forecast(in_rows(spark, y), 13, seasonal=True)


def months(n, start=1900):
    return [dt.date(start + i // 12, i % 12 + 1, 1) for i in range(n)]


def test_forecast_many_series(spark):
    rows = [(f"s{k}", m, float(k + i)) for k in range(20) for i, m in enumerate(months(30))]
    rows += [("short", m, 1.0) for m in months(5)]
    df = spark.createDataFrame(rows, "series_id string, month date, value double")
    out = fc.forecast(df, steps=3)
    assert out.count() == 63
    assert {(r["mean"], r["reason"]) for r in out.where("series_id = 'short'").collect()} == {
        (None, fc.TOO_SHORT)}
    r = out.where("series_id = 's1' and step = 1").first()
    assert r["month"] == dt.date(1902, 7, 1) and r["mean"] == pytest.approx(31, abs=1.5)
    assert {t["trend"] for t in fc.trend_direction(out).collect()} == {"rising", None}
    table = fc.forecast_table(out).where("series_id = 's1' and step = 1").first()
    assert table["month"] == "Jul 1902"


def test_fill_gaps(spark):
    kept = [m for i, m in enumerate(months(24)) if i not in (5, 6)]
    df = spark.createDataFrame([("s", m, 10.0) for m in kept], "series_id string, month date, value double")
    assert fc.forecast(df, steps=1).first()["mean"] == pytest.approx(10.0)
    full = {r["month"]: r["value"] for r in fc.without_gaps(df).collect()}
    assert len(full) == 24 and [m for m, v in full.items() if v == 0] == [m for m in months(24) if m not in kept]
    assert fc.forecast(df, steps=1, fill_gaps=True).first()["reason"] is None


@pytest.fixture
def dated(spark):
    rows = []
    for i, m in enumerate(months(8)):
        for j in range(i + 1):
            rows.append((m, "Negative" if j % 2 else "Positive", f"issue{j % 6}"))
    return spark.createDataFrame(rows, "month date, sentiment string, issue_category string")


def test_network_series(dated):
    got = {(r["series_id"], r["month"]): r["value"] for r in ts.network_series(dated).collect()}
    assert len(got) == 24
    assert got[("negative_count", dt.date(1900, 1, 1))] == 0.0
    assert got[("negative_rate", dt.date(1900, 4, 1))] == 50.0


def test_issue_series_reads_the_reviews_once(dated):
    """The months come from the shuffle of the counts, not from the reviews again."""
    got = ts.issue_series(dated, by=["issue_category"])
    got.collect()
    plan = got._jdf.queryExecution().executedPlan()
    assert "ReusedExchange" in plan.toString()


def test_issue_series_is_zero_filled(dated):
    got = ts.issue_series(dated, k=2).collect()
    assert {r["series_id"] for r in got} == {"issue1", "issue3"} and len(got) == 16
    first = [r["value"] for r in got if r["series_id"] == "issue1" and r["month"] == dt.date(1900, 1, 1)]
    assert first == [0.0]
    assert ts.issue_series(dated, by=["issue_category"]).select("series_id").distinct().count() == 3


def test_guards(dated):
    series = ts.network_series(dated)
    assert ts.long_enough(series, 8).count() == 24 and ts.long_enough(series, 9).count() == 0
    d = dated.withColumn("_date", F.col("month").cast("timestamp"))
    assert ts.dated_trend(d, "quarter").count() > 0
    assert ts.dated_trend(d, "quarter", minimum=37).count() == 0


def test_with_month_drops_undated(spark):
    df = spark.createDataFrame([("2 months ago",), ("2 days ago",), (None,)], "date_relative string")
    assert [r["month"] for r in ts.with_month(df).collect()] == [dt.date(2026, 4, 1)]


def plain_errors(w, weights, m=0):
    """The errors by their definition, month after month."""
    phi, theta, s_phi, s_theta = (*weights, 0, 0)[:4]
    e = []

    def at(x, t):
        return x[t] if t >= 0 else 0.0
    for t in range(len(w)):
        value = w[t] - phi * at(w, t - 1) - theta * at(e, t - 1)
        if m:
            value += (-s_phi * at(w, t - m) + phi * s_phi * at(w, t - m - 1)
                      - s_theta * at(e, t - m) - theta * s_theta * at(e, t - m - 1))
        e.append(value)
    return np.array(e)


def seasonal_series(n, weights, seed, m=12):
    """A series whose errors are known: the model's own recursion, summed twice."""
    phi, theta, s_phi, s_theta = weights
    rng = np.random.default_rng(seed)
    n += 200
    e, w = rng.normal(size=n), np.zeros(n)
    for t in range(m + 1, n):
        w[t] = (phi * w[t - 1] + s_phi * w[t - m] - phi * s_phi * w[t - m - 1]
                + e[t] + theta * e[t - 1] + s_theta * e[t - m] + theta * s_theta * e[t - m - 1])
    y = np.cumsum(w)
    for t in range(m, n):
        y[t] += y[t - m]
    return y[200:]


@pytest.mark.parametrize("m", [0, 12, 4])
def test_errors_and_slopes_follow_their_definition(m):
    rng = np.random.default_rng(m)
    w = rng.normal(size=(5, 40))
    p = rng.uniform(-0.9, 0.9, size=(5, 4 if m else 2))
    model = fc.Differences(w, m)
    e = model.errors(p)
    for row in range(5):
        assert e[row] == pytest.approx(plain_errors(w[row], p[row], m))
    slopes = model.slopes(e, p)
    for i in range(p.shape[1]):
        up, down = p.copy(), p.copy()
        up[:, i] += 1e-6
        down[:, i] -= 1e-6
        assert slopes[i] == pytest.approx((model.errors(up) - model.errors(down)) / 2e-6, abs=1e-5)


@pytest.mark.parametrize("m", [0, 12])
def test_no_other_weights_fit_better(m):
    """Against a grid of all weights, with the errors counted month by month."""
    truth = (0.5, -0.3, 0.3, -0.4) if m else (0.5, -0.3)
    data = np.stack([seasonal_series(60, truth, s) if m else simulate(60, *truth, s) for s in range(4)])
    w = fc.differences(data, m)
    p, total = fc.Differences(w, m).fit()
    grid = np.linspace(-0.9, 0.9, 7 if m else 37)
    mesh = np.stack(np.meshgrid(*[grid] * len(truth)), -1).reshape(-1, len(truth))
    for row in range(len(data)):
        assert total[row] == pytest.approx((plain_errors(w[row], p[row], m) ** 2).sum())
        every = fc.Differences(np.repeat(w[row:row + 1], len(mesh), 0), m).errors(mesh)
        assert total[row] <= (every**2).sum(axis=1).min() * 1.01


def test_seasonal_weights_are_recovered(spark):
    truth = [(0.5, 0.3, 0.4, -0.5), (-0.4, 0.2, 0.2, 0.5), (0.3, -0.6, -0.5, -0.3)]
    df = in_rows(spark, *[seasonal_series(1500, p, 7) for p in truth])
    got = {r["series_id"]: r for r in fc.fit(df, seasonal=True).collect()}
    for k, p in enumerate(truth):
        r = got[f"s{k}"]
        assert (r["phi"], r["theta"], r["seasonal_phi"], r["seasonal_theta"]) == pytest.approx(p, abs=0.12)
        assert r["variance"] == pytest.approx(1, abs=0.12)


def test_plain_weights_are_recovered_closely(spark):
    truth = [(0.6, 0.3), (-0.5, -0.3), (0.2, -0.6), (0.7, -0.2)]
    got = {r["series_id"]: r for r in fc.fit(in_rows(spark, *[simulate(3000, *p, 4) for p in truth])).collect()}
    for k, p in enumerate(truth):
        assert (got[f"s{k}"]["phi"], got[f"s{k}"]["theta"]) == pytest.approx(p, abs=0.08)


@pytest.mark.parametrize("seasonal", [False, True])
def test_intervals_cover_four_of_five(spark, seasonal):
    ahead, count = 6, 400
    weights = (0.4, 0.2, 0.3, -0.4)
    data = [seasonal_series(150 + ahead, weights, s) if seasonal else simulate(150 + ahead, 0.5, 0.2, s)
            for s in range(count)]
    out = fc.forecast(in_rows(spark, *[y[:-ahead] for y in data]), ahead, seasonal).collect()
    hits = sum(r["lower"] <= data[int(r["series_id"][1:])][149 + r["step"]] <= r["upper"] for r in out)
    assert len(out) == count * ahead and 0.75 <= hits / len(out) <= 0.85


def test_seasonal_beats_plain_on_seasonal_data(spark):
    data = [seasonal_series(126, (0.3, 0.2, 0.3, -0.4), s) for s in range(60)]
    df = in_rows(spark, *[y[:120] for y in data])

    def off(seasonal):
        out = fc.forecast(df, 6, seasonal).collect()
        return np.mean([abs(r["mean"] - data[int(r["series_id"][1:])][119 + r["step"]]) for r in out])
    assert off(True) < 0.6 * off(False)


def test_lengths_constants_and_missing_values(spark):
    """Series of several lengths in one batch, constant and empty-looking ones, and reasons."""
    series = [np.arange(n) * 2.0 for n in (6, 7, 40)] + [np.zeros(30), np.full(30, 5.0), np.arange(5.0), [1.0, float("nan")] * 10]
    out = fc.forecast(in_rows(spark, *series), 3).collect()
    by = {(r["series_id"], r["step"]): r for r in out}
    assert len(out) == 21
    assert [by[f"s{k}", 3]["mean"] for k in (3, 4)] == pytest.approx([0, 5])
    assert by["s2", 1]["mean"] == pytest.approx(80, abs=0.5) and by["s0", 1]["reason"] is None
    assert by["s5", 1]["reason"] == fc.TOO_SHORT and by["s6", 2]["reason"] == fc.MISSING and by["s6", 2]["mean"] is None
    assert fc.forecast(in_rows(spark, np.arange(30.0)).limit(0), 3).collect() == []
    seasonal = fc.forecast(in_rows(spark, np.arange(17.0), np.arange(18.0)), 12, seasonal=True).collect()
    assert {(r["series_id"], r["reason"]) for r in seasonal} == {("s0", fc.TOO_SHORT), ("s1", None)}

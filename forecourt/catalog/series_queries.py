"""Time series (TS)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt import lexicon as lx
from forecourt.catalog import query
from forecourt.catalog.tables import REFERENCE, RF, read, review_fact
from forecourt.operators import forecast as fc
from forecourt.operators import series as ts

_DATED = RF + ", dated AS (SELECT * FROM rf WHERE l_quantity <> 1)"


def dated(spark, d, *fields):
    df = review_fact(spark, d, "date_relative", *fields)
    return ts.with_month(df, reference=REFERENCE).drop("date_relative")


@query("ts01_month", _DATED + "SELECT key, month FROM dated")
def ts01(spark, d):
    return dated(spark, d, "key")


@query("ts02_monthly_volume", _DATED + "SELECT month, count(*) AS n FROM dated GROUP BY month")
def ts02a(spark, d):
    return ts.monthly_volume(dated(spark, d))


@query("ts02_monthly_sentiment", _DATED + """
SELECT month, sentiment, count(*) AS n FROM dated GROUP BY month, sentiment""")
def ts02b(spark, d):
    return ts.monthly_sentiment(dated(spark, d, "sentiment"))


@query("ts02_monthly_negative_rate", _DATED + """
SELECT month, round(100.0 * count(*) FILTER (sentiment = 'Negative') / count(*), 4) AS negative_pct
FROM dated GROUP BY month""")
def ts02c(spark, d):
    out = ts.monthly_negative_rate(dated(spark, d, "sentiment"))
    return out.withColumn("negative_pct", F.round("negative_pct", 4))


@query("ts03_issue_trends", _DATED + """
SELECT month, issue_category, count(*) AS n FROM dated WHERE issue_category IN (
  SELECT issue_category FROM dated GROUP BY 1 ORDER BY count(*) DESC, issue_category LIMIT 5)
GROUP BY month, issue_category""")
def ts03(spark, d):
    return ts.top_issue_trends(dated(spark, d, "issue_category"))


_SERIES = """
, per AS (SELECT month, count(*) AS n, count(*) FILTER (sentiment = 'Negative') AS neg
  FROM dated GROUP BY month), long AS (
SELECT 'volume' AS series_id, month, CAST(n AS DOUBLE) AS value FROM per UNION ALL
SELECT 'negative_count', month, CAST(neg AS DOUBLE) FROM per UNION ALL
SELECT 'negative_rate', month, 100.0 * neg / n FROM per)
"""


@query("ts04_series", _DATED + _SERIES + "SELECT series_id, month, round(value, 4) AS value FROM long")
def ts04(spark, d):
    out = ts.network_series(dated(spark, d, "sentiment"))
    return out.withColumn("value", F.round("value", 4))


def _lag(x, by):
    return f"list_transform(range(1, len({x}) + 1), lambda i: CASE WHEN i > {by} THEN {x}[i - {by}] ELSE 0 END)"


def _filter(x, weight, by):
    """z with z[t] + weight * z[t - by] = x[t], written out as powers of the weight."""
    return (f"list_transform(range(1, len({x}) + 1), lambda t: list_sum(list_transform(range(0, (t - 1) // {by} + 1), "
            f"lambda j: pow(-{weight}, j) * {x}[t - j * {by}])))")


def _mix(*terms):
    """Sum of lists, each times a factor."""
    return f"list_transform(range(1, len({terms[0][1]}) + 1), lambda i: {' + '.join(f'({f}) * {x}[i]' for f, x in terms)})"


def _chain(source, *levels):
    """Columns added level by level, each from those before (as aliases beside each other they would be copied)."""
    for columns in levels:
        source = f"(SELECT *, {', '.join(columns)} FROM {source})"
    return source


def _errors_sql(source, seasonal):
    terms = [("1", "w"), ("-p1", "w1")] + ([("-p3", "wm"), ("p1 * p3", "wm1")] if seasonal else [])
    levels = [[f"{_mix(*terms)} AS u"], [f"{_filter('u', 'p2', 1)} AS {'v' if seasonal else 'e'}"]]
    return _chain(source, *levels, *([[f"{_filter('v', 'p4', 12)} AS e"]] if seasonal else []))


def _slopes_sql(source, seasonal):
    if not seasonal:
        return _chain(source, [f"{_lag('e', 1)} AS h2"], [f"{_filter('w1', 'p2', 1)} AS j1", f"{_filter('h2', 'p2', 1)} AS j2"])
    return _chain(
        source,
        [f"{_mix(('1', 'w1'), ('-p3', 'wm1'))} AS h1", f"{_lag('e', 1)} AS h2",
         f"{_mix(('1', 'wm'), ('-p1', 'wm1'))} AS h3", f"{_lag('e', 12)} AS h4"],
        [f"{_filter('h1', 'p2', 1)} AS k1", f"{_filter('h2', 'p2', 1)} AS j2",
         f"{_filter('h3', 'p2', 1)} AS k3", f"{_filter('h4', 'p4', 12)} AS j4"],
        [f"{_filter('k1', 'p4', 12)} AS j1", f"{_filter('k3', 'p4', 12)} AS j3"])


def _solve_sql(source, k):
    """Elimination for the unknowns x1 to xk."""
    own, a, b = range(1, k + 1), {}, {}
    for i in own:
        b[i] = f"g{i}"
        for j in own:
            a[i, j] = f"d{i}" if i == j else f"a{min(i, j)}{max(i, j)}"
    size = " + ".join(f"a{i}{i}" for i in own)
    levels = [[f"a{i}{i} * (1 + damping) + ({fc.RIDGE} * ({size}) + {fc.TINY}) AS d{i}" for i in own]]
    for i in own:
        below = [j for j in own if j > i]
        if below:
            levels.append([f"{a[j, i]} / {a[i, i]} AS f{i}{j}" for j in below])
            levels.append([f"{a[j, c]} - f{i}{j} * {a[i, c]} AS m{i}_{j}{c}" for j in below for c in below]
                          + [f"{b[j]} - f{i}{j} * {b[i]} AS b{i}_{j}" for j in below])
        for j in below:
            b[j] = f"b{i}_{j}"
            a |= {(j, c): f"m{i}_{j}{c}" for c in below}
    for i in reversed(own):
        rest = "".join(f" - {a[i, c]} * x{c}" for c in own if c > i)
        levels.append([f"({b[i]}{rest}) / {a[i, i]} AS x{i}"])
    return _chain(source, *levels)


def _fitted_sql(seasonal=False):
    """The damped steps over a relation long(series_id, month, value); st_{ROUNDS} holds the result."""
    k = 4 if seasonal else 2
    ps = range(1, k + 1)
    starts = [s + t for s in fc.STARTS for t in fc.SEASONAL_STARTS] if seasonal else fc.STARTS
    values = ", ".join(f"({i}, {', '.join(map(str, s))})" for i, s in enumerate(starts))
    lost = 13 if seasonal else 1
    keep = ["series_id", "n", "last", "y", "w", "w1", *(["wm", "wm1"] if seasonal else [])]
    sql = f"""
, ys AS (SELECT series_id, count(*) AS n, max(month) AS last, list(CAST(value AS DOUBLE) ORDER BY month) AS y
  FROM long GROUP BY series_id),
ds AS (SELECT *, list_transform(range(2, len(y) + 1), lambda i: y[i] - y[i - 1]) AS d FROM ys
  WHERE n >= 6 AND n - {lost} >= {k + 1}),
ws AS (SELECT series_id, n, last, y, {"list_transform(range(13, len(d) + 1), lambda i: d[i] - d[i - 12])" if seasonal else "d"} AS w
  FROM ds),
lags AS MATERIALIZED (SELECT *, {_lag("w", 1)} AS w1{f", {_lag('w', 12)} AS wm, {_lag('w', 13)} AS wm1" if seasonal else ""} FROM ws),
starts(i, {", ".join(f"p{j}" for j in ps)}) AS (VALUES {values}),
tried AS MATERIALIZED (SELECT *, list_inner_product(e, e) AS total FROM {_errors_sql("(SELECT * FROM lags, starts)", seasonal)}),
st_0 AS MATERIALIZED (SELECT {", ".join(keep)}, {", ".join(f"p{j}" for j in ps)}, total, {fc.DAMPING} AS damping FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY total, i) AS r FROM tried) WHERE r = 1)"""
    for r in range(fc.ROUNDS):
        products = [f"list_inner_product(j{i}, j{j}) AS a{i}{j}" for i in ps for j in ps if i <= j]
        products += [f"-list_inner_product(j{i}, e) AS g{i}" for i in ps]
        sql += f""",
er_{r} AS MATERIALIZED (SELECT * FROM {_errors_sql(f"st_{r}", seasonal)}),
pr_{r} AS MATERIALIZED (SELECT *, {", ".join(products)} FROM {_slopes_sql(f"er_{r}", seasonal)}),
mv_{r} AS MATERIALIZED (SELECT {", ".join(keep)}, {", ".join(f"p{j} AS o{j}" for j in ps)}, total, damping,
  {", ".join(f"greatest(-{fc.LIMIT}, least({fc.LIMIT}, p{j} - x{j})) AS p{j}" for j in ps)} FROM {_solve_sql(f"pr_{r}", k)}),
st_{r + 1} AS MATERIALIZED (SELECT {", ".join(keep)}, {", ".join(f"CASE WHEN better THEN p{j} ELSE o{j} END AS p{j}" for j in ps)},
  CASE WHEN better THEN after_ ELSE total END AS total, CASE WHEN better THEN damping / 10 ELSE damping * 10 END AS damping
  FROM (SELECT *, after_ < total * (1 - {fc.GAIN}) AS better FROM (
    SELECT *, list_inner_product(e, e) AS after_ FROM {_errors_sql(f"mv_{r}", seasonal)})))"""
    return sql


def _ahead_sql(seasonal, steps, source, out):
    """Lists y, w and e go on for some steps without errors."""
    def back(x, by):
        return f"CASE WHEN len({x}) >= {by} THEN {x}[len({x}) - {by - 1}] ELSE 0 END"
    sql, last = "", source
    for h in range(steps):
        nxt = f"p1 * {back('w', 1)} + p2 * {back('e', 1)}"
        level = back("y", 1)
        if seasonal:
            nxt += (f" + p3 * {back('w', 12)} - p1 * p3 * {back('w', 13)} + p4 * {back('e', 12)}"
                    f" + p2 * p4 * {back('e', 13)}")
            level += f" + {back('y', 12)} - {back('y', 13)}"
        sql += f""",
{out}_{h + 1} AS MATERIALIZED (SELECT * EXCLUDE (y, w, e, nw, ny), list_append(w, nw) AS w, list_append(e, 0) AS e, list_append(y, ny) AS y
  FROM {_chain(last, [f"{nxt} AS nw"], [f"nw + {level} AS ny"])})"""
        last = f"{out}_{h + 1}"
    return sql, last


def _forecast_sql(steps, seasonal=False):
    k, size = (4, 14) if seasonal else (2, 2)
    values, known = _ahead_sql(seasonal, steps, "fitted", "fo")
    adds, once = _ahead_sql(seasonal, steps - 1, "once", "im")
    single = f"list_concat(list_transform(range({size - 1}), lambda i: CAST(0 AS DOUBLE)), [CAST(1 AS DOUBLE)])"
    return _fitted_sql(seasonal) + f""",
fitted AS MATERIALIZED (SELECT * EXCLUDE (u{", v" if seasonal else ""}), total / greatest(len(w) - {k}, 1) AS variance
  FROM {_errors_sql(f"st_{fc.ROUNDS}", seasonal)}){values},
once AS MATERIALIZED (SELECT * EXCLUDE (y, w, e), {single} AS y, {single} AS w, {single} AS e FROM fitted){adds},
known AS MATERIALIZED (SELECT a.series_id, a.y, b.y AS adds, a.variance FROM {known} a JOIN {once} b USING (series_id)),
out AS (SELECT s.series_id, CAST(step AS INTEGER) AS step, CAST(last + to_months(CAST(step AS INTEGER)) AS DATE) AS month,
    CAST({lx.INTERVAL_Z_80!r} AS DOUBLE) * sqrt(variance * list_sum(list_transform(adds[{size}:{size - 1} + step], lambda v: v * v))) AS half,
    y[n + step] AS mean, mean - half AS lower, mean + half AS upper,
    CASE WHEN known.series_id IS NULL THEN 'too few months' END AS reason
  FROM (SELECT series_id, n, last, unnest(range(1, {steps} + 1)) AS step FROM ys) s LEFT JOIN known USING (series_id))
"""


_OUT = "SELECT series_id, step, month, round(mean, 3) AS mean, round(lower, 3) AS lower, round(upper, 3) AS upper, reason FROM out"


def rounded(df):
    return df.withColumns({c: F.round(c, 3) for c in ("mean", "lower", "upper")})


def _network_forecast(spark, d, **options):
    return fc.forecast(ts.network_series(dated(spark, d, "sentiment")), **options)


@query("ts05_forecast", _DATED + _SERIES + _forecast_sql(6) + _OUT)
def ts05(spark, d):
    return rounded(_network_forecast(spark, d, steps=6))


@query("ts05_seasonal_forecast", _DATED + _SERIES + _forecast_sql(6, True) + _OUT)
def ts05b(spark, d):
    return rounded(_network_forecast(spark, d, steps=6, seasonal=True))


_MANY = """
, m AS (SELECT DISTINCT month FROM dated),
ids AS (SELECT DISTINCT station_name || '|' || issue_category AS series_id FROM dated WHERE sentiment = 'Negative'),
neg AS (SELECT station_name || '|' || issue_category AS series_id, month, count(*) AS n FROM dated
  WHERE sentiment = 'Negative' GROUP BY 1, 2),
long AS (SELECT ids.series_id, m.month, CAST(coalesce(n, 0) AS DOUBLE) AS value
  FROM ids CROSS JOIN m LEFT JOIN neg ON neg.series_id = ids.series_id AND neg.month = m.month)
"""


@query("ts05_many_series_forecast", _DATED + _MANY + _forecast_sql(4) + _OUT)
def ts05c(spark, d):
    df = dated(spark, d, "sentiment", "station_name", "issue_category")
    return rounded(fc.forecast(ts.issue_series(df, by=["station_name", "issue_category"]), steps=4))


@query("ts05_short_series", """
WITH long AS (SELECT event_type AS series_id, CAST(date_trunc('month', ts) AS DATE) AS month,
  CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2)
""" + _forecast_sql(3) + _OUT)
def ts05d(spark, d):
    """Series too short for a forecast keep their rows, with the reason."""
    series = read(spark, d, "events").groupBy(
        F.col("event_type").alias("series_id"), F.trunc("ts", "month").alias("month")).agg(
        F.count("*").cast("double").alias("value"))
    return rounded(fc.forecast(series, steps=3))


@query("ts06_long_enough", """
WITH c AS (SELECT event_type || '|' || CAST(user_id AS VARCHAR) AS series_id,
  CAST(date_trunc('day', ts) AS DATE) AS month, count(*) AS n FROM events GROUP BY 1, 2)
SELECT series_id, month, CAST(n AS DOUBLE) AS value FROM c WHERE series_id IN (
  SELECT series_id FROM c GROUP BY series_id HAVING count(*) >= 6)""")
def ts06(spark, d):
    e = read(spark, d, "events")
    series = e.groupBy(
        F.concat_ws("|", "event_type", "user_id").alias("series_id"),
        F.to_date("ts").alias("month")).agg(F.count("*").cast("double").alias("value"))
    return ts.long_enough(series)


@query("ts07_forecast_table", _DATED + _SERIES + _forecast_sql(6) + """
SELECT series_id, step, strftime(month, '%b %Y') AS month, round(mean, 1) AS mean,
  round(lower, 1) AS lower, round(upper, 1) AS upper FROM out""")
def ts07(spark, d):
    return fc.forecast_table(_network_forecast(spark, d, steps=6))


@query("ts08_issue_series", _DATED + """
, worst AS (SELECT issue_category FROM dated WHERE sentiment = 'Negative' GROUP BY 1
  ORDER BY count(*) DESC, issue_category LIMIT 4),
m AS (SELECT DISTINCT month FROM dated)
SELECT w.issue_category AS series_id, m.month, CAST(count(dated.key) AS DOUBLE) AS value
FROM worst w CROSS JOIN m LEFT JOIN dated ON dated.issue_category = w.issue_category
  AND dated.month = m.month AND dated.sentiment = 'Negative' GROUP BY ALL""")
def ts08(spark, d):
    return ts.issue_series(dated(spark, d, "sentiment", "issue_category"))


@query("ts08_issue_forecast", _DATED + """
, worst AS (SELECT issue_category FROM dated WHERE sentiment = 'Negative' GROUP BY 1
  ORDER BY count(*) DESC, issue_category LIMIT 4),
m AS (SELECT DISTINCT month FROM dated),
long AS (SELECT w.issue_category AS series_id, m.month, CAST(count(dated.key) AS DOUBLE) AS value
FROM worst w CROSS JOIN m LEFT JOIN dated ON dated.issue_category = w.issue_category
  AND dated.month = m.month AND dated.sentiment = 'Negative' GROUP BY ALL)
""" + _forecast_sql(4) + _OUT)
def ts08b(spark, d):
    return rounded(fc.forecast(ts08(spark, d), steps=4))


@query("ts09_trend_direction", _DATED + _SERIES + _forecast_sql(6) + """
SELECT series_id, round(arg_min(mean, step), 3) AS first, round(arg_max(mean, step), 3) AS last,
  CASE WHEN arg_max(mean, step) > arg_min(mean, step) THEN 'rising' ELSE 'declining' END AS trend
FROM out GROUP BY series_id""")
def ts09(spark, d):
    out = fc.trend_direction(_network_forecast(spark, d, steps=6))
    return out.withColumns({c: F.round(c, 3) for c in ("first", "last")})


@query("ts10_dated_trend", " UNION ALL ".join(
    f"SELECT '{u}' AS unit, CAST(date_trunc('{u}', ts) AS DATE) AS period, event_type AS sentiment, "
    "count(*) AS n FROM events GROUP BY ALL" for u in ("month", "week", "quarter")))
def ts10(spark, d):
    e = read(spark, d, "events").select(
        F.col("ts").cast("timestamp").alias("_date"), F.col("event_type").alias("sentiment"))
    return ts.dated_trends(e, list(ts.UNITS.values()))

"""Forecasts of many series at once by iterated least squares.

The model is (1,1,1), or with the seasonal part (1,1,1) over m months: the differences of a
series follow their last value and the last error, and the value and error of the same month of
the year before.  Its two or four weights minimise the sum of squared errors (values and errors
before the first count as zero) by Gauss-Newton steps, damped so that no step raises the
sum.  One shuffle gathers each series as an array, as long as its months however many reviews are
behind it; a task fits a batch of series of one length as matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt import lexicon as lx
from forecourt.session import send_code

TOO_SHORT, MISSING = "too few months", "missing value"
STARTS = ((0.1, 0.1), (0.6, -0.3), (-0.5, 0.3), (0.3, -0.8), (-0.3, 0.8))
SEASONAL_STARTS = ((0.1, -0.5), (0.3, 0.1))
ROUNDS, LIMIT, DAMPING, GAIN, RIDGE, TINY = 12, 0.99, 0.01, 1e-9, 1e-10, 1e-30


def without_gaps(series: DataFrame) -> DataFrame:
    """Every month between the first and the last of each series, zero where it has none."""
    months = series.groupBy("series_id").agg(F.explode(F.sequence(
        F.min("month"), F.max("month"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return months.join(series, ["series_id", "month"], "left").withColumn(
        "value", F.coalesce("value", F.lit(0.0)))


def lagged(x: np.ndarray, by: int) -> np.ndarray:
    """Each row moved on by some places, zeros in front."""
    out = np.zeros_like(x)
    out[:, by:] = x[:, :-by]
    return out


def filtered(x: np.ndarray, weight: np.ndarray, by: int) -> np.ndarray:
    """Rows z with z[t] + weight * z[t - by] = x[t]."""
    out = x.copy()
    for t in range(by, x.shape[1]):
        out[:, t] -= weight * out[:, t - by]
    return out


def solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of many small positive definite systems, by elimination."""
    a, b, k = a.copy(), b.copy(), b.shape[1]
    for i in range(k):
        for j in range(i + 1, k):
            f = a[:, j, i] / a[:, i, i]
            a[:, j] -= f[:, None] * a[:, i]
            b[:, j] -= f * b[:, i]
    for i in range(k - 1, -1, -1):
        b[:, i] = (b[:, i] - (a[:, i, i + 1:] * b[:, i + 1:]).sum(axis=1)) / a[:, i, i]
    return b


@dataclass
class Differences:
    """Differences of series of one length (a row each) and the model's weights for them.

    Weights are the columns phi, theta and for a season of m months Phi, Theta.
    """

    w: np.ndarray
    season: int = 0

    def __post_init__(self):
        m = self.season
        self.w1 = lagged(self.w, 1)
        self.wm, self.wm1 = (lagged(self.w, m), lagged(self.w, m + 1)) if m else (None, None)

    def errors(self, p: np.ndarray) -> np.ndarray:
        u = self.w - p[:, :1] * self.w1
        if self.season:
            u = u - p[:, 2:3] * self.wm + p[:, :1] * p[:, 2:3] * self.wm1
        return self.through(u, p)

    def through(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Both moving-average filters."""
        x = filtered(x, p[:, 1], 1)
        return filtered(x, p[:, 3], self.season) if self.season else x

    def slopes(self, e: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Derivatives of the errors by each weight: (weights, rows, months)."""
        by_phi = self.w1 - p[:, 2:3] * self.wm1 if self.season else self.w1
        out = [-self.through(by_phi, p), -filtered(lagged(e, 1), p[:, 1], 1)]
        if self.season:
            out += [-self.through(self.wm - p[:, :1] * self.wm1, p),
                    -filtered(lagged(e, self.season), p[:, 3], self.season)]
        return np.stack(out)

    def fit(self) -> tuple[np.ndarray, np.ndarray]:
        """(weights, sum of squared errors): from the best of the fixed starts by damped steps."""
        starts = [s + t for s in STARTS for t in SEASONAL_STARTS] if self.season else list(STARTS)
        k = len(self.w)
        sums = np.stack([(self.errors(np.tile(s, (k, 1))) ** 2).sum(axis=1) for s in starts])
        best = sums.argmin(axis=0)
        p, total, damping = np.array(starts)[best], sums[best, np.arange(k)], np.full(k, DAMPING)
        for _ in range(ROUNDS):
            e = self.errors(p)
            slopes = self.slopes(e, p)
            a = np.einsum("irt,jrt->rij", slopes, slopes)
            g = np.einsum("irt,rt->ri", slopes, e)
            size = np.einsum("rii->r", a)
            own = np.arange(a.shape[1])
            a[:, own, own] = a[:, own, own] * (1 + damping)[:, None] + (RIDGE * size + TINY)[:, None]
            moved = np.clip(p - solved(a, g), -LIMIT, LIMIT)
            after = (self.errors(moved) ** 2).sum(axis=1)
            better = after < total * (1 - GAIN)
            p, total = np.where(better[:, None], moved, p), np.where(better, after, total)
            damping = np.where(better, damping / 10, damping * 10)
        return p, total


def ahead(y: np.ndarray, w: np.ndarray, e: np.ndarray, p: np.ndarray, season: int, steps: int) -> np.ndarray:
    """The next values of series, with no further errors."""
    known, out = w.shape[1], []

    def back(x: np.ndarray, by: int) -> np.ndarray:
        return x[:, -by] if x.shape[1] >= by else np.zeros(len(x))
    for _ in range(steps):
        nxt = p[:, 0] * back(w, 1) + p[:, 1] * back(e, 1)
        level = back(y, 1)
        if season:
            nxt = nxt + p[:, 2] * back(w, season) - p[:, 0] * p[:, 2] * back(w, season + 1) + (
                p[:, 3] * back(e, season) + p[:, 1] * p[:, 3] * back(e, season + 1))
            level = level + back(y, season) - back(y, season + 1)
        w, e = np.column_stack([w, nxt]), np.column_stack([e, np.zeros(len(e))])
        y = np.column_stack([y, nxt + level])
        out.append(y[:, -1])
    return np.stack(out, 1) if out else np.zeros((len(w), 0))


def differences(y: np.ndarray, season: int) -> np.ndarray:
    w = np.diff(y, axis=1)
    return w[:, season:] - w[:, :-season] if season else w


def estimate(y: np.ndarray, season: int, steps: int) -> tuple[np.ndarray, ...]:
    """(weights, error variance, forecasts, their standard errors) of series of one length."""
    model = Differences(differences(y, season), season)
    p, total = model.fit()
    variance = total / np.maximum(model.w.shape[1] - p.shape[1], 1)
    mean = ahead(y, model.w, model.errors(p), p, season, steps)
    # What one error adds to the values from its own month on.
    once = np.zeros((len(y), season + 2))
    once[:, -1] = 1
    adds = np.column_stack([once[:, -1], ahead(once, once, once, p, season, max(steps - 1, 0))])[:, :steps]
    return p, variance, mean, np.sqrt(variance[:, None] * (adds**2).cumsum(axis=1))


def fit(series: DataFrame, seasonal: bool = False, m: int = 12, steps: int = 0, minimum: int = 6) -> DataFrame:
    """One row per series of (series_id, month, value): its weights, error variance and forecasts.

    ``phi``, ``theta`` and the ``seasonal_`` ones are the weights, ``mean`` and ``error`` arrays of
    the forecasts of ``steps`` months and their standard errors.  A series with fewer than
    ``minimum`` months, with fewer differences than weights and one, or with a missing value has the
    reason and no weights.
    """
    send_code(series.sparkSession)
    value = F.when(~F.isnan("value"), F.col("value")).cast("double")
    past = F.transform(F.array_sort(F.collect_list(F.struct("month", value.alias("y")))), lambda s: s["y"])
    rows = series.groupBy("series_id").agg(
        F.count("*").alias("n"), F.count_if(value.isNull()).alias("gaps"), F.max("month").alias("last"),
        past.alias("past"))
    season, weights = (m, 4) if seasonal else (0, 2)
    lost = season + 1
    reason = F.when(F.col("gaps") > 0, MISSING).when(
        (F.col("n") < minimum) | (F.col("n") - lost < weights + 1), TOO_SHORT)
    rows = rows.select("series_id", "n", "last", "past", reason.alias("reason"))
    names = ["phi", "theta", "seasonal_phi", "seasonal_theta"][:weights]
    schema = T.StructType([
        *rows.schema.fields, *(T.StructField(c, T.DoubleType()) for c in [*names, "variance"]),
        T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("error", T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for c in [*names, "variance"]:
                frame[c] = np.nan
            frame["mean"], frame["error"] = None, None
            for _, own in frame[frame["reason"].isna()].groupby("n"):
                p, variance, mean, error = estimate(np.stack(own["past"].to_numpy()), season, steps)
                frame.loc[own.index, names] = p
                frame.loc[own.index, "variance"] = variance
                frame.loc[own.index, "mean"] = pd.Series(list(mean), own.index, dtype=object)
                frame.loc[own.index, "error"] = pd.Series(list(error), own.index, dtype=object)
            yield frame
    return rows.mapInPandas(run, schema)


def forecast(
    series: DataFrame, steps: int = 6, seasonal: bool = False, m: int = 12, minimum: int = 6,
    fill_gaps: bool = False, z: float = lx.INTERVAL_Z_80,
) -> DataFrame:
    """(series_id, step, month, mean, lower, upper, reason) for each series of (series_id, month, value).

    A series that ``fit`` gives a reason for has the same rows with NULL values and the
    reason.  Missing months are taken as contiguous unless ``fill_gaps`` puts zeros in.
    """
    if seasonal and steps > m:
        raise ValueError("a seasonal forecast reaches one season ahead")
    fitted = fit(without_gaps(series) if fill_gaps else series, seasonal, m, steps, minimum)
    rows = fitted.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    mean, half = F.get("mean", F.col("step") - 1), z * F.get("error", F.col("step") - 1)
    return rows.select(
        "series_id", F.col("step").cast("int").alias("step"), F.add_months("last", F.col("step")).alias("month"),
        mean.alias("mean"), (mean - half).alias("lower"), (mean + half).alias("upper"), "reason")


def forecast_table(fc: DataFrame) -> DataFrame:
    """Display form: month label and values with one decimal."""
    return fc.select(
        "series_id", "step", F.date_format("month", "MMM yyyy").alias("month"),
        *[F.round(c, 1).alias(c) for c in ("mean", "lower", "upper")],
    )


def trend_direction(fc: DataFrame) -> DataFrame:
    """Rising when the last forecast exceeds the first, else declining; NULL without forecasts."""
    ends = fc.groupBy("series_id").agg(
        F.min_by("mean", "step").alias("first"), F.max_by("mean", "step").alias("last")
    )
    rising = F.col("last") > F.col("first")
    return ends.withColumn("trend", F.when(rising, "rising").when(~rising, "declining"))

"""Model-based forecasts, one small fit per series.

Input is a table at a regular calendar grain, so a series is only as long as its calendar;
Spark spreads the series over tasks and each fit is a short numpy calculation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators.timeseries import future_dates
from sievework.session import union_rows

SEASON = {"D": 7, "W": 52, "M": 12, "Q": 4, "H": 24}
BAND_Z = 1.2815515655446004  # 80 % band

Fit = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, float]]


def _per_series(df: DataFrame, keys: Sequence[str], freq: str, periods: int, fit: Fit) -> DataFrame:
    """Rows (keys, ts, value, fitted, lower, upper, kind) for history and ``periods`` ahead.

    ``fit(values, days, periods)`` gets the known values and the day numbers of history plus
    future, and returns fitted values, forecasts and the residual deviation.
    """
    keys = list(keys)
    day = F.unix_date(F.to_date("ts")) + F.hour(F.col("ts").cast("timestamp_ntz")) / 24.0
    ahead = future_dates(df, keys, freq, periods).select(*keys, "ts", F.lit(None).cast("double").alias("value"), F.lit("forecast").alias("kind"))
    past = df.select(*keys, "ts", F.col("value").cast("double").alias("value"), F.lit("history").alias("kind"))
    both = union_rows([past, ahead])
    both = both.withColumn("_day", day)
    base = both.drop("_day").schema
    out = T.StructType([*base.fields, *[T.StructField(c, T.DoubleType()) for c in ("fitted", "lower", "upper")]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts").reset_index(drop=True)
        past = (pdf["kind"] == "history").to_numpy()
        y = pdf.loc[past, "value"].ffill().bfill().to_numpy(dtype=float)
        h = int((~past).sum())
        if len(y) == 0 or np.isnan(y).any():
            fitted, future, sd = np.full(len(y), np.nan), np.full(h, np.nan), math.nan
        else:
            fitted, future, sd = fit(y, pdf["_day"].to_numpy(), h)
        line = np.concatenate([fitted, future])
        return pdf.drop(columns="_day").assign(fitted=line, lower=line - BAND_Z * sd, upper=line + BAND_Z * sd)

    return both.groupBy(*keys).applyInPandas(run, out)


def _smooth(y: np.ndarray, m: int, alpha: np.ndarray, gamma: np.ndarray):
    """Additive level and season recursion for many (alpha, gamma) pairs at once."""
    level = np.full(alpha.shape, y[:m].mean())
    season = np.tile((y[:m] - y[:m].mean())[:, None], (1, alpha.size)) if m > 1 else np.zeros((1, alpha.size))
    fitted = np.empty((len(y), alpha.size))
    for t, v in enumerate(y):
        s = season[t % m].copy()
        fitted[t] = level + s
        level_new = alpha * (v - s) + (1 - alpha) * level
        if m > 1:
            season[t % m] = gamma * (v - level_new) + (1 - gamma) * s
        level = level_new
    return fitted, level, season


def forecast_holt_winters(df: DataFrame, keys: Sequence[str], freq: str, periods: int = 10, season: int | None = None) -> DataFrame:
    """Additive seasonal exponential smoothing without trend; weights by refined grid search."""
    m_default = season or SEASON.get(freq, 1)

    def fit(y: np.ndarray, days: np.ndarray, h: int):
        m = m_default if len(y) >= 2 * m_default else 1
        lo_a, hi_a, lo_g, hi_g = 0.01, 0.99, 0.0, 0.99
        for _ in range(3):
            a, g = np.meshgrid(np.linspace(lo_a, hi_a, 15), np.linspace(lo_g, hi_g, 15 if m > 1 else 1))
            a, g = a.ravel(), g.ravel()
            fitted, level, seas = _smooth(y, m, a, g)
            best = int(np.argmin(((y[:, None] - fitted) ** 2).sum(axis=0)))
            da, dg = (hi_a - lo_a) / 14, (hi_g - lo_g) / 14
            lo_a, hi_a = max(0.001, a[best] - da), min(0.999, a[best] + da)
            lo_g, hi_g = max(0.0, g[best] - dg), min(0.999, g[best] + dg)
        ahead = level[best] + np.array([seas[(len(y) + i) % m, best] for i in range(h)])
        return fitted[:, best], ahead, float(np.std(y - fitted[:, best]))

    return _per_series(df, keys, freq, periods, fit)


def _least_squares(x: np.ndarray, y: np.ndarray, ridge: float = 1e-8) -> np.ndarray:
    scale = np.maximum(np.abs(x).max(axis=0), 1e-12)
    z = x / scale
    return np.linalg.solve(z.T @ z + ridge * len(y) * np.eye(z.shape[1]), z.T @ y) / scale


def forecast_fourier(df: DataFrame, keys: Sequence[str], freq: str, periods: int = 10, seasonality: str = "auto") -> DataFrame:
    """Straight trend plus sine and cosine waves of the year, week or day, least squares.

    'auto' uses the waves the grain can show and the history covers twice; a wave asked for by
    name that the grain cannot show is an error.
    """
    cycles = {"yearly": (365.25, 5), "weekly": (7.0, 3), "daily": (1.0, 4)}
    step_days = {"H": 1 / 24, "D": 1, "W": 7, "M": 30.4, "Q": 91.3, "Y": 365.25}[freq]
    if seasonality != "auto" and (seasonality not in cycles or cycles[seasonality][0] < 2 * step_days):
        raise ValueError(f"no {seasonality} cycle at the grain {freq}")

    def fit(y: np.ndarray, days: np.ndarray, h: int):
        t = (days - days[0]) / 365.25
        n = len(y)
        cols = [np.ones_like(t), t]
        for name, (length, order) in cycles.items():
            shown = seasonality == name or (seasonality == "auto" and days[n - 1] - days[0] >= 2 * length)
            if not shown:
                continue
            for k in range(1, order + 1):
                if length / k < 2 * step_days or len(cols) + 2 >= n:
                    break
                w = 2 * math.pi * k * days / length
                cols += [np.sin(w), np.cos(w)]
        x = np.column_stack(cols)
        beta = _least_squares(x[:n], y)
        line = x @ beta
        dof = max(n - x.shape[1], 1)
        return line[:n], line[n:], float(np.sqrt(((y - line[:n]) ** 2).sum() / dof))

    return _per_series(df, keys, freq, periods, fit)


def forecast_autoregressive(
    df: DataFrame, keys: Sequence[str], freq: str, periods: int = 10, season: int | None = None, order: int = 3
) -> DataFrame:
    """y on a constant, its last ``order`` values and the value a season ago; recursive ahead."""
    m_default = season or SEASON.get(freq, 12)

    def fit(y: np.ndarray, days: np.ndarray, h: int):
        n = len(y)
        m = m_default if n >= m_default + 2 * (order + 2) else 0
        lags = sorted({*range(1, order + 1), *([m] if m else [])})
        start = lags[-1]
        if n < start + len(lags) + 2:
            flat = float(y.mean())
            return np.full(n, flat), np.full(h, flat), float(y.std())
        x = np.column_stack([np.ones(n - start), *[y[start - k : n - k] for k in lags]])
        beta = _least_squares(x, y[start:])
        fitted = np.concatenate([np.full(start, np.nan), x @ beta])
        path = list(y)
        for _ in range(h):
            path.append(float(beta[0] + sum(b * path[-k] for b, k in zip(beta[1:], lags))))
        rest = y[start:] - fitted[start:]
        return fitted, np.array(path[n:]), float(np.sqrt((rest**2).sum() / max(len(rest) - len(beta), 1)))

    return _per_series(df, keys, freq, periods, fit)

"""Long-run volatility, trailing quantiles and deviations of daily series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ewm
from .windows import folded, quantiles, trailing


def long_run_sigma(rows: DataFrame, keys: list[str], at: str, r: str, span: int, lam: float, least: int) -> DataFrame:
    """rows with sigma_lt: root of the mean of the squares of the `span` rows before, weighted lam^age, by the weights in use."""

    def compute(w: np.ndarray) -> list[np.ndarray]:
        there = ~np.isnan(w)
        age = there[:, ::-1].cumsum(axis=1)[:, ::-1] - 1
        weight = np.where(there, lam ** np.maximum(age, 0), 0.0)
        total = weight.sum(axis=1)
        mean = (weight * np.where(there, w, 0.0) ** 2).sum(axis=1) / np.where(total > 0, total, 1.0)
        return [np.where(there.sum(axis=1) >= least, np.sqrt(mean), np.nan)]

    return trailing(rows, keys, at, r, span, compute, "sigma_lt double")


def trailing_quantiles(rows: DataFrame, keys: list[str], at: str, x: str, span: int, least: int) -> DataFrame:
    """rows with q95, q99 of x over the `span` rows before."""
    return trailing(rows, keys, at, x, span, lambda w: quantiles(w, (0.95, 0.99), least), "q95 double, q99 double")


def rolling_mad(rows: DataFrame, keys: list[str], at: str, x: str, n: int) -> DataFrame:
    """rows with mad: median distance to the median of the n rows before, null if any of them is missing."""
    return trailing(rows, keys, at, x, n, lambda w: [np.median(np.abs(w - np.median(w, axis=1, keepdims=True)), axis=1)], "mad double")


def ewma_start():
    return 0.0, 0.0, 0


def ewma_step(state, r, lam: float = 0.94, cut: float = 5.0):
    """(z, sd) against the state (mean, variance, n) before the row; the update is winsorised at `cut` deviations and uses the old mean."""
    mean, var, n = state
    sd = var**0.5
    z = (r - mean) / sd if n >= 20 and sd > 0 else None
    x = r if z is None else mean + max(-cut, min(cut, z)) * sd
    return (lam * mean + (1 - lam) * x, lam * var + (1 - lam) * (x - mean) ** 2, n + 1), (z, sd)


#: Memory of the state (24 rows) and of the thresholds (120 rows), least deviation as a share of the long-run sigma, rows of the
#: median deviation and how many of them a winsorised return may be.
LAMBDA, LAMBDA_Q, FLOOR, MAD_ROWS, MAD_LIMIT = 2 / 25, 2 / 121, 0.2, 24, 5.0


def winsorised(rows: DataFrame, keys: list[str], at: str, r: str = "r", sigma: str = "sigma_lt") -> DataFrame:
    """rows (with the long-run sigma) with r_w: r held within MAD_LIMIT trailing median deviations, each FLOOR sigmas at least; r itself where either is unknown."""
    out = rolling_mad(rows, keys, at, r, MAD_ROWS)
    limit = MAD_LIMIT * F.greatest(F.col("mad"), FLOOR * F.col(sigma))
    known = F.col("mad").isNotNull() & F.col(sigma).isNotNull() & (F.abs(r) > limit)
    return out.withColumn("r_w", F.when(known, F.signum(r) * limit).otherwise(F.col(r))).drop("mad")


def _state_step(state, r, r_w, sigma):
    """(z, deviation in use) against the state before the row; the update takes the winsorised return, and the old mean in the variance."""
    if r is None:
        return state, (None, None)
    mean, var = state if state is not None else (0.0, r * r)
    sd = max(var**0.5, FLOOR * sigma if sigma is not None else 0.0)
    new = (LAMBDA * r_w + (1 - LAMBDA) * mean, LAMBDA * (r_w - mean) ** 2 + (1 - LAMBDA) * var)
    return new, ((r - mean) / sd if sd > 0 and sigma is not None else None, sd if sd > 0 else None)


def ewma_scores(rows: DataFrame, keys: list[str], at: str, r: str = "r", sigma: str = "sigma_lt") -> DataFrame:
    """rows with r_w, z, sigma_eff: scores against a short memory that a lull can't shrink below a share of the long-run sigma; z only where that is known."""
    return folded(winsorised(rows, keys, at, r, sigma), keys, at, [r, "r_w", sigma], _state_step, lambda: None, "z double, sigma_eff double")


def smoothed_thresholds(rows: DataFrame, keys: list[str], at: str, z: str, span: int, block: int = 365 * 86_400) -> DataFrame:
    """Rows with a z, with q95 and q99: quantiles of |z| over the `span` such rows before (none with fewer), smoothed along the key."""
    told = trailing_quantiles(rows.where(F.col(z).isNotNull()).withColumn("_size", F.abs(z)), keys, at, "_size", span, span).drop("_size")
    out = ewm(told, keys, at, ["q95", "q99"], LAMBDA_Q, block)
    keep = [c for c in rows.columns if c not in ("q95", "q99")]
    return out.select(*keep, *(F.when(F.col(q).isNotNull(), F.col(f"{q}_ewm")).alias(q) for q in ("q95", "q99")))

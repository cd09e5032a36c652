"""Fit of the self-exciting model with several channels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.plans.hawkes import multi_history

#: Decay rates that are tried.
BETAS = (0.02, 0.05, 0.1, 0.2, 0.4)


def fit_multi(bars: DataFrame, channels: list[str], betas=BETAS, steps: int = 15) -> dict:
    """mu (K), alpha (K x K), beta, nll and the end state r (K) of least sum(lam_k - n_k log lam_k) over all bars.

    For a given beta the histories are fixed and the likelihood is concave, and multiplicative steps raise it until they
    stand still: mu_k *= sum(n_k / lam_k) / N, alpha_kj *= sum(n_k r_j / lam_k) / sum(r_j). Each is one aggregation over
    the bars that hold events. Of the decay rates the one of least nll wins. Only sums reach the driver.
    """
    n, k = bars.count(), len(channels)
    best: dict = {}
    for beta in betas:
        hist = [f"r_{c}" for c in channels]
        rows = multi_history(bars, channels, beta).select("i", *channels, *hist).persist()
        first = rows.agg(*[F.sum(c).alias(c) for c in [*channels, *hist]]).first()
        total, area = np.array([float(first[c] or 0) for c in channels]), np.array([float(first[c] or 0) for c in hist])
        events = rows.where(" or ".join(f"{c} > 0" for c in channels))
        mu = np.maximum(0.5 * total / max(n, 1), 1e-9)
        alpha = np.where(area > 0, np.maximum(0.5 * total, 1e-9)[:, None] / (k * np.where(area > 0, area, 1)), 0.0)
        for step in range(steps + 1):
            parts = []
            for a, c in enumerate(channels):
                lam = F.lit(float(mu[a])) + sum((float(alpha[a, b]) * F.col(h) for b, h in enumerate(hist)), F.lit(0.0))
                parts += [F.sum(F.col(c) * F.log(lam)), F.sum(F.col(c) / lam), *[F.sum(F.col(c) * F.col(h) / lam) for h in hist]]
            got = np.array([float(x or 0) for x in events.agg(*parts).first()]).reshape(k, 2 + k)
            nll = float(mu.sum() * n + (alpha * area).sum() - got[:, 0].sum())
            if step < steps:
                mu = np.maximum(mu * got[:, 1] / max(n, 1), 1e-12)
                alpha = np.where(area > 0, alpha * got[:, 2:] / np.where(area > 0, area, 1), 0.0)
        if not best or nll < best["nll"]:
            last = rows.where(F.col("i") == n - 1).first()
            end = [float(np.exp(-beta) * (last[h] + last[c])) for c, h in zip(channels, hist)] if last else [0.0] * k
            best = {"mu": mu.tolist(), "alpha": alpha.tolist(), "beta": beta, "nll": nll, "end": end}
        rows.unpersist()
    return best

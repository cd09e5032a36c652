"""Self-exciting alarm on bars: marks, likelihood, fit and scores."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremor.operators.recurrence import decayed_history
from tremor.sources.shared import saved


def marks(bars: DataFrame, weight: float = 0.5) -> DataFrame:
    """bars with mark = count + weight * USD / (mean positive USD)."""
    scale = bars.agg(F.avg(F.when(F.col("liquidated_usd") > 0, F.col("liquidated_usd"))).alias("s")).first().s
    return bars.withColumn("mark", F.col("n_liquidations") + (weight / scale if scale else 0.0) * F.col("liquidated_usd"))


def scored(bars: DataFrame, mu: float, alpha: float, beta: float, mark: str = "n_liquidations", start: float = 0.0) -> DataFrame:
    """bars with r, lam = mu + alpha * r and score = alpha * r / lam."""
    rows = decayed_history(bars.withColumn("__m", F.col(mark).cast("double")), [], "i", "__m", beta, "r", start).drop("__m")
    return rows.withColumn("lam", mu + alpha * F.col("r")).withColumn("score", alpha * F.col("r") / F.col("lam"))


def history_with_slope(events: DataFrame, beta: float) -> DataFrame:
    """Bars that hold events, with r and q = sum over earlier j of mark_j * (i - j) * exp(-beta * (i - j)), so dr/dbeta = -q."""
    with_r = decayed_history(events.withColumn("im", F.col("m") * F.col("i")), [], "i", "m", beta, "r")
    with_s = decayed_history(with_r, [], "i", "im", beta, "s")
    return with_s.withColumn("q", F.col("i") * F.col("r") - F.col("s"))


def likelihood_terms(events: DataFrame, n_bars: int, mu: float, alpha: float, beta: float) -> tuple:
    """(NLL, d/dmu, d/dalpha, d/dbeta) of sum(lam - m log lam) over all bars, from the bars that hold events alone.

    Quiet bars only enter through the sum of r, which each mark m at bar j adds to in closed form: m d (1 - d^g) / (1 - d), with
    d = exp(-beta) and g bars after j.
    """
    d = math.exp(-beta)
    g = F.lit(float(n_bars - 1)) - F.col("i")
    dg = F.exp(-beta * g)
    area = F.col("m") * d * (1 - dg) / (1 - d)
    slope = F.col("m") * (d * (1 - dg) / (1 - d) ** 2 - g * d * dg / (1 - d))  # sum of k d^k over k = 1 .. g
    lam = mu + alpha * F.col("r")
    row = history_with_slope(events, beta).agg(F.sum(area).alias("sr"), F.sum(slope).alias("sq"), F.sum(F.col("m") * F.log(lam)).alias("ll"), F.sum(F.col("m") / lam).alias("a"), F.sum(F.col("m") * F.col("r") / lam).alias("b"), F.sum(F.col("m") * F.col("q") / lam).alias("c")).first()
    return (mu * n_bars + alpha * row.sr - row.ll, n_bars - row.a, row.sr - row.b, alpha * (row.c - row.sq))


def fit(bars: DataFrame, mark: str = "n_liquidations", steps: int = 25) -> dict:
    """Least NLL over (mu, alpha, beta) in log space, within [-25, 5]: BFGS on the driver, each evaluation one Spark job over event bars."""
    n_bars = bars.count()
    events = bars.where(F.col(mark) > 0).select("i", F.col(mark).cast("double").alias("m")).persist()
    total = events.agg(F.sum("m").alias("s")).first().s or 0.0
    x = np.log(np.array([max(0.5 * total / max(n_bars, 1), 1e-9), 0.02, 0.05]))

    def f(x):
        p = np.exp(np.clip(x, -25, 5))
        nll, *grad = likelihood_terms(events, n_bars, *map(float, p))
        return nll, np.array(grad) * p

    h, (y, g) = np.eye(3), f(x)
    h *= 1 / max(np.abs(g).max(), 1e-9)
    for _ in range(steps):
        if np.abs(g).max() < 1e-3 * max(1.0, total) * 1e-2:
            break
        step, t = -h @ g, 1.0
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        while t > 1e-4:
            y2, g2 = f(x + t * step)
            if math.isfinite(y2) and y2 <= y + 1e-4 * t * g @ step:
                break
            t /= 2
        else:
            break
        s, d = t * step, g2 - g
        if s @ d > 1e-12:
            r = 1 / (s @ d)
            a = np.eye(3) - r * np.outer(s, d)
            h = a @ h @ a.T + r * np.outer(s, s)
        x, y, g = x + s, y2, g2
    events.unpersist()
    mu, alpha, beta = (float(v) for v in np.exp(np.clip(x, -25, 5)))
    return {"mu": mu, "alpha": alpha, "beta": beta, "nll": float(y), "branching": alpha * math.exp(-beta) / (1 - math.exp(-beta)), "n_bars": n_bars}


def fold_terms(events: DataFrame, points: list[tuple], last: int) -> dict[int, tuple[float, np.ndarray]]:
    """fold -> (NLL, its gradient by mu, alpha and beta) at points (fold, n_bars, mu, alpha, beta), each over the event bars (i, m, fold) before its fold: one job."""
    spark = events.sparkSession
    at = spark.createDataFrame(points, "f int, n_bars double, mu double, alpha double, beta double")  # a row a fold
    least = min(p[4] for p in points)
    rows = events.where(F.col("fold") < last).select("i", "m", F.explode(F.sequence(F.col("fold") + 1, F.lit(last))).alias("f")).join(F.broadcast(at), "f")
    beta, m, i = F.col("beta"), F.col("m"), F.col("i")
    rows = decayed_history(rows, ["f"], "i", "m", beta, "r", least=least)
    rows = decayed_history(rows.withColumn("im", m * i), ["f"], "i", "im", beta, "s", least=least)
    d, g = F.exp(-beta), F.col("n_bars") - 1 - i
    dg, q, lam = F.exp(-beta * g), i * F.col("r") - F.col("s"), F.col("mu") + F.col("alpha") * F.col("r")
    sums = {"sr": m * d * (1 - dg) / (1 - d), "sq": m * (d * (1 - dg) / (1 - d) ** 2 - g * d * dg / (1 - d)), "ll": m * F.log(lam), "a": m / lam, "b": m * F.col("r") / lam, "c": m * q / lam}
    got = {r.f: r for r in rows.groupBy("f").agg(*[F.sum(x).alias(n) for n, x in sums.items()]).collect()}
    out = {}
    for f, n, mu, alpha, _ in points:
        r = got.get(f)
        sr, sq, ll, a, b, c = (getattr(r, n) for n in sums) if r else (0.0,) * 6
        out[f] = (mu * n + alpha * sr - ll, np.array([n - a, sr - b, alpha * (c - sq)]))
    return out


def fit_folds(events: DataFrame, bars_before: dict[int, int], evaluations: int = 80) -> dict[int, dict]:
    """fold -> mu, alpha, beta, nll and whether the fit stands still, of least NLL over the bars before each fold (as fit(), within [-25, 5] in
    log space). events: i, m, fold of the bars that hold events; bars_before: how many bars lie before each fold.

    All folds are fitted side by side: BFGS of each has its own step and line search, and each job evaluates the next point of all that
    aren't done, so there are as many jobs as the slowest fit has points. A fold's sums come from the same rows as those of later ones.
    """
    events = saved(events)
    totals = {r.fold: r.s for r in events.groupBy("fold").agg(F.sum("m").alias("s")).collect()}  # a row a fold
    last, todo, out = max(bars_before, default=0), {}, {}
    for f, n in bars_before.items():
        total = float(sum(s for k, s in totals.items() if k < f))
        x = np.log(np.array([max(0.5 * total / max(n, 1), 1e-9), 0.02, 0.05]))
        todo[f] = {"n": float(n), "total": total, "x": x, "try": x, "h": None, "t": 1.0}
    for _ in range(evaluations):
        if not todo:
            break
        points = [(f, w["n"], *map(float, np.exp(np.clip(w["try"], -25, 5)))) for f, w in todo.items()]
        for (f, (y, grad)), point in zip(fold_terms(events, points, last).items(), points):
            w, g = todo[f], grad * np.array(point[2:])
            if w["h"] is None:
                w |= {"y": y, "g": g, "h": np.eye(3) / max(np.abs(g).max(), 1e-9)}
            elif math.isfinite(y) and y <= w["y"] + 1e-4 * w["t"] * w["g"] @ w["step"]:
                s, d = w["try"] - w["x"], g - w["g"]
                if s @ d > 1e-12:
                    a = np.eye(3) - np.outer(s, d) / (s @ d)
                    w["h"] = a @ w["h"] @ a.T + np.outer(s, s) / (s @ d)
                w |= {"x": w["try"], "y": y, "g": g, "t": 1.0}
            else:
                w["t"] /= 2
            if w["t"] == 1.0:
                step = -w["h"] @ w["g"]
                w["step"] = step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
            still = np.abs(w["g"]).max() < 1e-5 * max(1.0, w["total"])
            if still or w["t"] < 1e-4:
                out[f] = _fitted(todo.pop(f), True)
            else:
                w["try"] = w["x"] + w["t"] * w["step"]
    return out | {f: _fitted(w, False) for f, w in todo.items()}


def _fitted(w: dict, still: bool) -> dict:
    mu, alpha, beta = (float(v) for v in np.exp(np.clip(w["x"], -25, 5)))
    return {"mu": mu, "alpha": alpha, "beta": beta, "nll": float(w["y"]), "still": still}


def scored_folds(bars: DataFrame, fits: dict[int, dict]) -> DataFrame:
    """(i, fold, end_block, r, score) of the bars of each fitted fold, by its own fit over all bars up to its end: one pass for all folds. bars: i, fold,
    end_block, n_liquidations."""
    if not fits:
        return bars.select("i", "fold", "end_block", F.lit(None).cast("double").alias("r"), F.lit(None).cast("double").alias("score")).limit(0)
    at = bars.sparkSession.createDataFrame([(f, m["mu"], m["alpha"], m["beta"]) for f, m in fits.items()], "f int, mu double, alpha double, beta double")  # a row a fold
    kept = (F.col("n_liquidations") > 0) | (F.col("f") == F.col("fold"))  # quiet bars of earlier folds add nothing
    rows = bars.where(F.col("fold") <= max(fits)).withColumn("f", F.explode(F.sequence(F.col("fold").cast("int"), F.lit(max(fits))))).where(kept).join(F.broadcast(at), "f")
    rows = decayed_history(rows.withColumn("m", F.col("n_liquidations").cast("double")), ["f"], "i", "m", F.col("beta"), "r", least=min(m["beta"] for m in fits.values()))
    up = F.col("alpha") * F.col("r")
    return rows.where("f = fold").select("i", "fold", "end_block", "r", (up / (F.col("mu") + up)).alias("score"))


def residuals(rows: DataFrame, seed: int) -> DataFrame:
    """rows (i, lam, n_liquidations) with u: uniform if counts are Poisson of mean lam, between the distribution function below and at
    the count by a hash of (seed, i), so that reruns agree. The function is a finite sum of terms lam^k / k! exp(-lam)."""
    below = F.expr("""aggregate(sequence(0, cast(n_liquidations as int)), named_struct('term', exp(-lam), 'below', 0D, 'upto', 0D),
        (a, k) -> named_struct('term', a.term * lam / (k + 1), 'below', a.upto, 'upto', a.upto + a.term))""")
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "i")), 1, 15), 16, 10).cast("double") / float(1 << 60)
    return rows.withColumn("__c", below).withColumn("u", F.col("__c.below") + draw * (F.col("__c.upto") - F.col("__c.below"))).drop("__c")


def ks_distance(rows: DataFrame, u: str, cells: int = 4096) -> DataFrame:
    """One row `ks`: the largest distance of a column's distribution from the uniform one on [0, 1]. Ranks are counts of cells before and places within a cell."""
    rows = rows.select(F.col(u).alias("u"), F.least(F.floor(F.col(u) * cells), F.lit(cells - 1)).alias("cell"))
    counts = rows.groupBy("cell").agg(F.count("*").alias("c"))
    before = counts.select("cell", (F.sum("c").over(W.orderBy("cell")) - F.col("c")).alias("before"), F.sum("c").over(W.partitionBy()).alias("n"))  # a row per cell
    rank = F.col("before") + F.row_number().over(W.partitionBy("cell").orderBy("u"))
    placed = rows.join(F.broadcast(before), "cell").select("u", "n", rank.alias("rank"))
    return placed.agg(F.max(F.greatest(F.col("rank") / F.col("n") - F.col("u"), F.col("u") - (F.col("rank") - 1) / F.col("n"))).alias("ks"))


def multi_history(bars: DataFrame, channels: list[str], beta: float) -> DataFrame:
    """bars with r_<channel> for each channel, one decayed history each."""
    for c in channels:
        bars = decayed_history(bars.withColumn("__m", F.col(c).cast("double")), [], "i", "__m", beta, f"r_{c}").drop("__m")
    return bars


def multi_nll(bars: DataFrame, channels: list[str], mu: list[float], alpha: list[list[float]], beta: float) -> DataFrame:
    """One row: nll and the gradient by mu (g_mu_k) and by alpha (g_alpha_k_j), in one aggregation."""
    rows = multi_history(bars, channels, beta)
    out, total = [], F.lit(0.0)
    for k, c in enumerate(channels):
        lam = F.lit(mu[k])
        for j, e in enumerate(channels):
            lam = lam + alpha[k][j] * F.col(f"r_{e}")
        rows = rows.withColumn(f"lam_{k}", lam)
        rest = 1 - F.col(c) / F.col(f"lam_{k}")
        total = total + F.col(f"lam_{k}") - F.col(c) * F.log(F.col(f"lam_{k}"))
        out.append(F.sum(rest).alias(f"g_mu_{k}"))
        out += [F.sum(rest * F.col(f"r_{e}")).alias(f"g_alpha_{k}_{j}") for j, e in enumerate(channels)]
    return rows.agg(F.sum(total).alias("nll"), *out)


def spectral_radius(alpha: list[list[float]], beta: float) -> float:
    return float(np.abs(np.linalg.eigvals(np.array(alpha) / beta)).max())

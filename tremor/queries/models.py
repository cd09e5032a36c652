"""Queries: the self-exciting model on bars."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tremor.operators.recurrence import decayed_history
from tremor.plans import hawkes
from tremor.queries.alarms import ALPHA, BETA, MU, SCORES, score_table
from tremor.queries.cascades import BARS, bar_table
from tremor.queries.registry import query
from tremor.sources import adapter as A
from tremor.sources.adapter import cte
from tremor.sources.shared import saved

_BASE = cte("grid") + BARS + SCORES
CHANNELS = ["a0", "a1", "a2"]
M_MU, M_ALPHA, M_BETA = [0.01, 0.02, 0.03], [[0.01, 0.002, 0.001], [0.003, 0.01, 0.002], [0.001, 0.002, 0.02]], 0.05


@query(_BASE + " select i, r, lam, score from scores")
def hawkes_score(spark, d):
    return score_table(spark, d).select("i", "r", "lam", "score")


@query(_BASE + " select i, lam from scores")
def hawkes_intensity(spark, d):
    return score_table(spark, d).select("i", "lam")


@query(_BASE + " select i, r from hist")
def linear_recurrence(spark, d):
    b = bar_table(spark, d).withColumn("m", F.col("n_liquidations").cast("double"))
    return decayed_history(b, [], "i", "m", BETA, "r").select("i", "r")


@query(_BASE + " select i, n_liquidations + 0.5 * liquidated_usd / (select avg(liquidated_usd) from bars where liquidated_usd > 0) as mark from bars")
def hawkes_marks(spark, d):
    return hawkes.marks(bar_table(spark, d)).select("i", "mark")


@query(_BASE + " select sum(lam - n_liquidations * ln(lam)) as nll from scores")
def hawkes_nll(spark, d):
    b = bar_table(spark, d)
    n, events = b.count(), b.where("n_liquidations > 0").select("i", F.col("n_liquidations").cast("double").alias("m"))
    nll, *_ = hawkes.likelihood_terms(events, n, MU, ALPHA, BETA)
    return spark.createDataFrame([(float(nll),)], "nll double")


@query()
def hawkes_fit(spark, d):
    m = hawkes.fit(bar_table(spark, d))
    return spark.createDataFrame([tuple(m[k] for k in ("mu", "alpha", "beta", "nll", "branching", "n_bars"))], "mu double, alpha double, beta double, nll double, branching double, n_bars long")


_COUNTS = ", ".join(f"(select count(*) from liq, b0 where collateral_asset = '{c}' and least((block_number - lo) // (select bw from grid), n - 1) = bars.i) as {c}" for c in CHANNELS)
_KEPT = ", ".join(f"any_value(b.{c}) as {c}" for c in CHANNELS)
_HISTORY = ", ".join(f"coalesce(sum(m.{c} * exp(-{M_BETA} * (b.i - m.i))), 0) as r_{c}" for c in CHANNELS)
_LAMBDA = ", ".join(f"{M_MU[k]} + " + " + ".join(f"{M_ALPHA[k][j]} * r_{e}" for j, e in enumerate(CHANNELS)) + f" as lam_{k}" for k in range(3))
#: Channel counts of the bars, each channel's decayed history, and each channel's intensity.
_MULTI = (
    cte("grid")
    + BARS
    + f""", cb as (select i, {_COUNTS} from bars),
mh as (select b.i, {_KEPT}, {_HISTORY} from cb b left join cb m on m.i < b.i and m.a0 + m.a1 + m.a2 > 0 group by b.i),
ml as (select *, {_LAMBDA} from mh)"""
)
_NLL = " + ".join(f"lam_{k} - {c} * ln(lam_{k})" for k, c in enumerate(CHANNELS))
_BY_MU = ", ".join(f"sum(1 - {c} / lam_{k}) as g_mu_{k}" for k, c in enumerate(CHANNELS))
_BY_ALPHA = ", ".join(f"sum((1 - {c} / lam_{k}) * r_{e}) as g_alpha_{k}_{j}" for k, c in enumerate(CHANNELS) for j, e in enumerate(CHANNELS))


def _channel_bars(spark, d):
    from tremor.operators import bars as B

    q, w = A.liquidations(spark, d), A.BAR
    lo, hi = B.bounds(q)
    n = max(1, -(-(hi - lo) // w))
    slot = F.least(F.floor((F.col("block_number") - lo) / w), F.lit(n - 1)).cast("long").alias("i")
    counts = q.groupBy(slot).pivot("collateral_asset", CHANNELS).count()
    return spark.range(n).withColumnRenamed("id", "i").join(counts, "i", "left").na.fill(0, CHANNELS)


@query(_MULTI + f" select sum({_NLL}) as nll, {_BY_MU}, {_BY_ALPHA} from ml")
def hawkes_multi_nll_grad(spark, d):
    return hawkes.multi_nll(_channel_bars(spark, d), CHANNELS, M_MU, M_ALPHA, M_BETA)


_PARTS = ", ".join(f"lam_{k}, 1 - {M_MU[k]} / lam_{k} as score_{k}" for k in range(3))


@query(_MULTI + f" select i, 1 - 0.06 / (lam_0 + lam_1 + lam_2) as score, {_PARTS} from ml")
def hawkes_multi_score(spark, d):
    rows = hawkes.multi_history(_channel_bars(spark, d), CHANNELS, M_BETA)
    lam = [F.lit(M_MU[k]) + sum((M_ALPHA[k][j] * F.col(f"r_{e}") for j, e in enumerate(CHANNELS)), F.lit(0.0)) for k in range(3)]
    whole = (1 - sum(M_MU) / (lam[0] + lam[1] + lam[2])).alias("score")
    each = [x.alias(f"lam_{k}") for k, x in enumerate(lam)]
    shares = [(1 - M_MU[k] / x).alias(f"score_{k}") for k, x in enumerate(lam)]
    return rows.select("i", whole, *each, *shares)


BINS, LEAST_BARS, GOF_SEED = 21, 50, 7


@query(
    _BASE
    + f""", u as (select i, n_liquidations as m, lam, coalesce(list_sum(list_transform(generate_series(0, n_liquidations - 1), lambda k: exp(-lam + k * ln(lam) - lgamma(k + 1)))), 0) as a, exp(-lam + n_liquidations * ln(lam) - lgamma(n_liquidations + 1)) as t,
   cast('0x' || substr(md5('{GOF_SEED}:' || i), 1, 15) as bigint) / 1152921504606846976.0::double as z from scores),
v as (select a + z * t as u, count(*) over () as n, row_number() over (order by a + z * t) as r from u),
one as (select (select max(greatest(r / n - u, u - (r - 1) / n)) from v) as ks, (select sum(lam) from u) as total_pred, (select sum(m) from u)::double as total_obs, {ALPHA} * exp(-{BETA}) / (1 - exp(-{BETA})) as branching),
e as (select ln(min(lam)) as lo, ln(max(lam)) as hi from u),
b as (select least(cast(floor((ln(lam) - lo) / (hi - lo) * {BINS}) as bigint), {BINS - 1}) as bin, avg(lam) as expected, avg(m) as observed, count(*) as n from u, e group by 1 having count(*) >= {LEAST_BARS})
select bin, expected, observed, n, ks, branching, total_pred, total_obs from b, one"""
)
def gof(spark, d):
    """Bins of equal log intensity with 50 bars or more, beside the distance of randomised residuals from uniform, the branching ratio and both sums."""
    s = saved(hawkes.residuals(score_table(spark, d).select("i", "lam", "n_liquidations"), GOF_SEED))
    decay = math.exp(-BETA)
    sums = s.agg(F.sum("lam").alias("total_pred"), F.sum("n_liquidations").cast("double").alias("total_obs"), F.min(F.log("lam")).alias("lo"), F.max(F.log("lam")).alias("hi"))
    one = sums.crossJoin(hawkes.ks_distance(s, "u")).withColumn("branching", F.lit(ALPHA * decay / (1 - decay)))  # one row each
    share = F.coalesce((F.log("lam") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.0))
    rows = s.crossJoin(F.broadcast(one)).withColumn("bin", F.least(F.floor(share * BINS), F.lit(BINS - 1)))
    g = rows.groupBy("bin", "ks", "branching", "total_pred", "total_obs").agg(F.avg("lam").alias("expected"), F.avg("n_liquidations").alias("observed"), F.count("*").alias("n"))
    return g.where(F.col("n") >= LEAST_BARS).select("bin", "expected", "observed", "n", "ks", "branching", "total_pred", "total_obs")

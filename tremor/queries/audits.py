"""Queries: positions before a log, second price sources, observed accounts, snapshots at many blocks, alert streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremor.functions.interest import hf_band
from tremor.operators import bars as B
from tremor.operators.asof import asof_join as asof
from tremor.plans import hawkes, multifit
from tremor.plans import state as S
from tremor.plans.anchors import snapshot_anchors as anchors
from tremor.queries.alarms import ALPHA, MU, SCORES, score_table
from tremor.queries.cascades import BARS, STRESS, stress_windows
from tremor.queries.graph import _NODES
from tremor.queries.models import CHANNELS, _channel_bars
from tremor.queries.registry import ORACLE_SQL, once, query
from tremor.queries.state import STATE, TRIGGER, accounts, led, trigger_legs, trigger_report
from tremor.queries.streams import FINAL, final_sql, liquidation_stream, stream_score
from tremor.sources import adapter as A
from tremor.sources.adapter import cte
from tremor.streaming import alerts, live

_ORD = "block_number * 1000000 + log_index"
KEY = ["user", "block_number", "log_index"]


@query(
    cte("ledger")
    + f""", t as (select "user", block_number // 500 as tx, {_ORD} as ord, lag({_ORD}) over (partition by "user", block_number // 500 order by {_ORD}) as after from liq),
l as (select *, {_ORD} as ord, block_number // 500 as tx from ledger),
c as (select t."user", t.ord, least(t.ord, min(l.ord) filter (where l.ord > coalesce(t.after, -1))) as cut from t left join l on l."user" = t."user" and l.tx = t.tx group by t."user", t.ord)
select c."user", c.ord, r.reserve, round(coalesce(sum(d_collateral), 0), 6) + 0.0::double as collateral, round(coalesce(sum(d_debt), 0), 6) + 0.0::double as debt from c join (select distinct "user", reserve from ledger) r on c."user" = r."user" left join l on l."user" = c."user" and l.reserve = r.reserve and l.ord < c.cut group by c."user", c.ord, r.reserve"""
)
def position_before_log(spark, d):
    at, tx = (F.col("block_number") * 1000000 + F.col("log_index")).alias("ord"), F.floor(F.col("block_number") / 500).alias("tx")
    t = A.liquidations(spark, d).select("user", tx, at)
    t = t.withColumn("after", F.lag("ord").over(W.partitionBy("user", "tx").orderBy("ord")))
    got = S.positions_before(led(spark, d).select("user", "reserve", tx, at, "d_collateral", "d_debt"), t)
    return got.select("user", "ord", "reserve", *[(F.round(c, 6) + 0.0).alias(c) for c in ("collateral", "debt")])  # + 0.0: no negative zero


def _day_prices(rows, spark, d, block):
    """rows (with reserve) and `other`, the reserve's mean price on the block's day."""
    p = A.daily_prices(spark, d).select(F.col("asset").alias("reserve"), F.datediff("day", F.to_date(F.lit("2024-01-01"))).cast("long").alias("day"), F.col("price").alias("other"))
    return rows.withColumn("day", F.floor(block / 7200)).join(p, ["reserve", "day"], "left").drop("day")


_DAY = "(d.day - date '2024-01-01') = "
_OTHER = """, case when sum(b * coalesce(other, 0)) > 1e-12 then sum(c * coalesce(other, 0) * coalesce(threshold, 0)) / sum(b * coalesce(other, 0)) end as hf"""
_TRIGGER_DAILY = TRIGGER.replace(cte("ledger", "px", "reg", "toggles"), cte("ledger", "px", "reg", "toggles", "daily"))


@query(
    _TRIGGER_DAILY
    + f""", ol as (select tl.*, d.price as other from tl join rep using ("user", block_number, log_index) left join daily d on d.asset = tl.reserve and {_DAY} (tl.block_number - 1) // 7200 where mismatch_exact and rep.hf >= 2 and (abs(collateral) > 1e-9 or abs(debt) > 1e-9)),
oh as (select "user", block_number, log_index, bool_and(other is not null) as covered {_OTHER} from ol group by "user", block_number, log_index)
select rep."user", rep.block_number, rep.log_index, case when covered and oh.hf < 1 then oh.hf else rep.hf end as hf, mismatch and not coalesce(covered and oh.hf < 1, false) as mismatch from rep left join oh on rep."user" = oh."user" and rep.block_number = oh.block_number and rep.log_index = oh.log_index"""
)
def mismatch_override(spark, d):
    """The unexplained mismatches are judged again at the block before, by the other prices, where these cover all legs."""
    rep = trigger_report(spark, d)
    odd = rep.where("mismatch_exact and hf >= 2").select(*KEY)
    rows = trigger_legs(spark, d).join(odd, KEY, "left_semi").where("abs(collateral) > 1e-9 or abs(debt) > 1e-9")
    rows = _day_prices(rows, spark, d, F.col("block_number") - 1).withColumn("price", F.col("other"))
    new = S.health_factor(rows, KEY).join(rows.groupBy(*KEY).agg(F.bool_and(F.col("other").isNotNull()).alias("covered")), KEY).where("covered and hf < 1").select(*KEY, F.col("hf").alias("new"))
    out = rep.join(new, KEY, "left")
    return out.select(*KEY, F.coalesce("new", "hf").alias("hf"), (F.col("mismatch") & F.col("new").isNull()).alias("mismatch"))


@query(
    _TRIGGER_DAILY
    + f""", dh as (select "user", block_number, log_index, bool_and(not (c > 1e-12 or b > 1e-12) or other is not null) as covered {_OTHER} from (select tl.*, d.price as other from tl left join daily d on d.asset = tl.reserve and {_DAY} tl.block_number // 7200) group by "user", block_number, log_index)
select rep.block_number // 20000 as span, avg(case when rep.hf >= 1 then 1.0::double else 0 end) as log_rate, avg(case when dh.hf >= 1 then 1.0::double else 0 end) as daily_rate, count(*) as n
from rep join dh using ("user", block_number, log_index) where rep.fully_covered and dh.covered and rep.hf is not null and dh.hf is not null group by 1"""
)
def oracle_compare(spark, d):
    """Mismatch rates under both price sources, over the triggers that both cover, per span of blocks."""
    other = _day_prices(trigger_legs(spark, d), spark, d, F.col("block_number")).withColumn("price", F.col("other"))
    b = S.health_factor(other, KEY).where("fully_covered and hf is not null").select(*KEY, F.col("hf").alias("hf2"))
    both = trigger_report(spark, d).where("fully_covered and hf is not null").join(b, KEY)
    rate = lambda c: F.avg((F.col(c) >= 1).cast("double"))
    return both.groupBy(F.floor(F.col("block_number") / 20000).alias("span")).agg(rate("hf").alias("log_rate"), rate("hf2").alias("daily_rate"), F.count("*").alias("n"))


@query(
    _TRIGGER_DAILY
    + f""", dh as (select "user", block_number, log_index, bool_and(not (c > 1e-12 or b > 1e-12) or other is not null) as covered {_OTHER} from (select tl.*, d.price as other from tl left join daily d on d.asset = tl.reserve and {_DAY} tl.block_number // 7200) group by "user", block_number, log_index)
select rep."user", rep.block_number, rep.log_index, case when not mismatch_exact then 'none' when not rep.historical_reliable then 'param_drift' when not dh.covered then 'no_coverage' when dh.hf < 1 then 'oracle_lag' else 'unexplained' end as cause from rep join dh using ("user", block_number, log_index)"""
)
def mismatch_cause(spark, d):
    """Why a trigger's health factor is one or more: an unreliable threshold, legs that the second prices lack, a second
    health factor below one under those, or none of these."""
    other = _day_prices(trigger_legs(spark, d), spark, d, F.col("block_number")).withColumn("price", F.col("other"))
    second = S.health_factor(other, KEY).select(*KEY, F.col("hf").alias("hf2"), F.col("fully_covered").alias("covered"))
    cause = F.when(~F.col("mismatch_exact"), "none").when(~F.col("historical_reliable"), "param_drift").when(~F.col("covered"), "no_coverage").when(F.col("hf2") < 1, "oracle_lag")
    return trigger_report(spark, d).join(second, KEY).select(*KEY, cause.otherwise("unexplained").alias("cause"))


@query(
    STATE
    + """, o as (select "user", floor(collateral_usd * 0.97) as oc, floor(debt_usd * 1.01) + 1 as od, hf * 0.9 as ohf from hf where cast(substr("user", 2) as bigint) % 5 <> 0),
s as (select hf.*, oc, od, coalesce(ohf >= 1, true) as confirmed from hf join o on hf."user" = o."user" where hf.hf >= 1)
select count(*) as n, count(*) filter (where confirmed) as n_confirmed, avg((collateral_usd - oc) / oc) filter (where oc > 0 and not confirmed) as mean_collateral_diff, median((collateral_usd - oc) / oc) filter (where oc > 0 and not confirmed) as median_collateral_diff,
avg((debt_usd - od) / od) filter (where not confirmed) as mean_debt_diff, median((debt_usd - od) / od) filter (where not confirmed) as median_debt_diff from s"""
)
def onchain_crosscheck(spark, d):
    """Rebuilt accounts of a health factor of one or more against observed ones: how many these confirm, and by how much the rest differ."""
    mine = accounts(spark, d)
    seen = mine.where(F.substring("user", 2, 20).cast("long") % 5 != 0).select("user", F.floor(F.col("collateral_usd") * 0.97).alias("oc"), (F.floor(F.col("debt_usd") * 1.01) + 1).alias("od"), (F.col("hf") * 0.9).alias("ohf"))
    s = mine.where("hf >= 1").join(seen, "user").withColumn("confirmed", F.coalesce(F.col("ohf") >= 1, F.lit(True)))
    c = F.when(~F.col("confirmed") & (F.col("oc") > 0), (F.col("collateral_usd") - F.col("oc")) / F.col("oc"))
    b = F.when(~F.col("confirmed"), (F.col("debt_usd") - F.col("od")) / F.col("od"))
    return s.agg(F.count("*").alias("n"), F.count_if("confirmed").alias("n_confirmed"), F.avg(c).alias("mean_collateral_diff"), F.percentile(c, 0.5).alias("median_collateral_diff"), F.avg(b).alias("mean_debt_diff"), F.percentile(b, 0.5).alias("median_debt_diff"))


@query(
    (cte("grid") + BARS + STRESS).replace("with ", "with recursive ", 1).replace("stress as (", "stress as materialized (")
    + """, ends as materialized (select min(block_number) as lo, max(block_number) as hi from liq),
walk as (select lo as block from ends where hi > lo union all select block + case when exists (select 1 from stress where start_block < block + 25 and end_block > block) then 5 else 25 end from walk where block < (select hi from ends))
select block from walk where block < (select hi from ends)"""
)
def snapshot_anchors(spark, d):
    lo, hi = B.bounds(A.liquidations(spark, d))
    return anchors(stress_windows(spark, d), lo, hi)


#: Blocks of the snapshots (fixed values).
SNAPSHOTS = (40000, 80000, 120000, 160000)


@query(" union all ".join(f"select {b} as snapshot_block, * from ({_NODES.replace('<= 120000', f'<= {b}')} select * from nodes)" for b in SNAPSHOTS))
def graph_sequence(spark, d):
    """The whale and bucket nodes of several snapshots in one plan: balances, prices and toggles as of each block."""
    ledger = led(spark, d)
    at = F.explode(F.array(*[F.lit(b).cast("long") for b in SNAPSHOTS])).alias("block_number")
    pos = S.positions_at_many(ledger, ledger.select("user").distinct().select("user", at)).where("abs(collateral) > 1e-9 or abs(debt) > 1e-9")
    px = A.price_updates(spark, d).select(F.col("asset").alias("reserve"), "block_number", "ord", "price")
    prices = asof(px.select("reserve").distinct().select("reserve", at), px, ["reserve"], "block_number", ["ord", "price"]).select("reserve", "block_number", "price")
    rows = asof(pos, A.toggles(spark, d), ["user", "reserve"], "block_number", ["log_index", "enabled"]).drop("log_index", "block_number_r")
    reg = A.registry(spark).select(F.col("asset").alias("reserve"), F.col("liquidation_threshold").alias("threshold"))
    rows = rows.join(prices, ["reserve", "block_number"], "left").join(F.broadcast(reg), "reserve", "left")  # a row per asset
    p, c = F.coalesce("price", F.lit(0.0)), F.greatest("collateral", F.lit(0.0))
    legs = rows.select("block_number", "user", "reserve", F.round(c * p, 6).alias("c"), F.round(F.greatest("debt", F.lit(0.0)) * p, 6).alias("b"), F.round(c * p * F.coalesce("threshold", F.lit(0.0)), 6).alias("w"))
    largest = F.min_by("reserve", F.struct((-F.col("c")).alias("c"), "reserve"))
    users = legs.groupBy("block_number", "user").agg(F.sum("c").alias("c"), F.sum("b").alias("b"), F.sum("w").alias("w"), largest.alias("symbol"))
    top = users.withColumn("n", F.row_number().over(W.partitionBy("block_number").orderBy(F.desc("c"), "user"))).where("n <= 30").select("block_number", "user", F.lit(True).alias("whale"))
    users = users.join(top, ["block_number", "user"], "left")
    bucket = F.concat_ws(":", F.lit("bucket:p0"), "symbol", hf_band(F.when(F.col("b") > 1e-12, F.col("w") / F.col("b"))))
    g = users.withColumn("node_id", F.when(F.col("whale"), F.concat(F.lit("whale:"), "user")).otherwise(bucket)).groupBy(F.col("block_number").cast("int").alias("snapshot_block"), "node_id")
    g = g.agg(F.when(F.max("whale"), "whale").otherwise("bucket").alias("node_type"), F.sum("c").alias("c"), F.sum("b").alias("b"), F.sum("w").alias("w"), F.count("*").alias("n_positions"))
    return g.select("snapshot_block", "node_id", "node_type", F.round("c", 6).alias("collateral_usd"), F.round("b", 6).alias("debt_usd"), F.when(F.col("b") > 1e-12, F.round(F.col("w") / F.col("b"), 6)).alias("hf"), "n_positions")


_FRAGILE = ORACLE_SQL["graph_sequence"].join(["select snapshot_block, avg(case when hf >= 1.0 and hf < 1.25 then 1.0::double else 0 end) as fragility from (", ") where node_type = 'whale' group by snapshot_block"])
_COVARIATE = cte("grid") + BARS + SCORES + f""", fragile as ({_FRAGILE}), cov as (select s.i, s.r, f.fragility from scores s asof left join fragile f on s.block >= f.snapshot_block)"""


@once
def fragile_bars(spark, d):
    """Bars with r and the fragility of the last snapshot at or before their end: the share of whales with a health factor in [1, 1.25)."""
    risk = F.coalesce((F.col("hf") >= 1.0) & (F.col("hf") < 1.25), F.lit(False)).cast("double")
    per = graph_sequence(spark, d).where("node_type = 'whale'").groupBy(F.col("snapshot_block").cast("long").alias("block")).agg(F.avg(risk).alias("fragility"))
    return asof(score_table(spark, d).select("i", "block", "r"), per, [], "block", ["fragility"]).select("i", "r", "fragility")


@query(_COVARIATE + " select i, fragility from cov")
def fragility_asof(spark, d):
    return fragile_bars(spark, d).select("i", "fragility")


@query(_COVARIATE + f", z as (select *, coalesce((fragility - avg(fragility) over ()) / nullif(stddev_pop(fragility) over (), 0), 0) as z from cov) select i, {MU} * exp(0.1 * z) + {ALPHA} * r as lam_baseline, {ALPHA} * r + 0.01 * greatest(z, 0) as excitation from z")
def hawkes_covariate(spark, d):
    """The intensity with the standardised fragility in its base, and with its positive part as excitation; 0 where there is no snapshot yet."""
    s = fragile_bars(spark, d)
    st = s.agg(F.avg("fragility").alias("m"), F.stddev_pop("fragility").alias("s"))
    z = F.coalesce((F.col("fragility") - F.col("m")) / F.nullif("s", F.lit(0.0)), F.lit(0.0))
    s = s.crossJoin(F.broadcast(st)).withColumn("z", z)  # st is one row
    return s.select("i", (MU * F.exp(0.1 * F.col("z")) + ALPHA * F.col("r")).alias("lam_baseline"), (ALPHA * F.col("r") + 0.01 * F.greatest("z", F.lit(0.0))).alias("excitation"))


@query()
def hawkes_multi_fit(spark, d):
    m = multifit.fit_multi(_channel_bars(spark, d), CHANNELS)
    rows = [(c, m["mu"][k], m["alpha"][k], m["end"][k], m["beta"], m["nll"]) for k, c in enumerate(CHANNELS)]
    return spark.createDataFrame(rows, "channel string, mu double, alpha array<double>, r_end double, beta double, nll double")


@query()
def spectral_radius(spark, d):
    """The largest eigenvalue of alpha / beta, alpha being the fitted channel matrix: below one, the process dies out."""
    m = multifit.fit_multi(_channel_bars(spark, d), CHANNELS, betas=(0.05, 0.2), steps=8)
    return spark.createDataFrame([(hawkes.spectral_radius(m["alpha"], m["beta"]), float(m["beta"]))], "spectral_radius double, beta double")


_R = "coalesce(sum(b.n * exp(-0.05 * (a.bar - b.bar))), 0)"
_M = cte("liq") + f", m as (select protocol, block_number // 50 as bar, count(*) as n from liq where {final_sql(50)} group by all)"


@query(
    _M
    + f""", g as (select protocol, unnest(generate_series(min(bar), max(bar))) as bar from m group by protocol),
s as (select a.protocol, a.bar, 0.02 * {_R} / (0.05 + 0.02 * {_R}) as score from g a left join m b on a.protocol = b.protocol and b.bar < a.bar group by a.protocol, a.bar),
c as (select *, sum(case when score >= 0.6 then 1 else 0 end) over (partition by protocol order by bar rows between 19 preceding and current row) >= 5 as cond from s)
select protocol, bar, score from (select *, lag(cond) over (partition by protocol order by bar) as was from c) where cond and not coalesce(was, false)"""
)
def stream_alerts(spark, d):
    rows = liquidation_stream(spark, d).drop("block_number")
    return live.run_to_table(alerts.alert_bars(rows, 0.05, 0.02, 0.05, 50, 0.6, 5, 20, *FINAL), "alerts")


@query(
    _M
    + f""", s as (select case when max(block_number) > 100000 then (max(block_number) - 100000) // 50 else 0 end as first from ev), f as (select m.* from m, s where bar >= first)
select a.protocol, a.bar, any_value(a.n) as n, {_R} as r, 0.02 * {_R} / (0.05 + 0.02 * {_R}) as score from f a left join f b on a.protocol = b.protocol and b.bar < a.bar group by a.protocol, a.bar"""
)
def stream_catchup(spark, d):
    head = A.events(spark, d).agg(F.max("block_number").alias("b")).first().b or 0
    start, _ = alerts.catch_up_start(0, head, 100000, 50)
    rows = liquidation_stream(spark, d).where((F.col("block_number") >= start) & (F.col("block_number") <= head)).drop("block_number")
    return live.run_to_table(live.scored_bars(rows, 0.05, 0.02, 0.05, 50, *FINAL), "catchup")


@query("select s.protocol, n_bars, last_bar, last_score, 0.6::double as threshold, coalesce(n_alerts, 0) as n_alerts, last_alert from (select protocol, count(*) as n_bars, max(bar) as last_bar, arg_max(score, bar) as last_score from (SCORES) group by protocol) s left join (select protocol, count(*) as n_alerts, max(bar) as last_alert from (ALERTS) group by protocol) a using (protocol)".replace("SCORES", ORACLE_SQL["stream_score"]).replace("ALERTS", ORACLE_SQL["stream_alerts"]))
def monitor_status(spark, d):
    """Each protocol's state from the tables that the streams write: bars scored, the last one and its score, the threshold, alerts and the last one."""
    s = stream_score(spark, d).groupBy("protocol").agg(F.count("*").alias("n_bars"), F.max("bar").alias("last_bar"), F.max_by("score", "bar").alias("last_score"))
    a = stream_alerts(spark, d).groupBy("protocol").agg(F.count("*").alias("n_alerts"), F.max("bar").alias("last_alert"))
    out = s.join(a, "protocol", "left")
    return out.select("protocol", "n_bars", "last_bar", "last_score", F.lit(0.6).alias("threshold"), F.coalesce("n_alerts", F.lit(0)).alias("n_alerts"), "last_alert")

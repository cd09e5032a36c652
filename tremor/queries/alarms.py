"""Queries: alarms and their evaluation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremor.operators import intervals
from tremor.operators.bars import percentiles
from tremor.plans import evaluation as E
from tremor.plans import hawkes
from tremor.queries.cascades import _EPISODES, _LABELS, BARS, bar_table, primary_episodes
from tremor.queries.cascades import episodes as all_episodes
from tremor.queries.registry import once, query
from tremor.sources.adapter import cte
from tremor.sources.shared import saved

MU, ALPHA, BETA, CUT, LEAD = 0.05, 0.02, 0.05, 0.5, 2000
SCORES = f""", hist as (select b.i, coalesce(sum(m.n_liquidations * exp(-{BETA} * (b.i - m.i))), 0) as r from bars b left join bars m on m.i < b.i and m.n_liquidations > 0 group by b.i),
scores as (select i, end_block as block, n_liquidations, liquidated_usd, start_block, r, {MU} + {ALPHA} * r as lam, {ALPHA} * r / ({MU} + {ALPHA} * r) as score from bars join hist using (i)),
edges as (select i, block, score from (select *, lag(score) over (order by i) as before from scores) where score >= {CUT} and coalesce(before, -1) < {CUT}),
fires as (select i, block, score from (select *, sum(a) over (order by i rows between 9 preceding and current row) as n, coalesce(sum(a) over (order by i rows between 10 preceding and 1 preceding), 0) as m from (select *, (score >= {CUT})::int as a from scores)) where n >= 3 and m < 3)"""
EPS = ", eps as (select row_number() over (order by start_block, protocol) as ep, start_block, end_block, severity_usd, protocol from episodes)"
KINDS = f""", kinds as (select block, (select min(ep) from eps where block >= start_block - {LEAD} and block < start_block) as episode, case when exists (select 1 from eps where block >= start_block - {LEAD} and block < start_block) then 'true'
  when exists (select 1 from eps where block between start_block and end_block) then 'neither' else 'false' end as kind from edges)"""
ALL = cte("grid") + _EPISODES + BARS + SCORES + EPS + KINDS


@once
def score_table(spark, d):
    return hawkes.scored(bar_table(spark, d), MU, ALPHA, BETA).withColumn("block", F.col("end_block"))


@once
def episode_table(spark, d):
    w = W.orderBy("start_block", "protocol")  # episodes are few: a row per cascade
    return primary_episodes(spark, d).select(F.row_number().over(w).cast("long").alias("ep"), "start_block", "end_block", "severity_usd", "protocol")


def edges(spark, d):
    return intervals.rising_edges(score_table(spark, d), [], "i", F.col("score") >= CUT)


def fires(spark, d):
    return intervals.debounced(score_table(spark, d), [], "i", F.col("score") >= CUT, 3, 10)


@query(ALL + " select i, block, score from edges")
def rising_edge(spark, d):
    return edges(spark, d).select("i", "block", "score")


@query(ALL + " select i, block, score from fires")
def debounce(spark, d):
    return fires(spark, d).select("i", "block", "score")


@query(ALL + " select ep, min(block) as first_alarm from eps join fires on block >= start_block - 3000 and block <= end_block group by ep")
def first_alarm(spark, d):
    e = episode_table(spark, d).withColumn("lo", F.col("start_block") - 3000)
    return intervals.within_spans(fires(spark, d).select("block"), "block", e, "lo", "end_block").groupBy("ep").agg(F.min("block").alias("first_alarm"))


@query(ALL + " select * from kinds")
def classify_alerts(spark, d):
    return E.classify_alerts(edges(spark, d).select("block"), episode_table(spark, d), LEAD)


@query(ALL + f" select block, ep from fires left join eps on block between start_block - {LEAD} and end_block")
def classify_fires(spark, d):
    return E.classify_fires(fires(spark, d), episode_table(spark, d), LEAD)


@query(ALL + " select count(*) as alerts, count(*) filter (where kind = 'true') as true_alerts, count(*) filter (where kind = 'false') as false_alarms, count(*) filter (where kind = 'true') / nullif(count(*) filter (where kind <> 'neither'), 0) as precision, count(distinct episode) / (select count(*) from eps) as recall from kinds")
def precision_recall(spark, d):
    k, n = classify_alerts(spark, d), episode_table(spark, d).agg(F.count("*").alias("n"))
    g = k.agg(F.count("*").alias("alerts"), F.count_if(F.col("kind") == "true").alias("true_alerts"), F.count_if(F.col("kind") == "false").alias("false_alarms"), F.countDistinct("episode").alias("found"))
    return g.crossJoin(n).select("alerts", "true_alerts", "false_alarms", (F.col("true_alerts") / F.nullif(F.col("true_alerts") + F.col("false_alarms"), F.lit(0))).alias("precision"), (F.col("found") / F.nullif("n", F.lit(0))).alias("recall"))


@query(ALL + " select (select count(*) from kinds where kind = 'false') / ((max(end_block) - min(start_block)) / 50400.0::double) as far_per_week from bars")
def far_per_week(spark, d):
    span = bar_table(spark, d).agg(((F.max("end_block") - F.min("start_block")) / 50400.0).alias("weeks"))
    return classify_alerts(spark, d).agg(F.count_if(F.col("kind") == "false").alias("f")).crossJoin(span).select((F.col("f") / F.col("weeks")).alias("far_per_week"))


GRID = [round(0.05 * k, 2) for k in range(1, 20)]
SWEEP = f""", th as (select unnest([{", ".join(map(str, GRID))}])::double as threshold), sedges as (select threshold, block from th join (select *, coalesce(lag(score) over (order by i), -1) as before from scores) s on s.score >= threshold and s.before < threshold),
sk as (select threshold, block, (select min(ep) from eps where block >= start_block - {LEAD} and block < start_block) as episode, exists (select 1 from eps where block between start_block and end_block) as inside from sedges),
sweep as (select threshold, count(block) as alerts, count(episode) as true_alerts, count(*) filter (where block is not null and episode is null and not inside) as false_alarms, count(distinct episode) as detected from th left join sk using (threshold) group by threshold)"""


def sweep_table(spark, d):
    return E.sweep(score_table(spark, d), episode_table(spark, d), LEAD, GRID)


PAD, KS, DEBOUNCE = 3000, [1, 2, 3, 5, 8], 10
#: Every grid point's episodes, with those of the primary one marked, and the fires at each threshold and k.
EVERY = _LABELS + ", alleps as (select row_number() over (order by episode_id) as ep, start_block, end_block, is_primary from grid_episodes)"


def _sweep_sql(thresholds: list[float], ks: list[int]) -> str:
    return f""", th as (select unnest([{", ".join(map(str, thresholds))}])::double as threshold), ks as (select unnest({ks})::integer as k),
cnt as (select threshold, i, block, sum((score >= threshold)::int) over (partition by threshold order by i rows between {DEBOUNCE - 1} preceding and current row) as n, coalesce(sum((score >= threshold)::int) over (partition by threshold order by i rows between {DEBOUNCE} preceding and 1 preceding), 0) as m from th, (select i, block, score from scores)),
df as (select k, threshold, block from cnt, ks where n >= k and m < k),
ft as (select df.*, exists (select 1 from alleps where block between start_block - {LEAD} and end_block) as hit from df),
fc as (select k, threshold, count(*) as fires, count(*) filter (where not hit) as false_alarms from ft group by all),
fe as (select distinct k, threshold, ep, is_primary from df join alleps on block between start_block - {LEAD} and end_block),
fd as (select k, threshold, count(*) as detected, count(*) filter (where is_primary) as detected_primary from fe group by all),
fl as (select k, threshold, ep, max(start_block - block) as lead from df join alleps on is_primary and block >= start_block - {PAD} and block < start_block + {PAD} group by all),
fm as (select k, threshold, count(*) as n_leads, avg(lead) * 0.2 as mean_lead from fl group by all),
curve as (select k, threshold, coalesce(fires, 0) as fires, coalesce(false_alarms, 0) as false_alarms, coalesce(false_alarms, 0) / ((select max(block) - min(block) from scores) / 50400.0::double) as far_per_week,
   coalesce(detected, 0) / nullif((select count(*) from alleps), 0) as recall, coalesce(detected_primary, 0) / nullif((select count(*) filter (where is_primary) from alleps), 0) as recall_primary, coalesce(n_leads, 0) as n_leads, coalesce(mean_lead, 0) as mean_lead_min
   from ks cross join th left join fc using (k, threshold) left join fd using (k, threshold) left join fm using (k, threshold))"""


def curve_table(spark, d, thresholds, ks):
    """Rates of the debounced alarm for thresholds and k, judged by the episodes of all grid points."""
    eps = saved(all_episodes(spark, d).select(F.col("episode_id").alias("ep"), "start_block", "end_block", "is_primary"))
    s = score_table(spark, d).select("i", "block", "score")
    rows = E.debounced_sweep(s, eps, LEAD, thresholds, ks, DEBOUNCE, PAD)
    one = s.agg(((F.max("block") - F.min("block")) / 50400.0).alias("weeks")).crossJoin(eps.agg(F.count("*").alias("n"), F.count_if("is_primary").alias("n_primary")))  # one row each
    share = lambda a, b: (F.col(a) / F.nullif(b, F.lit(0)))
    return rows.crossJoin(F.broadcast(one)).select("k", "threshold", "fires", "false_alarms", (F.col("false_alarms") / F.col("weeks")).alias("far_per_week"), share("detected", "n").alias("recall"), share("detected_primary", "n_primary").alias("recall_primary"), "n_leads", F.col("mean_lead").alias("mean_lead_min"))


@query(cte("grid") + BARS + SCORES + EVERY + _sweep_sql(GRID, [3]) + " select * from curve")
def operating_curve(spark, d):
    return curve_table(spark, d, GRID, [3])


@query(ALL + SWEEP + """ select threshold, detected, false_alarms, true as feasible from sweep where false_alarms / ((select max(end_block) - min(start_block) from bars) / 50400.0::double) <= 20 order by detected desc, threshold limit 1""")
def recall_at_far(spark, d):
    span = bar_table(spark, d).agg(((F.max("end_block") - F.min("start_block")) / 50400.0).alias("weeks"))
    s = sweep_table(spark, d).crossJoin(span).withColumn("feasible", F.col("false_alarms") / F.col("weeks") <= 20)
    pick = F.struct(F.col("feasible").cast("int"), F.when(F.col("feasible"), F.col("detected")).otherwise(-F.col("false_alarms")), -F.col("threshold"))
    return s.agg(F.max_by(F.struct("threshold", "detected", "false_alarms", "feasible"), pick).alias("x")).select("x.*")


LEADS = [500, 1000, 2000, 4000]


@query(ALL + SWEEP + f""", hs as (select unnest({LEADS})::bigint as h),
hk as (select h, threshold, block, (select min(ep) from eps where block >= start_block - h and block < start_block) as episode, exists (select 1 from eps where block between start_block and end_block) as inside from sedges, hs),
ht as (select h, threshold, count(episode) as t, count(*) filter (where episode is null and not inside) as f, count(distinct episode) as e from hk group by all),
hb as (select h, threshold, e / (select count(*) from eps) as recall, t / nullif(t + f, 0) as prec, row_number() over (partition by h order by e desc, threshold) as n from ht where t / nullif(t + f, 0) >= 0.2 and e > 0)
select h as lead_blocks, threshold is not null as feasible, threshold, recall as best_recall, prec as precision from hs left join (select * from hb where n = 1) using (h)""")
def lead_frontier(spark, d):
    return E.lead_frontier(score_table(spark, d), episode_table(spark, d), LEADS, GRID, 0.2)


@query(ALL + " select ep, count(k.block) > 0 as detected, max(start_block - k.block) as earliest_lead from eps left join kinds k on k.episode = ep group by ep")
def per_episode(spark, d):
    k = classify_alerts(spark, d).where("episode is not null").select(F.col("episode").alias("ep"), "block")
    return episode_table(spark, d).join(k, "ep", "left").groupBy("ep").agg((F.count("block") > 0).alias("detected"), F.max(F.col("start_block") - F.col("block")).alias("earliest_lead"))


LABELS = ", y as (select i, score, n_liquidations, block, exists (select 1 from eps where start_block > block and start_block <= block + 500) as y from scores)"


def labelled(spark, d, h=500):
    e = episode_table(spark, d).select((F.col("start_block") - h).alias("lo"), (F.col("start_block") - 1).alias("hi"))
    s = score_table(spark, d)
    hit = intervals.within_spans(s.select("i", "block"), "block", e, "lo", "hi").select("i").distinct().withColumn("y", F.lit(True))
    return s.join(hit, "i", "left").withColumn("y", F.coalesce("y", F.lit(False)))


@query(ALL + LABELS + " select i, y from y")
def horizon_label(spark, d):
    return labelled(spark, d).select("i", "y")


@query(ALL + " select i, coalesce((select severity_usd from eps where start_block > block and start_block <= block + 500 order by start_block, ep limit 1), 0) as severity from scores")
def horizon_severity(spark, d):
    e = episode_table(spark, d).select("ep", "start_block", "severity_usd", (F.col("start_block") - 500).alias("lo"), (F.col("start_block") - 1).alias("hi"))
    s = score_table(spark, d).select("i", "block")
    near = intervals.within_spans(s, "block", e, "lo", "hi").groupBy("i").agg(F.min_by("severity_usd", F.struct("start_block", "ep")).alias("severity"))
    return s.select("i").join(near, "i", "left").select("i", F.coalesce("severity", F.lit(0.0)).alias("severity"))


@query(ALL + LABELS + ", g as (select round(score, 6) as score, sum(y::int) as tp, count(*) as n from y group by 1), c as (select tp, sum(tp) over w as ctp, sum(n) over w as cn, n from g window w as (order by score desc)) select sum(tp * ctp / cn) / sum(tp) as auprc, cast(sum(tp) as bigint) as positives, cast(sum(n) as bigint) as n from c")
def auprc(spark, d):
    return E.auprc(labelled(spark, d).withColumn("score", F.round("score", 6)), "score", "y")


@query(ALL + LABELS + " select avg(pow(score - y::int, 2)) as brier from y")
def brier(spark, d):
    return labelled(spark, d).agg(F.avg(F.pow(F.col("score") - F.col("y").cast("int"), F.lit(2))).alias("brier"))


@query(ALL + LABELS + " select cast(greatest(ceil(score * 10) - 1, 0) as bigint) as bin, avg(score) as predicted, avg(y::int) as observed, count(*) as n from y group by 1")
def calibration(spark, d):
    return E.calibration(labelled(spark, d), F.col("score"), F.col("y"), 10)


@query(ALL + " select avg(greatest(0.9 * (n_liquidations - lam), -0.1 * (n_liquidations - lam))) as pinball from scores")
def quantile_loss(spark, d):
    e = F.col("n_liquidations") - F.col("lam")
    return score_table(spark, d).agg(F.avg(F.greatest(0.9 * e, -0.1 * e)).alias("pinball"))


REPLICATES = 2000


def _boot_sql(protected: str) -> str:
    """p: each episode with the USD that counts for it; ci: the 95 % interval of their total over resamples."""
    return f""", p as (select ep - 1 as place, severity_usd, {protected} as hit from eps), x as (select place, case when hit then severity_usd else 0 end as x from p),
draws as (select b, cast('0x' || substr(md5(b || ':' || j), 1, 15) as bigint) % (select count(*) from p) as place from generate_series(0, {REPLICATES - 1}) t(b), generate_series(1, (select count(*) from p)) u(j)),
ci as (select round(quantile_cont(total, 0.025) + 1e-6, 2) as ci_low, round(quantile_cont(total, 0.975) + 1e-6, 2) as ci_high from (select b, sum(x) as total from draws join x using (place) group by b))
select coalesce(sum(severity_usd) filter (where hit), 0) as protectable_usd, count(*) filter (where hit) as n_protected, sum(severity_usd) as total_usd, count(*) as n_episodes, any_value(ci_low) as ci_low, any_value(ci_high) as ci_high from p, ci"""


def with_interval(eps, hit):
    """Total USD of the episodes in hit (ep), of all, and a percentile interval over resampled episodes."""
    rows = saved(eps.join(hit.select("ep").distinct().withColumn("hit", F.lit(True)), "ep", "left").select((F.col("ep") - 1).alias("place"), "severity_usd", F.coalesce("hit", F.lit(False)).alias("hit")))
    mine = F.when(F.col("hit"), F.col("severity_usd")).otherwise(0.0)
    ends = E.bootstrap_totals(rows.select("place", mine.alias("x")), REPLICATES, [0.025, 0.975]).select(*[F.round(F.col("p")[k] + 1e-6, 2).alias(n) for k, n in enumerate(("ci_low", "ci_high"))])  # to the cent, ties up
    sums = rows.agg(F.coalesce(F.sum(mine), F.lit(0.0)).alias("protectable_usd"), F.count_if("hit").alias("n_protected"), F.sum("severity_usd").alias("total_usd"), F.count("*").alias("n_episodes"))
    return sums.join(ends, F.lit(True), "left")  # one row each; without episodes there is no interval


@query(ALL + _boot_sql("ep in (select episode from kinds)"))
def usd_protectable(spark, d):
    return with_interval(episode_table(spark, d), classify_alerts(spark, d).where("episode is not null").select(F.col("episode").alias("ep")))


@query(ALL + _boot_sql(f"exists (select 1 from fires where block >= start_block - {LEAD} and block < start_block)"))
def protectable_in_time(spark, d):
    e = episode_table(spark, d).withColumn("lo", F.col("start_block") - LEAD).withColumn("hi", F.col("start_block") - 1)
    return with_interval(episode_table(spark, d), intervals.within_spans(fires(spark, d).select("block"), "block", e, "lo", "hi").select("ep"))


@query(ALL + ", f as (select ep, min(block) as alarm from eps join fires on block >= start_block - 3000 and block <= end_block group by ep) select ep, sum(amount_usd) filter (where block_number < alarm) as usd_before, sum(amount_usd) filter (where block_number >= alarm) as usd_after from eps join f using (ep) join liq on liq.protocol = eps.protocol and block_number between start_block and end_block group by ep")
def cost_timing(spark, d):
    from tremor.sources import adapter as A

    e = episode_table(spark, d).join(first_alarm(spark, d), "ep").select("ep", F.col("protocol").alias("p"), "start_block", "end_block", "first_alarm")
    q = intervals.within_spans(A.liquidations(spark, d), "block_number", e, "start_block", "end_block").where("p = protocol")
    early = F.col("block_number") < F.col("first_alarm")
    return q.groupBy("ep").agg(F.sum(F.when(early, F.col("amount_usd"))).alias("usd_before"), F.sum(F.when(~early, F.col("amount_usd"))).alias("usd_after"))


@query(ALL + """, t as (select ep, block_number, sum(amount_usd) over (partition by ep order by block_number range unbounded preceding) as cum, sum(amount_usd) over (partition by ep) as total from eps join liq on liq.protocol = eps.protocol and block_number between start_block and end_block),
h as (select ep, min(block_number) filter (where cum >= 0.5 * total) as half_block, max(total) as usd from t group by ep),
f as (select ep, min(block) as cross_block from eps join fires on block >= start_block - 3000 and block <= end_block group by ep)
select ep, cross_block, half_block, usd, start_block - cross_block as advance_blocks, cast(round((start_block - cross_block) / 5.0::double) as bigint) as advance_minutes, half_block - cross_block as lead_blocks, cast(round((half_block - cross_block) / 5.0::double) as bigint) as lead_minutes
from eps join h using (ep) left join f using (ep)""")
def lead_metrics(spark, d):
    """How long before an episode's start, and before half its USD, its first debounced alarm fires; null without one."""
    from tremor.sources import adapter as A

    e = episode_table(spark, d).select("ep", F.col("protocol").alias("p"), "start_block", "end_block")
    q = intervals.within_spans(A.liquidations(spark, d), "block_number", e, "start_block", "end_block").where("p = protocol")
    per = q.groupBy("ep", "start_block", "block_number").agg(F.sum("amount_usd").alias("u"))
    w = W.partitionBy("ep")
    per = per.withColumn("cum", F.sum("u").over(w.orderBy("block_number").rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("u").over(w))
    half = per.groupBy("ep", "start_block").agg(F.min(F.when(F.col("cum") >= 0.5 * F.col("total"), F.col("block_number"))).alias("half_block"), F.max("total").alias("usd"))
    out = half.join(first_alarm(spark, d).withColumnRenamed("first_alarm", "cross_block"), "ep", "left")
    advance, lead = F.col("start_block") - F.col("cross_block"), F.col("half_block") - F.col("cross_block")
    minutes = lambda c: F.round(c / 5.0).cast("long")  # noqa: E731  blocks of 12 seconds
    return out.select("ep", "cross_block", "half_block", "usd", advance.alias("advance_blocks"), minutes(advance).alias("advance_minutes"), lead.alias("lead_blocks"), minutes(lead).alias("lead_minutes"))


@query(ALL + ", s as (select ep, block_number, amount_usd from eps join liq on liq.protocol = eps.protocol and block_number between start_block and end_block) select e.ep, b.i, coalesce(sum(s.amount_usd), 0) as cum_usd, count(s.ep) as cum_n from eps e join bars b on b.end_block between e.start_block and e.end_block left join s on s.ep = e.ep and s.block_number <= b.end_block group by all")
def cumulative_cost(spark, d):
    from tremor.operators.asof import asof_join
    from tremor.sources import adapter as A

    e = episode_table(spark, d).select("ep", F.col("protocol").alias("p"), "start_block", F.col("end_block").alias("last_block"))
    b = intervals.within_spans(bar_table(spark, d).select("i", "end_block"), "end_block", e, "start_block", "last_block").select("ep", "i", "end_block")
    q = intervals.within_spans(A.liquidations(spark, d), "block_number", e, "start_block", "last_block").where("p = protocol")
    per = q.groupBy("ep", F.col("block_number").alias("end_block")).agg(F.sum("amount_usd").alias("u"), F.count("*").alias("c"))
    w = W.partitionBy("ep").orderBy("end_block").rowsBetween(W.unboundedPreceding, 0)
    run = per.select("ep", "end_block", F.sum("u").over(w).alias("cum_usd"), F.sum("c").over(w).alias("cum_n"))
    return asof_join(b, run, ["ep"], "end_block", ["cum_usd", "cum_n"]).select("ep", "i", F.coalesce("cum_usd", F.lit(0.0)).alias("cum_usd"), F.coalesce("cum_n", F.lit(0)).alias("cum_n"))


@query(ALL + " select cast(date_trunc('month', to_timestamp(1704067200 + block * 12) at time zone 'UTC') as date) as month, count(*) as false_alarms from kinds where kind = 'false' group by 1")
def false_alarms_monthly(spark, d):
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("block") * 12)
    return classify_alerts(spark, d).where("kind = 'false'").groupBy(F.trunc(ts.cast("date"), "month").alias("month")).agg(F.count("*").alias("false_alarms"))


@query(cte("grid") + BARS + SCORES + EVERY + f""", x as (select block // 50400 as week, exists (select 1 from alleps where block >= start_block - {LEAD} and block <= end_block) as hit from edges),
a as (select block // 50400 as week, count(*) as bars, count(*) filter (where score >= {CUT}) / count(*) as alarming, count(*) * (select bw from grid) / 50400.0::double as weeks from scores group by 1),
f as (select week, count(*) filter (where not hit) as f from x group by 1), e as (select start_block // 50400 as week, count(*) as e from alleps group by 1),
w as (select week, weeks, bars, alarming, coalesce(f, 0) as false_alarms, coalesce(e, 0) as labelled, coalesce(e, 0) > 0 as in_sample from a left join f using (week) left join e using (week))
select week, weeks, bars, alarming, false_alarms, false_alarms / weeks as far_per_week, labelled, in_sample from w
union all select null, coalesce(sum(weeks), 0), coalesce(sum(bars), 0)::bigint, null, coalesce(sum(false_alarms), 0)::bigint, sum(false_alarms) / sum(weeks), 0, false from w where not in_sample""")
def far_by_year(spark, d):
    """False alarms by period, which is a week as the tables span a month, with those of labelled episodes marked; the last row pools the
    periods without labels. An alarm is false outside the windows of the episodes of all grid points."""
    from tremor.sources import adapter as A

    week = lambda c: F.floor(F.col(c) / 50400).alias("week")
    eps = saved(all_episodes(spark, d).select(F.col("episode_id").alias("ep"), "start_block", "end_block"))
    s = score_table(spark, d).groupBy(week("block")).agg(F.count("*").alias("bars"), (F.count_if(F.col("score") >= CUT) / F.count("*")).alias("alarming"))
    f = E.classify_alerts(edges(spark, d).select("block"), eps, LEAD).where("kind = 'false'").groupBy(week("block")).agg(F.count("*").alias("f"))
    e = eps.groupBy(week("start_block")).agg(F.count("*").alias("e"))
    rows = s.join(f, "week", "left").join(e, "week", "left").select("week", (F.col("bars") * A.BAR / 50400.0).alias("weeks"), "bars", "alarming", F.coalesce("f", F.lit(0)).alias("false_alarms"), F.coalesce("e", F.lit(0)).alias("labelled"))
    rows = saved(rows.withColumn("in_sample", F.col("labelled") > 0))
    none = lambda t: F.lit(None).cast(t)
    pooled = rows.where("not in_sample").agg(F.coalesce(F.sum("weeks"), F.lit(0.0)).alias("weeks"), F.coalesce(F.sum("bars"), F.lit(0)).alias("bars"), F.coalesce(F.sum("false_alarms"), F.lit(0)).alias("false_alarms"))
    pooled = pooled.select(none("long").alias("week"), "weeks", "bars", none("double").alias("alarming"), "false_alarms", F.lit(0).cast("long").alias("labelled"), F.lit(False).alias("in_sample"))
    return rows.unionByName(pooled).withColumn("far_per_week", F.col("false_alarms") / F.nullif("weeks", F.lit(0.0)))


@query(cte("grid") + BARS + SCORES + EVERY + _sweep_sql([CUT], KS) + " select * exclude (threshold) from curve")
def debounce_sweep(spark, d):
    """Every k in one pass at the deployed threshold."""
    return curve_table(spark, d, [CUT], KS).drop("threshold")


@query(ALL + " select (max(end_block) - min(start_block)) / 50400.0::double as weeks, floor((max(end_block) - min(start_block)) / 50400.0::double * 5)::bigint as allowed, (select count(*) from kinds where kind = 'false') <= floor((max(end_block) - min(start_block)) / 50400.0::double * 5) as within_budget from bars")
def far_budget(spark, d):
    f = classify_alerts(spark, d).agg(F.count_if(F.col("kind") == "false").alias("f"))
    b = bar_table(spark, d).agg(((F.max("end_block") - F.min("start_block")) / 50400.0).alias("weeks"))
    allowed = F.floor(F.col("weeks") * 5)
    return b.crossJoin(f).select("weeks", allowed.alias("allowed"), (F.col("f") <= allowed).alias("within_budget"))


@query(cte("grid") + BARS + " select i, coalesce(sum(n_liquidations) over (order by i rows between 20 preceding and 1 preceding), 0)::bigint as score from bars")
def rolling_count(spark, d):
    return intervals.trailing(bar_table(spark, d), [], "i", 20, score=lambda w: F.coalesce(F.sum("n_liquidations").over(w.rowsBetween(-20, -1)), F.lit(0))).select("i", "score")


@query(cte("grid") + BARS + " select i, n_liquidations as score from bars")
def raw_count(spark, d):
    return bar_table(spark, d).select("i", F.col("n_liquidations").alias("score"))


@query(cte("grid") + BARS + " select b.i, coalesce(sum((1 - pow(0.5, 0.1)) * m.n_liquidations * pow(0.5, 0.1 * (b.i - m.i - 1))), 0) as score from bars b left join bars m on m.i < b.i and m.n_liquidations > 0 group by b.i")
def ewma_rate(spark, d):
    import math

    from tremor.operators.recurrence import decayed_history

    b = bar_table(spark, d).withColumn("m", F.col("n_liquidations").cast("double"))
    keep = 0.5**0.1
    return decayed_history(b, [], "i", "m", -math.log(keep), "r").select("i", (F.col("r") * ((1 - keep) / keep)).alias("score"))


@query(ALL + """, k as (select block // 50400 as fold, count(*) as n_test from scores group by 1), e as (select start_block // 50400 as fold, count(*) as n_episodes from eps group by 1),
r as (select fold, fold * 50400 as train_end, coalesce(sum(n_test) over (order by fold rows between unbounded preceding and 1 preceding), 0)::bigint as n_train, n_test from k)
select fold, train_end, n_train, n_test, coalesce(n_episodes, 0) as n_test_episodes from r left join e using (fold) where n_train > 0""")
def walk_forward_folds(spark, d):
    """Expanding folds of a week after a seed week: all bars before it train, those within it test."""
    return folds(score_table(spark, d), episode_table(spark, d), 50400)


def folds(bars, eps, width):
    """(fold, train_end, n_train, n_test, n_test_episodes) of bars by `block`. A bar without a block is an error, as it has no fold."""
    if bars.where("block is null").limit(1).count():
        raise ValueError("a bar has no block")
    part = lambda c: F.floor(F.col(c) / width).alias("fold")
    n = bars.groupBy(part("block")).agg(F.count("*").alias("n_test"))
    before = F.coalesce(F.sum("n_test").over(W.orderBy("fold").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per fold
    e = eps.groupBy(part("start_block")).agg(F.count("*").alias("n_test_episodes"))
    n = n.withColumn("n_train", before).where("n_train > 0").join(e, "fold", "left")
    return n.select("fold", (F.col("fold") * width).alias("train_end"), "n_train", "n_test", F.coalesce("n_test_episodes", F.lit(0)).alias("n_test_episodes"))


#: Name, end of training, and span of the test, of the named hold-outs.
HOLDOUTS = [("h1", 40000, 50000, 60000), ("h2", 60000, 80000, 90000), ("h3", 100000, 100000, 130000), ("h4", 150000, 160000, 190000)]


@query(ALL + ", h as (select * from (values " + ", ".join(map(str, HOLDOUTS)) + ") v(name, train_end, lo, hi)) select name, count(*) filter (where block < train_end) as n_train, count(*) filter (where block between lo and hi) as n_test, (select count(*) from eps where start_block between lo and hi) as n_episodes from scores, h group by name, lo, hi")
def episode_holdouts(spark, d):
    """Bars of each hold-out's training and test, and its episodes, counted in one pass over bars and one over episodes."""
    counts = [F.struct(F.lit(n).alias("name"), F.count_if(F.col("block") < end).alias("n_train"), F.count_if(F.col("block").between(lo, hi)).alias("n_test")) for n, end, lo, hi in HOLDOUTS]
    found = [F.struct(F.lit(n).alias("name"), F.count_if(F.col("start_block").between(lo, hi)).alias("n_episodes")) for n, _, lo, hi in HOLDOUTS]
    s = score_table(spark, d).agg(F.array(*counts).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return s.join(episode_table(spark, d).agg(F.array(*found).alias("x")).select(F.explode("x").alias("x")).select("x.*"), "name")


POINTS = [k / 199 for k in range(200)]


@query(ALL + " select distinct unnest(quantile_cont(score, [" + ", ".join(map(repr, POINTS)) + "])) as threshold from scores")
def threshold_grid(spark, d):
    """The distinct ones of 200 quantiles of the score."""
    return percentiles(score_table(spark, d), [], "score", POINTS).select(F.explode("p").alias("threshold")).distinct()


@query(ALL + " select ep, i from (select ep, i, row_number() over (partition by ep order by i) - 1 as n, count(*) over (partition by ep) as c from eps join bars on end_block between start_block_ and end_block_) where c <= 8 or n % cast(ceil(c / 8.0) as bigint) = 0".replace("from eps join bars on", "from (select ep, start_block as start_block_, end_block as end_block_ from eps) e join bars on"))
def preview(spark, d):
    e = episode_table(spark, d).select("ep", F.col("start_block").alias("s"), F.col("end_block").alias("e"))
    b = intervals.within_spans(bar_table(spark, d).select("i", "end_block"), "end_block", e, "s", "e")
    w = W.partitionBy("ep")
    b = b.withColumn("n", F.row_number().over(w.orderBy("i")) - 1).withColumn("c", F.count("*").over(w))
    return b.where((F.col("c") <= 8) | (F.col("n") % F.ceil(F.col("c") / 8) == 0)).select("ep", "i")

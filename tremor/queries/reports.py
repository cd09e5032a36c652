"""Queries: calibration, out-of-fold scores and summary reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremor.operators import intervals
from tremor.operators.bars import percentiles, ranked
from tremor.plans import evaluation as E
from tremor.plans import hawkes
from tremor.queries.alarms import ALL, CUT, GRID, LABELS, LEAD, auprc, episode_table, labelled, per_episode, score_table
from tremor.queries.cascades import bar_table
from tremor.queries.registry import query
from tremor.sources.shared import saved

_TUNE = f""", ls as (select ep, block, round(score, 6) as score from eps join scores on block >= eps.start_block - {LEAD} and block < eps.start_block),
pe as (select ep, max(score) as peak, arg_min(score, block) filter (where score >= {CUT}) as v0 from ls group by ep)"""


def lead_scores(spark, d):
    e = episode_table(spark, d).select("ep", "start_block", (F.col("start_block") - LEAD).alias("lo"), (F.col("start_block") - 1).alias("hi"))
    s = score_table(spark, d).select("block", F.round("score", 6).alias("score"))
    return intervals.within_spans(s, "block", e, "lo", "hi").select("ep", "start_block", "block", "score")


@query(ALL + _TUNE + f" select coalesce(min(v0), {CUT}) as lead_preserving, coalesce(min(peak) filter (where v0 is not null), {CUT}) as max_cut, count(v0) as n_detected from pe")
def tune_threshold(spark, d):
    above = F.col("score") >= CUT
    per = lead_scores(spark, d).groupBy("ep").agg(F.max("score").alias("peak"), F.min_by(F.when(above, F.col("score")), F.when(above, F.col("block"))).alias("v0"))
    return per.agg(F.coalesce(F.min("v0"), F.lit(CUT)).alias("lead_preserving"), F.coalesce(F.min(F.when(F.col("v0").isNotNull(), F.col("peak"))), F.lit(CUT)).alias("max_cut"), F.count("v0").alias("n_detected"))


_CURVE = """, g as (select round(score, 6) as score, sum(y::int) as tp, count(*) as n from y group by 1), c as (select sum(tp) over w as ctp, sum(n) over w as cn, (select sum(tp) from g) as total, (select count(*) from g) as points from g window w as (order by score desc)),
b as (select *, case when points > 400 then (ctp * 399 + total - 1) // total else cn end as slot from c where total > 0)"""


@query(ALL + LABELS + _CURVE + " select arg_min(ctp / total, (ctp, cn)) as recall, arg_min(ctp / cn, (ctp, cn)) as precision from b group by slot")
def pr_curve(spark, d):
    """One point a score, or, past 400 of them, the first of each of 399 equal steps of recall."""
    g = labelled(spark, d).groupBy(F.round("score", 6).alias("score")).agg(F.sum(F.col("y").cast("long")).alias("tp"), F.count("*").alias("n"))
    g = g.withColumn("cell", F.floor(F.col("score") * 256))
    cells = g.groupBy("cell").agg(F.sum("tp").alias("tp0"), F.sum("n").alias("n0"), F.count("*").alias("c"))
    down = W.orderBy(F.desc("cell"))  # as many rows as there are cells
    every = W.partitionBy(F.lit(1))
    cells = cells.select("cell", (F.sum("tp0").over(down) - F.col("tp0")).alias("tp0"), (F.sum("n0").over(down) - F.col("n0")).alias("n0"), F.sum("tp0").over(every).alias("total"), F.sum("c").over(every).alias("points"))
    w = W.partitionBy("cell").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    p = g.join(cells, "cell").withColumn("ctp", F.col("tp0") + F.sum("tp").over(w)).withColumn("cn", F.col("n0") + F.sum("n").over(w)).where("total > 0")
    slot = F.when(F.col("points") > 400, F.floor((F.col("ctp") * 399 + F.col("total") - 1) / F.col("total"))).otherwise(F.col("cn"))
    return p.groupBy(slot.alias("slot")).agg(F.min_by(F.struct((F.col("ctp") / F.col("total")).alias("recall"), (F.col("ctp") / F.col("cn")).alias("precision")), F.struct("ctp", "cn")).alias("x")).select("x.*")


@query(ALL + LABELS + """, g as (select round(score, 6) as score, sum(y::int) as tp, count(*) as n from y group by 1), c as (select tp, sum(tp) over w as ctp, sum(n) over w as cn, n from g window w as (order by score desc)), a as (select sum(tp * ctp / cn) / sum(tp) as auprc, cast(sum(tp) as bigint) as positives, sum(tp) / sum(n) as prevalence from c)
select auprc, prevalence, auprc / prevalence as lift, positives, (select count(*) from eps where start_block between (select min(start_block) from bars) and (select max(end_block) from bars)) as n_episodes from a""")
def baseline_report(spark, d):
    b = bar_table(spark, d).agg(F.min("start_block").alias("a"), F.max("end_block").alias("b"))
    n = episode_table(spark, d).crossJoin(F.broadcast(b)).where("start_block between a and b").agg(F.count("*").alias("n_episodes"))  # b is one row
    share = F.col("positives") / F.col("n")
    return auprc(spark, d).crossJoin(n).select("auprc", share.alias("prevalence"), (F.col("auprc") / share).alias("lift"), "positives", "n_episodes")


_PAD = 300


@query(ALL + f""", top as (select arg_max(struct_pack(ep := ep, s := start_block, e := end_block), (severity_usd, -ep)) as t, protocol from eps group by protocol)
select top.protocol, t.ep as ep, (select max(score) from scores where block between t.s - {_PAD} and t.e + {_PAD}) as peak, (select quantile_cont(score, 0.999) from scores) as level from top""")
def cross_protocol_peak(spark, d):
    top = episode_table(spark, d).groupBy("protocol").agg(F.max_by(F.struct("ep", "start_block", "end_block"), F.struct("severity_usd", -F.col("ep"))).alias("t"))
    top = top.select("protocol", "t.ep", (F.col("t.start_block") - _PAD).alias("lo"), (F.col("t.end_block") + _PAD).alias("hi"))
    s = score_table(spark, d)
    peak = intervals.within_spans(s.select("block", "score"), "block", top, "lo", "hi").groupBy("protocol").agg(F.max("score").alias("peak"))
    level = percentiles(s, [], "score", [0.999]).select(F.col("p")[0].alias("level"))
    return top.select("protocol", "ep").join(peak, "protocol", "left").crossJoin(level).select("protocol", "ep", "peak", "level")


@query(ALL + """, y2 as (select p.protocol, i, score, exists (select 1 from eps where eps.protocol = p.protocol and start_block > block and start_block <= block + 500) as y from scores, (select distinct protocol from eps) p),
g as (select protocol, round(score, 6) as score, sum(y::int) as tp, count(*) as n from y2 group by all), c as (select protocol, tp, n, sum(tp) over w as ctp, sum(n) over w as cn from g window w as (partition by protocol order by score desc)),
a as (select protocol, sum(tp * ctp / cn) / nullif(sum(tp), 0) as auprc, sum(tp) / sum(n) as prevalence from c group by protocol),
e as (select protocol, count(*) as n_episodes, count(*) filter (where ep in (select episode from kinds)) as n_detected from eps group by protocol)
select protocol, n_episodes, n_detected, prevalence, auprc, auprc / nullif(prevalence, 0) as lift, (select min(score) from scores) as n_t_min, (select max(score) from scores) as n_t_max from e join a using (protocol)""")
def multiprotocol_summary(spark, d):
    """A row per protocol: its episodes detected, the score's precision against its own episodes, lift over prevalence, and the score's range."""
    s = score_table(spark, d)
    eps = episode_table(spark, d)
    spans = eps.select("protocol", (F.col("start_block") - 500).alias("lo"), (F.col("start_block") - 1).alias("hi"))
    hit = intervals.within_spans(s.select("i", "block"), "block", spans, "lo", "hi").select("protocol", "i").distinct().withColumn("y", F.lit(True))
    each = s.select("i", F.round("score", 6).alias("score")).join(F.broadcast(eps.select("protocol").distinct()))  # a row per protocol
    rows = each.join(hit, ["protocol", "i"], "left").withColumn("y", F.coalesce("y", F.lit(False)))
    a = E.auprc(rows, "score", "y", by=["protocol"]).select("protocol", (F.col("positives") / F.col("n")).alias("prevalence"), "auprc")
    span = s.agg(F.min("score").alias("n_t_min"), F.max("score").alias("n_t_max"))
    n = eps.select("ep", "protocol").join(per_episode(spark, d), "ep").groupBy("protocol").agg(F.count("*").alias("n_episodes"), F.count_if("detected").alias("n_detected"))
    lift = (F.col("auprc") / F.nullif("prevalence", F.lit(0.0))).alias("lift")
    return n.join(a, "protocol").crossJoin(span).select("protocol", "n_episodes", "n_detected", "prevalence", "auprc", lift, "n_t_min", "n_t_max")  # span is one row


_FRONTIER = _TUNE.replace("pe as", f"""vals as (select score, row_number() over (order by score) - 1 as place, count(*) over () as n from (select distinct score from ls where score >= {CUT})),
th as (select score as threshold from vals where n <= 14 or place in (select cast(floor(k * (n - 1) / 13.0::double) as bigint) from (select unnest(generate_series(0, 13)) as k))),
rs as (select i, block, round(score, 6) as score, coalesce(lag(round(score, 6)) over (order by i), -1) as before from scores),
ed as (select threshold, block from th join rs on score >= threshold and before < threshold),
fa as (select threshold, count(*) as n from ed where not exists (select 1 from eps where block >= start_block - {LEAD} and block <= end_block) group by threshold),
pe as""").rstrip()


@query(ALL + _FRONTIER + """ select th.threshold, count(distinct ls.ep) / (select count(*) from eps) as recall, min(x.lead) as min_lead, coalesce(any_value(fa.n), 0) / ((select max(block) - min(block) from scores) / 50400.0::double) as far_per_week
from th left join ls on ls.score >= th.threshold left join (select threshold, ep, max(start_block - block) as lead from th join ls on score >= threshold join eps using (ep) group by all) x on x.threshold = th.threshold left join fa on fa.threshold = th.threshold group by th.threshold""")
def threshold_frontier(spark, d):
    """Up to 14 of the scores seen in the lead windows, each as a threshold: recall, least lead and false alarms a week."""
    lead = saved(lead_scores(spark, d))
    vals = ranked(lead.where(F.col("score") >= CUT).select("score").distinct(), "score")
    n = vals.count()
    at = sorted({k * (n - 1) // 13 for k in range(14)}) if n > 14 else list(range(n))
    grid = [r.score for r in vals.where(F.col("place").isin(at)).orderBy("score").collect()]  # 14 at most
    s = score_table(spark, d).select("i", "block", F.round("score", 6).alias("score"))
    eps = episode_table(spark, d)
    rows = E.sweep(s, eps, LEAD, grid).select("threshold", "false_alarms")
    above = lead.withColumn("threshold", F.explode(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: t <= F.col("score"))))
    best = above.groupBy("threshold", "ep").agg(F.max(F.col("start_block") - F.col("block")).alias("lead")).groupBy("threshold").agg(F.count("*").alias("found"), F.min("lead").alias("min_lead"))
    span = s.agg(((F.max("block") - F.min("block")) / 50400.0).alias("weeks")).crossJoin(eps.agg(F.count("*").alias("n")))  # one row each
    out = rows.join(best, "threshold", "left").crossJoin(span)
    return out.select("threshold", (F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall"), "min_lead", (F.col("false_alarms") / F.col("weeks")).alias("far_per_week"))


WEEK = 50400


def out_of_fold(spark, d):
    """Bars scored with the fit of all weeks before their own; the first week stays null. All weeks are fitted side by side and scored in one pass."""
    bars = bar_table(spark, d).withColumn("fold", F.floor(F.col("start_block") / WEEK).cast("int"))
    per = {r.fold: r.n for r in bars.groupBy("fold").agg(F.count("*").alias("n")).collect()}  # a row a week
    first = min(per, default=0)
    events = bars.where("n_liquidations > 0").select("i", F.col("n_liquidations").cast("double").alias("m"), "fold")
    fits = hawkes.fit_folds(events, {f: sum(n for k, n in per.items() if k < f) for f in per if f > first})
    seed = bars.where(F.col("fold") == first).select("i", "fold", "end_block", F.lit(None).cast("double").alias("score"))
    return seed.unionByName(hawkes.scored_folds(bars, fits).select("i", "fold", "end_block", "score"))


@query()
def oof_scores(spark, d):
    return out_of_fold(spark, d).select("i", "fold", "score")


@query()
def calibrate(spark, d):
    """The threshold of most detected episodes with at most 20 false alarms a week out of fold, and the share of bars it alarms on."""
    s = out_of_fold(spark, d).where("score is not null").withColumnRenamed("end_block", "block")
    span = s.agg(((F.max("block") - F.min("block")) / float(WEEK)).alias("weeks"))
    rows = E.sweep(s, episode_table(spark, d), LEAD, GRID).crossJoin(span).withColumn("far_per_week", F.col("false_alarms") / F.col("weeks")).withColumn("feasible", F.col("far_per_week") <= 20)
    best = rows.agg(F.max_by(F.struct("threshold", "detected", "far_per_week", "feasible"), F.struct(F.col("feasible").cast("int"), F.when(F.col("feasible"), F.col("detected").cast("double")).otherwise(-F.col("far_per_week")), -F.col("threshold"))).alias("x")).select("x.*")
    share = s.crossJoin(F.broadcast(best)).groupBy("threshold", "detected", "far_per_week", "feasible").agg((F.count_if(F.col("score") >= F.col("threshold")) / F.count("*")).alias("alarming"))  # best is one row
    return share

"""Queries: cascade labels, intervals and bars."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremor.operators import bars as B
from tremor.operators import intervals
from tremor.operators.asof import asof_join
from tremor.plans import cascades
from tremor.queries.registry import once, query
from tremor.sources import adapter as A
from tremor.sources.adapter import cte
from tremor.sources.shared import saved, shared_folder

_STATS = """, near as (select a.protocol, a.block_number as b, a.log_index as l, x.block_number, x.log_index, x."user", x.position_id, x.amount_usd, coalesce(x.collateral_asset, 'unknown') as asset,
   lag(x.block_number) over (partition by a.protocol, a.block_number, a.log_index, coalesce(x.collateral_asset, 'unknown') order by x.block_number, x.log_index) as prev
   from liq a join liq x on a.protocol = x.protocol and (x.block_number, x.log_index) >= (a.block_number, a.log_index) and x.block_number < a.block_number + (select w from grid)),
waves as (select protocol, b, l, asset, count(*) filter (where prev is null or block_number - prev > (select lag from grid)) as n from near group by all),
stats as (select protocol, b as block_number, l as log_index, sum(amount_usd) as sum_usd, count(distinct position_id) as n_positions, count(distinct "user") as n_users, max(block_number) as last_block,
   (select max(n) from waves where waves.protocol = near.protocol and waves.b = near.b and waves.l = near.l) as generations from near group by all)"""
_EPISODES = _STATS + """, theta as (select protocol, quantile_cont(sum_usd, 0.95) as t from stats group by all),
hits as (select protocol, block_number as s, last_block as e from stats join theta using (protocol) where sum_usd >= t and n_positions >= 5 and n_users >= 2 and generations >= 2),
isl as (select *, sum(case when p is null or s > p then 1 else 0 end) over (partition by protocol order by s, e rows unbounded preceding) as g from (select *, max(e) over (partition by protocol order by s, e rows between unbounded preceding and 1 preceding) as p from hits)),
spans as (select protocol, min(s) as start_block, max(e) as end_block, count(*) as n from isl group by protocol, g),
episodes as (select p.protocol, start_block, end_block, count(*) as n_events, sum(amount_usd) as severity_usd, count(distinct position_id) as n_positions, count(distinct "user") as n_users
  from spans p join liq l on l.protocol = p.protocol and l.block_number between start_block and end_block group by all)"""


_LABELS = f""", ws as (select unnest([{", ".join(map(str, A.WIDTHS))}])::bigint as w),
near as (select w, a.protocol, a.block_number as b, a.log_index as l, x.block_number, x."user", x.position_id, x.amount_usd, coalesce(x.collateral_asset, 'unknown') as asset,
   lag(x.block_number) over (partition by w, a.protocol, a.block_number, a.log_index, coalesce(x.collateral_asset, 'unknown') order by x.block_number, x.log_index) as prev
   from ws, liq a join liq x on a.protocol = x.protocol and (x.block_number, x.log_index) >= (a.block_number, a.log_index) and x.block_number < a.block_number + {max(A.WIDTHS)} where x.block_number < a.block_number + w),
waves as (select w, protocol, b, l, asset, count(*) filter (where prev is null or block_number - prev > {A.LAG}) as n from near group by all),
stats as (select w, protocol, b as block_number, l as log_index, sum_usd, n_positions, n_users, last_block, generations from
   (select w, protocol, b, l, sum(amount_usd) as sum_usd, count(distinct position_id) as n_positions, count(distinct "user") as n_users, max(block_number) as last_block from near group by all)
   join (select w, protocol, b, l, max(n) as generations from waves group by all) using (w, protocol, b, l)),
levels as (select protocol, w, quantile_cont(sum_usd, [{", ".join(str(t / 100) for t in A.THETAS)}]) as p from stats group by all),
points as (select protocol, w, k, theta, theta_usd from (select protocol, w, unnest([{", ".join(map(str, A.THETAS))}])::double as theta, unnest(p) as theta_usd from levels), (select unnest([{", ".join(map(str, A.POSITIONS))}])::bigint as k)),
hits as (select protocol, w, k, theta, theta_usd, block_number as s, last_block as e from stats join points using (protocol, w) where sum_usd >= theta_usd and n_positions >= k and n_users >= 2 and generations >= 2),
isl as (select *, sum(case when p is null or s > p then 1 else 0 end) over (partition by protocol, w, k, theta order by s, e rows unbounded preceding) as g
   from (select *, max(e) over (partition by protocol, w, k, theta order by s, e rows between unbounded preceding and 1 preceding) as p from hits)),
spans as (select protocol, w, k, theta, any_value(theta_usd) as theta_usd, min(s) as start_block, max(e) as end_block from isl group by protocol, w, k, theta, g),
within as (select s.*, l.* exclude (protocol, k), coalesce(collateral_asset, 'unknown') as asset_key, lag(block_number) over (partition by s.protocol, w, s.k, theta, start_block, coalesce(collateral_asset, 'unknown') order by block_number, log_index) as prev
   from spans s join liq l on l.protocol = s.protocol and l.block_number between start_block and end_block),
labels_ as (select protocol, w, k, theta, theta_usd, start_block, end_block, count(*) as n_events, sum(amount_usd) as severity_usd, count(distinct position_id) as n_positions, count(distinct "user") as n_users, min(block_timestamp) as start_time, max(block_timestamp) as end_time from within group by all),
gens as (select protocol, w, k, theta, start_block, max(n) as generations from (select protocol, w, k, theta, start_block, asset_key, count(*) filter (where prev is null or block_number - prev > {A.LAG}) as n from within group by all) group by all),
grid_episodes as (select protocol || '_w' || w || '_k' || k || '_p' || cast(theta as bigint) || '_' || start_block || '_' || end_block as episode_id, labels_.*, generations, w = {A.PRIMARY[0]} and k = {A.PRIMARY[1]} and theta = {A.PRIMARY[2]} as is_primary
   from labels_ join gens using (protocol, w, k, theta, start_block))"""


@once
def _stats(spark, d):
    return cascades.window_stats(A.liquidations(spark, d), [A.WINDOW], A.LAG).drop("w")


@query(cte("grid") + _STATS + " select * from stats")
def cascade_window_stats(spark, d):
    return _stats(spark, d)


@query(cte("grid") + _STATS + " select protocol, block_number, log_index, generations from stats")
def generations(spark, d):
    return _stats(spark, d).select("protocol", "block_number", "log_index", "generations")


@query(cte("grid") + _STATS + " select protocol, quantile_cont(sum_usd, 0.9) as p90, quantile_cont(sum_usd, 0.95) as p95, quantile_cont(sum_usd, 0.99) as p99 from stats group by all")
def theta_percentile(spark, d):
    return B.percentiles(_stats(spark, d), ["protocol"], "sum_usd", [0.9, 0.95, 0.99]).select("protocol", *[F.col("p")[i].alias(n) for i, n in enumerate(("p90", "p95", "p99"))])


@once
def primary_episodes(spark, d):
    """The episodes of the primary grid point, which alarms are judged by."""
    w, k, theta = A.PRIMARY
    stats = cascades.window_stats(A.liquidations(spark, d), [w], A.LAG)
    found = cascades.label_grid(A.liquidations(spark, d), saved(stats), [k], [theta], A.LAG)
    return found.select("protocol", "start_block", "end_block", "n_events", "severity_usd", "n_positions", "n_users")


@query(cte("liq") + _LABELS + " select * from grid_episodes")
@once
def episodes(spark, d):
    """All 27 points of the label grid from one pass over the liquidations."""
    liq = A.liquidations(spark, d)
    stats = saved(cascades.window_stats(liq, list(A.WIDTHS), A.LAG))
    found = cascades.label_grid(liq, stats, list(A.POSITIONS), list(A.THETAS), A.LAG)
    primary = (F.col("w") == A.PRIMARY[0]) & (F.col("k") == A.PRIMARY[1]) & (F.col("theta") == A.PRIMARY[2])
    name = F.concat("protocol", F.lit("_w"), "w", F.lit("_k"), "k", F.lit("_p"), F.col("theta").cast("long"), F.lit("_"), "start_block", F.lit("_"), "end_block")
    return found.select(name.alias("episode_id"), "*", primary.alias("is_primary"))


@query(cte("liq") + """, w as (select protocol, block_number // 5000 * 5000 as start_block, block_number // 5000 * 5000 + 6000 as end_block from liq group by all)
select w.protocol, start_block, end_block, count(*) as n_events, sum(amount_usd) as severity_usd, count(distinct position_id) as n_positions, count(distinct "user") as n_users from w join liq l on l.protocol = w.protocol and l.block_number between start_block and end_block group by all""")
def interval_rollup(spark, d):
    """What given spans hold, overlapping ones too."""
    liq, start = A.liquidations(spark, d), F.floor(F.col("block_number") / 5000) * 5000
    spans = liq.select("protocol", start.alias("start_block"), (start + 6000).alias("end_block")).distinct()
    return cascades.interval_rollup(liq, spans, A.WINDOW)


@query(cte("liq") + _LABELS + """ select protocol, w, k, theta, n_episodes, total_usd, largest_usd, n_primary from
(select protocol, w, k, theta, count(*) as n_episodes, sum(severity_usd) as total_usd, max(severity_usd) as largest_usd, count(*) filter (where is_primary) as n_primary from grid_episodes group by grouping sets ((protocol, w, k, theta), ()))""")
def write_episodes(spark, d):
    """Writes the labels by protocol and their summary, of each grid point and of all together, as JSON, and reads the summary again."""
    folder, summary = shared_folder(spark, "episodes"), shared_folder(spark, "episode-summary")
    episodes(spark, d).write.partitionBy("protocol").option("compression", "zstd").parquet(folder)
    schema = "episode_id string, w long, k long, theta double, theta_usd double, start_block long, end_block long, n_events long, severity_usd double, n_positions long, n_users long, start_time timestamp_ntz, end_time timestamp_ntz, generations long, is_primary boolean, protocol string"
    e = spark.read.schema(schema).parquet(folder)
    sums = [F.count("*").alias("n_episodes"), F.sum("severity_usd").alias("total_usd"), F.max("severity_usd").alias("largest_usd"), F.count_if("is_primary").alias("n_primary")]
    each = e.groupBy("protocol", "w", "k", "theta").agg(*sums)
    whole = e.agg(*sums).select(*[F.lit(None).cast(t).alias(c) for c, t in (("protocol", "string"), ("w", "long"), ("k", "long"), ("theta", "double"))], "*")
    each.unionByName(whole).write.json(summary)
    return spark.read.schema("protocol string, w long, k long, theta double, n_episodes long, total_usd double, largest_usd double, n_primary long").json(summary)


@query(cte("grid") + _EPISODES + " select protocol, start_block, end_block, severity_usd from (select *, row_number() over (partition by protocol order by severity_usd desc, start_block) as n from episodes) where n <= 3")
def primary_by_severity(spark, d):
    w = W.partitionBy("protocol").orderBy(F.desc("severity_usd"), "start_block")
    return primary_episodes(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 3").select("protocol", "start_block", "end_block", "severity_usd")


@query(cte("grid") + _STATS + """, hits as (select protocol, block_number as s, last_block as e from stats where n_positions >= 5),
isl as (select *, sum(case when p is null or s > p then 1 else 0 end) over (partition by protocol order by s, e rows unbounded preceding) as g from (select *, max(e) over (partition by protocol order by s, e rows between unbounded preceding and 1 preceding) as p from hits))
select protocol, min(s) as start_block, max(e) as end_block, count(*) as n from isl group by protocol, g""")
def merge_intervals(spark, d):
    h = _stats(spark, d).where("n_positions >= 5").select("protocol", F.col("block_number").alias("start_block"), F.col("last_block").alias("end_block"))
    return intervals.merge_intervals(h, ["protocol"])


@query(cte("grid") + """ select a.protocol, a.block_number, a.log_index, x.log_index as near_log from liq a join liq x on a.protocol = x.protocol and x.block_number >= a.block_number and x.block_number < a.block_number + (select bw from grid)""")
def range_stats_join(spark, d):
    w = A.BAR
    q = A.liquidations(spark, d).withColumn("c", F.floor(F.col("block_number") / w))
    a = q.select("protocol", "block_number", "log_index", F.explode(F.array("c", F.col("c") + 1)).alias("c"))
    x = q.select("protocol", "c", F.col("block_number").alias("b"), F.col("log_index").alias("near_log"))
    return a.join(x, ["protocol", "c"]).where((F.col("b") >= F.col("block_number")) & (F.col("b") < F.col("block_number") + w)).select("protocol", "block_number", "log_index", "near_log")


@query(cte("liq", "px") + """, s as (select feed_asset as feed, block_number - 300 as s, block_number as e from (select debt_asset as feed_asset, block_number from liq)),
isl as (select *, sum(case when p is null or s > p then 1 else 0 end) over (partition by feed order by s, e rows unbounded preceding) as g from (select *, max(e) over (partition by feed order by s, e rows between unbounded preceding and 1 preceding) as p from s))
select feed, min(s) as start_block, max(e) as end_block, count(*) as n from isl group by feed, g""")
def pull_windows(spark, d):
    s = A.liquidations(spark, d).select(F.col("debt_asset").alias("feed"), (F.col("block_number") - 300).alias("start_block"), F.col("block_number").alias("end_block"))
    return intervals.merge_intervals(s, ["feed"])


_FILES = ", files as (select block_number // 2000 as f, min(block_number) as a, max(block_number) as b from ev where block_number % 2000 < 1500 and (block_number // 2000) % 7 <> 3 group by all)"


@query(cte("ev") + _FILES + " select prev + 1 as gap_start, a - 1 as gap_end from (select *, max(b) over (order by a rows between unbounded preceding and 1 preceding) as prev from files) where a > prev + 1")
def coverage_gaps(spark, d):
    f = A.events(spark, d).where("block_number % 2000 < 1500 and floor(block_number / 2000) % 7 != 3").groupBy(F.floor(F.col("block_number") / 2000).alias("f")).agg(F.min("block_number").alias("a"), F.max("block_number").alias("b"))
    f = intervals.running(f, [], "a", ["a"], inclusive=False, prev=("max", F.col("b")))
    return f.where("a > prev + 1").select((F.col("prev") + 1).alias("gap_start"), (F.col("a") - 1).alias("gap_end"))


@query(cte("idx") + """ select reserve, min(block_number) as start_block, max(block_number) as end_block, count(*) as n from (select *, sum(case when p is null or block_number - p > 1000 then 1 else 0 end) over (partition by reserve order by block_number rows unbounded preceding) as g
from (select *, lag(block_number) over (partition by reserve order by block_number) as p from idx)) group by reserve, g""")
def coverage_runs(spark, d):
    r = intervals.runs(A.reserve_index(spark, d), ["reserve"], "block_number", 1000)
    return r.groupBy("reserve", "run").agg(F.min("block_number").alias("start_block"), F.max("block_number").alias("end_block"), F.count("*").alias("n")).drop("run")


@query(cte("liq") + ", t as (select * from (values ('early', 0, 60000, 60000.0::double, 500), ('late', 100000, 200000, 90000.0::double, 900)) v(name, lo, hi, usd, n)) select name, count(*) as n_events, sum(amount_usd) as usd, sum(amount_usd) / max(usd) - 1 as usd_deviation, count(*) / max(n)::double - 1 as n_deviation, abs(sum(amount_usd) / max(usd) - 1) <= 0.1 as within from liq join t on block_number between lo and hi group by name")
def reconcile(spark, d):
    t = spark.createDataFrame([("early", 0, 60000, 60000.0, 500), ("late", 100000, 200000, 90000.0, 900)], "name string, lo long, hi long, usd_target double, n_target long")
    j = A.liquidations(spark, d).join(F.broadcast(t), F.col("block_number").between(F.col("lo"), F.col("hi")))
    g = j.groupBy("name", "usd_target", "n_target").agg(F.count("*").alias("n_events"), F.sum("amount_usd").alias("usd"))
    dev = F.col("usd") / F.col("usd_target") - 1
    return g.select("name", "n_events", "usd", dev.alias("usd_deviation"), (F.col("n_events") / F.col("n_target") - 1).alias("n_deviation"), (F.abs(dev) <= 0.1).alias("within"))


@query(cte("liq") + _LABELS + ", t as (select * from (values ('early', 0, 60000), ('late', 100000, 200000)) v(name, lo, hi)) select name, (select count(*) from liq where block_number between lo and hi) as n_events, (select sum(amount_usd) from liq where block_number between lo and hi) as usd, exists (select 1 from grid_episodes where is_primary and start_block between lo and hi) as detected_primary, (select count(distinct (w, k, theta)) from grid_episodes where start_block <= hi and end_block >= lo) as n_points from t")
def golden_summary(spark, d):
    """Named windows: what they hold, whether the primary labels begin in them, and how many of the 27 grid points meet them."""
    t = spark.createDataFrame([("early", 0, 60000), ("late", 100000, 200000)], "name string, lo long, hi long")
    seen = A.liquidations(spark, d).join(F.broadcast(t), F.col("block_number").between(F.col("lo"), F.col("hi"))).groupBy("name").agg(F.count("*").alias("n_events"), F.sum("amount_usd").alias("usd"))
    met = episodes(spark, d).join(F.broadcast(t), (F.col("start_block") <= F.col("hi")) & (F.col("end_block") >= F.col("lo")))
    hit = met.groupBy("name").agg(F.max(F.col("is_primary") & (F.col("start_block") >= F.col("lo"))).alias("hit"), F.countDistinct("w", "k", "theta").alias("n"))
    out = t.select("name").join(seen, "name", "left").join(hit, "name", "left")
    return out.select("name", F.coalesce("n_events", F.lit(0)).alias("n_events"), "usd", F.coalesce("hit", F.lit(False)).alias("detected_primary"), F.coalesce("n", F.lit(0)).alias("n_points"))


BARS = """, b0 as (select min(block_number) as lo, max(block_number) as hi, greatest(1, cast(ceil((max(block_number) - min(block_number)) / (select bw from grid)) as bigint)) as n from liq),
counts as (select least((block_number - lo) // (select bw from grid), b0.n - 1) as i, count(*) as c, sum(amount_usd) as usd from liq, b0 group by all),
bars as (select i, i * (select bw from grid) + lo as start_block, (i + 1) * (select bw from grid) + lo as end_block, coalesce(c, 0) as n_liquidations, coalesce(usd, 0) as liquidated_usd from (select unnest(generate_series(0, n - 1)) as i, lo from b0) left join counts using (i))"""


@once
def bar_table(spark, d):
    return B.dense_bars(A.liquidations(spark, d), A.BAR)


@query(cte("grid") + BARS + " select * from bars")
def bars(spark, d):
    return bar_table(spark, d)


@query(cte("grid") + """, f as (select cast(block_number // (select bw from grid) as bigint) as i, count(*) as c, sum(amount_usd) as usd from liq group by all)
select i, i * bw as start_block, (i + 1) * bw as end_block, coalesce(c, 0) as n_liquidations, coalesce(usd, 0) as liquidated_usd from (select unnest(generate_series(0, 100000 // bw - 1)) as i, bw from grid) left join f using (i)""")
def bars_fixed_origin(spark, d):
    return B.dense_bars(A.liquidations(spark, d), A.BAR, origin=0, end=100000)


@query(cte("grid") + " select cast(block_number // (select bw from grid) as bigint) as i, " + ", ".join(f"count(*) filter (where collateral_asset = 'a{k}') as a{k}" for k in range(5)) + " from liq group by 1")
def channel_bars(spark, d):
    return B.channel_counts(A.liquidations(spark, d), A.BAR, 0, [f"a{k}" for k in range(5)])


STRESS = """, z as (select *, avg(liquidated_usd) over w as m, stddev_pop(liquidated_usd) over w as s, count(*) over w as c from bars window w as (order by i rows between 100 preceding and 1 preceding)),
h as (select *, i - row_number() over (order by i) as g from z where c >= 48 and s > 0 and liquidated_usd - m >= 3 * s), stress as (select min(start_block) as start_block, max(end_block) as end_block, count(*) as n_bars from h group by g)"""


@query(cte("grid") + BARS + STRESS + " select * from stress")
def stress_windows(spark, d):
    return B.stress_windows(bar_table(spark, d), 100, 48, 3.0)


def clusters_of(spark, d, gap, least):
    r = intervals.runs(A.liquidations(spark, d), ["protocol"], "block_number", gap)
    return r.groupBy("protocol", "run").agg(F.min("block_number").alias("start_block"), F.max("block_number").alias("end_block"), F.count("*").alias("n"), F.sum("amount_usd").alias("usd")).where(F.col("n") >= least).drop("run")


CLUSTERS = """, clusters as (select protocol, min(block_number) as start_block, max(block_number) as end_block, count(*) as n, sum(amount_usd) as usd from (select *, sum(case when p is null or block_number - p > bw * 20 then 1 else 0 end) over (partition by protocol order by block_number range unbounded preceding) as g
from (select protocol, block_number, amount_usd, bw, lag(block_number) over (partition by protocol order by block_number) as p from liq, grid)) group by protocol, g having count(*) >= 3)"""


@once
def cluster_table(spark, d):
    """The batch twin of the streamed clusters."""
    return clusters_of(spark, d, A.BAR * 20, 3)


@query(cte("liq") + f""", r as (select protocol, min(block_number) as start_block, max(block_number) as last_block, count(*) as n from (select *, sum(case when p is null or block_number - p > {A.BAR * 20} then 1 else 0 end) over (partition by protocol order by block_number range unbounded preceding) as g
from (select protocol, block_number, lag(block_number) over (partition by protocol order by block_number) as p from liq)) group by protocol, g),
o as (select *, last_block = max(last_block) over (partition by protocol) and last_block + {A.BAR * 20} >= (select max(block_number) from ev) as ongoing from r)
select protocol, start_block, last_block, ongoing, n, row_number() over (partition by protocol order by start_block desc) as newest from o where ongoing or n >= 3""")
def cascade_list(spark, d):
    """Closed clusters of three events or more and, while the head is near it, a protocol's open one, newest first."""
    gap = A.BAR * 20
    head = A.events(spark, d).agg(F.max("block_number").alias("head"))
    c = clusters_of(spark, d, gap, 1)
    c = c.withColumn("latest", F.max("end_block").over(W.partitionBy("protocol"))).crossJoin(F.broadcast(head))  # head is one row
    c = c.withColumn("ongoing", (F.col("end_block") == F.col("latest")) & (F.col("end_block") + gap >= F.col("head"))).where("ongoing or n >= 3")
    newest = F.row_number().over(W.partitionBy("protocol").orderBy(F.desc("start_block"))).cast("long")
    return c.select("protocol", "start_block", F.col("end_block").alias("last_block"), "ongoing", "n", newest.alias("newest"))


@query(cte("grid") + _EPISODES + BARS + " select e.protocol, e.start_block as episode, b.i, b.n_liquidations from episodes e join bars b on b.end_block >= e.start_block - 100 and b.start_block <= e.end_block + 100")
def window_slice(spark, d):
    e = primary_episodes(spark, d).select("protocol", F.col("start_block").alias("episode"), F.col("end_block").alias("last"))
    cell = 1 << 14
    e = e.withColumn("c", F.explode(F.sequence(F.floor((F.col("episode") - 100) / cell) - 1, F.floor((F.col("last") + 100) / cell))))
    b = bar_table(spark, d).withColumn("c", F.floor(F.col("start_block") / cell))
    return e.join(b, "c").where("end_block >= episode - 100 and start_block <= last + 100").select("protocol", "episode", "i", "n_liquidations")


@query(cte("grid") + BARS + " select b.i, e.block_timestamp as seen from bars b asof left join (select block_number, max(block_timestamp) as block_timestamp from ev group by all) e on b.end_block >= e.block_number")
def block_time_asof(spark, d):
    t = A.events(spark, d).groupBy(F.lit(1).alias("g"), F.col("block_number").alias("end_block")).agg(F.max("block_timestamp").alias("seen"))
    return asof_join(bar_table(spark, d).withColumn("g", F.lit(1)), t, ["g"], "end_block", ["seen"]).select("i", "seen")


@query(cte("grid") + BARS + " select (max(end_block) - min(start_block)) * 12.0::double / 604800 as weeks, 604800 / 12.0::double as blocks_per_week, count(*) as n_bars from bars")
def blocks_per_week(spark, d):
    return bar_table(spark, d).agg(((F.max("end_block") - F.min("start_block")) * 12.0 / 604800).alias("weeks"), F.lit(604800 / 12.0).alias("blocks_per_week"), F.count("*").alias("n_bars"))


@query(cte("grid") + CLUSTERS + ", x as (select protocol, c.start_block, l.block_number, 0 as rank, count(*) as n from clusters c join liq l using (protocol) where l.block_number between c.start_block and c.end_block group by all union all select protocol, start_block, end_block, 1, n from clusters) select protocol, start_block, block_number, rank, n, row_number() over (partition by protocol, start_block order by block_number, rank) as nth from x")
def replay_sequence(spark, d):
    c = cluster_table(spark, d)
    spans = c.select("protocol", "start_block", "end_block")
    q = intervals.within_spans(A.liquidations(spark, d), "block_number", spans, "start_block", "end_block", by=["protocol"])
    q = q.groupBy("protocol", "start_block", "block_number").agg(F.count("*").alias("n")).withColumn("rank", F.lit(0))
    both = q.unionByName(c.select("protocol", "start_block", F.col("end_block").alias("block_number"), "n", F.lit(1).alias("rank")))
    return both.withColumn("nth", F.row_number().over(W.partitionBy("protocol", "start_block").orderBy("block_number", "rank")).cast("long"))

"""Queries: streaming jobs with their batch twins as SQL, and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.operators import intervals
from tremor.queries.alarms import ALL, fires
from tremor.queries.cascades import CLUSTERS, cluster_table
from tremor.queries.registry import once, query
from tremor.sources import adapter as A
from tremor.sources.adapter import cte
from tremor.sources.shared import shared_folder
from tremor.streaming import live


FINAL_LAG, STREAM_BAR, STREAM_GAP = 64, 50, 200
#: What final bars are told: blocks to the head, and the time of blocks.
FINAL = (FINAL_LAG, A.GENESIS_US // 10**6, A.BLOCK_US // 10**6)


def final_sql(width: int, block: str = "block_number", head: str = "liq") -> str:
    """Whether the bar of `width` blocks that holds a block is final."""
    return f"({block} // {width} + 1) * {width * A.BLOCK_US} + {A.GENESIS_US} <= (select max(epoch_us(block_timestamp)) - {FINAL_LAG * A.BLOCK_US} from {head})"


def liquidation_stream(spark, d):
    """(protocol, ts, block_number, usd) of the liquidations as a stream."""
    e = live.event_stream(spark, d).where("event_type = 'error'")
    ts = F.col("ts").cast("timestamp")
    block = F.floor((F.unix_micros(ts) - A.GENESIS_US) / A.BLOCK_US).cast("long")
    return e.select(F.when(F.col("event_id") % 3 == 0, "p1").otherwise("p0").alias("protocol"), ts.alias("ts"), block.alias("block_number"), F.col("value").alias("usd"))


@query(cte("liq") + f""" select protocol, block_number // {STREAM_BAR} * {STREAM_BAR} as start_block, block_number // {STREAM_BAR} * {STREAM_BAR} + {STREAM_BAR} as end_block, count(*) as n, sum(amount_usd) as usd from liq group by all
having (max(block_number) // {STREAM_BAR} + 1) * {STREAM_BAR * A.BLOCK_US} + {A.GENESIS_US} <= (select max(epoch_us(block_timestamp)) - {FINAL_LAG * A.BLOCK_US} from liq)""")
def stream_bars(spark, d):
    rows = liquidation_stream(spark, d).drop("block_number")
    return live.run_to_table(live.final_bars(rows, STREAM_BAR, FINAL_LAG, A.GENESIS_US // 10**6, A.BLOCK_US // 10**6), "bars")


_SCORE = "coalesce(sum(b.n * exp(-0.05 * (a.bar - b.bar))), 0)"


@query(cte("liq") + f""", m as (select protocol, block_number // {STREAM_BAR} as bar, count(*) as n from liq where {final_sql(STREAM_BAR)} group by all)
select a.protocol, a.bar, any_value(a.n) as n, {_SCORE} as r, 0.02 * {_SCORE} / (0.05 + 0.02 * {_SCORE}) as score from m a left join m b on a.protocol = b.protocol and b.bar < a.bar group by a.protocol, a.bar""")
def stream_score(spark, d):
    rows = liquidation_stream(spark, d).drop("block_number")
    return live.run_to_table(live.scored_bars(rows, 0.05, 0.02, 0.05, STREAM_BAR, *FINAL), "scores")


@query("select event_id // 2 as tx, event_id // 2 % 3 as log, max(event_id % 2) = 1 as confirmed, max_by(value, event_id % 2) as usd from events group by event_id // 2")
def stream_dedup(spark, d):
    """Of two rows of a transaction's log, the odd one confirms the even one."""
    e = live.event_stream(spark, d)
    tx = F.floor(F.col("event_id") / 2).cast("long")
    rows = e.select(F.col("ts").cast("timestamp").alias("ts"), tx.alias("tx"), (tx % 3).alias("log"), (F.col("event_id") % 2 == 1).alias("confirmed"), F.col("value").alias("usd"))
    return live.current_rows(live.run_to_table(live.deduplicated(rows, "60 days"), "dedup", large_state=True))


_STREAMED = f""", c as (select protocol, min(block_number) as start_block, max(block_number) as last_block, count(*) as n, sum(amount_usd) as usd from (select *, sum(case when p is null or block_number - p > {STREAM_GAP} then 1 else 0 end) over (partition by protocol order by block_number range unbounded preceding) as g
from (select protocol, block_number, amount_usd, lag(block_number) over (partition by protocol order by block_number) as p from liq where {final_sql(1)})) group by protocol, g), streamed as (select c.*, case when last_block < max(last_block) over (partition by protocol) then last_block end as end_block from c)"""


@once
def streamed_clusters(spark, d):
    rows = liquidation_stream(spark, d).drop("block_number")
    return live.current_clusters(live.run_to_table(live.clusters(rows, STREAM_GAP, *FINAL), "clusters"))


@query(cte("liq") + _STREAMED + " select protocol, start_block, last_block as end_block, n, usd from streamed where n >= 3")
def stream_clusters(spark, d):
    return streamed_clusters(spark, d).where("n >= 3").select("protocol", "start_block", F.col("last_block").alias("end_block"), "n", "usd")


@query(cte("liq") + _STREAMED + " select protocol, start_block, last_block, end_block, n from streamed where end_block is null or n >= 5")
def ongoing_cluster(spark, d):
    """Closed clusters of five events or more, and each protocol's open one with a null end."""
    return streamed_clusters(spark, d).where("end_block is null or n >= 5").select("protocol", "start_block", "last_block", "end_block", "n")


@query(ALL + CLUSTERS + ", c as (select * from clusters) select c.protocol, c.start_block, count(f.block) > 0 as early_warned, min(f.block) as first_alert, c.start_block - min(f.block) as lead_blocks from c left join fires f on f.block between c.start_block - 500 and c.end_block group by all".replace("group by all", "group by c.protocol, c.start_block"))
def cluster_alert_tags(spark, d):
    c = cluster_table(spark, d).withColumn("lo", F.col("start_block") - 500)
    hit = intervals.within_spans(fires(spark, d).select("block"), "block", c, "lo", "end_block").groupBy("protocol", "start_block").agg(F.min("block").alias("first_alert"))
    return c.select("protocol", "start_block").join(hit, ["protocol", "start_block"], "left").select("protocol", "start_block", F.col("first_alert").isNotNull().alias("early_warned"), "first_alert", (F.col("start_block") - F.col("first_alert")).alias("lead_blocks"))


RANGE = 20_000


def write_ranges(events, folder, width=RANGE):
    """Writes events by protocol, chain and range of `width` blocks. What was written of these ranges before, by this or a broken run, is
    replaced; other ranges stay as they are."""
    rows = events.withColumn("from_block", F.floor(F.col("block_number") / width) * width)
    by = ["protocol", "chain", "from_block"]
    rows.repartition(*by).write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(folder)


@query(cte("ev") + f" select protocol, event_type, block_number // {RANGE} * {RANGE} as from_block, count(*) as n, sum(case when block_number // {RANGE} = 2 then 2 else 1 end * amount_usd) as usd from ev group by all")
def write_events(spark, d):
    """All ranges are written, one of them with a stale batch; then that one again with other amounts, which replace it alone."""
    folder = shared_folder(spark, "events")
    e = A.events(spark, d).drop("k", "asset", "event_id").withColumn("chain", F.lit(1))
    one = F.floor(F.col("block_number") / RANGE) == 2
    stale = e.where(one).withColumn("tx_hash", F.concat(F.lit("stale-"), "tx_hash"))
    write_ranges(e.unionByName(stale), folder)
    write_ranges(e.where(one).withColumn("amount_usd", F.col("amount_usd") * 2), folder)
    got = spark.read.parquet(folder).where("chain = 1")
    return got.groupBy("protocol", "event_type", F.col("from_block").cast("long").alias("from_block")).agg(F.count("*").alias("n"), F.sum("amount_usd").alias("usd"))


@query(cte("liq") + " select block_number, log_index, amount_usd from liq where block_number between 40000 and 60000")
def append_history(spark, d):
    folder = shared_folder(spark, "history")
    q = A.liquidations(spark, d).select("block_number", "log_index", "amount_usd")
    q.where("block_number < 50000").write.mode("append").parquet(folder)
    q.where("block_number >= 50000").write.mode("append").parquet(folder)
    return spark.read.parquet(folder).where("block_number between 40000 and 60000")


@query(cte("liq") + " select protocol, block_number // 10000 as part, count(*) as n, sum(amount_usd) as usd from liq group by all")
def write_csv_report(spark, d):
    folder = shared_folder(spark, "report")
    r = A.liquidations(spark, d).groupBy("protocol", F.floor(F.col("block_number") / 10000).alias("part")).agg(F.count("*").alias("n"), F.sum("amount_usd").alias("usd"))
    r.write.option("header", True).csv(folder)
    return spark.read.schema("protocol string, part long, n long, usd double").option("header", True).csv(folder)


@query(cte("px") + " select asset, count(*) as n, max(ord) as last from px group by asset")
def merge_batches(spark, d):
    folder = shared_folder(spark, "batches")
    p = A.price_updates(spark, d).select("asset", "ord")
    for k in range(3):
        p.where(F.pmod("ord", F.lit(3)) == k).write.mode("append").parquet(folder)
    return spark.read.parquet(folder).groupBy("asset").agg(F.count("*").alias("n"), F.max("ord").alias("last"))

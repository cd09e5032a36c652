"""Queries: raw feeds (pending transactions, pool days, nested histories) brought into typed rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.queries.registry import query
from tremor.sources import adapter as A
from tremor.sources.adapter import cte
from tremor.sources.shared import shared_folder

#: tracked pool address -> protocol (fixed values)
POOLS = [("0xp0", "p0"), ("0xp1", "p1"), ("0xp2", "p0")]
#: named windows of days (fixed values)
WINDOWS = [("early", "2024-01-02", "2024-01-05"), ("late", "2024-01-20", "2024-02-10")]
_PENDING = """, pend as (select tx_hash as hash, '0xp' || (k % 6) as "to", block_timestamp as timestamp, log_index as nonce from ev), pools as (select * from (values """ + ", ".join(f"('{a}', '{p}')" for a, p in POOLS) + """) v(pool, pool_protocol)), kept as (select pend.*, pool_protocol from pend join pools on "to" = pool)"""


def pending(spark, d):
    """A feed of pending transactions as CSV files with mixed-case addresses, milliseconds and without the optional columns."""
    e = A.events(spark, d)
    rows = e.select(F.col("tx_hash").alias("hash"), F.concat(F.lit("0xP"), F.col("k") % 6).alias("to"), F.floor(F.unix_micros(F.col("block_timestamp").cast("timestamp")) / 1000).alias("timestamp_ms"), F.col("log_index").alias("nonce"))
    folder = shared_folder(spark, "pending")
    rows.write.option("header", True).csv(folder)
    return spark.read.csv(folder, header=True, schema="hash string, to string, timestamp_ms long, nonce int")


def tracked(feed):
    """Rows sent to tracked pools, with the pool's protocol; the list of pools is fixed and short."""
    spark = feed.sparkSession
    pools = spark.createDataFrame(POOLS, "to string, pool_protocol string")
    rows = feed.withColumn("to", F.lower("to")).join(F.broadcast(pools), "to")
    return rows.select("hash", "to", F.timestamp_millis("timestamp_ms").alias("timestamp"), "nonce", F.lit(None).cast("string").alias("included_block"), "pool_protocol")


@query(cte("ev") + _PENDING + """ select hash, "to", epoch_us(timestamp) // 1000 as timestamp_ms, nonce, cast(null as varchar) as included_block, pool_protocol from kept""")
def filter_mempool(spark, d):
    t = tracked(pending(spark, d))
    return t.select("hash", "to", F.unix_millis("timestamp").alias("timestamp_ms"), "nonce", "included_block", "pool_protocol")


@query(cte("ev") + _PENDING + """, days as (select cast(timestamp as date) as day, count(*) as n from kept group by all), w as (select * from (values """ + ", ".join(f"('{n}', date '{a}', date '{b}')" for n, a, b in WINDOWS) + """) v(name, lo, hi))
select name, (hi - lo + 1)::bigint as days, count(day) as days_ok, coalesce(sum(n), 0)::bigint as n_kept, count(day) = (hi - lo + 1) as complete from w left join days on day between lo and hi group by name, lo, hi""")
def mempool_coverage(spark, d):
    days = tracked(pending(spark, d)).groupBy(F.col("timestamp").cast("date").alias("day")).agg(F.count("*").alias("n"))
    w = spark.createDataFrame(WINDOWS, "name string, lo string, hi string").select("name", F.col("lo").cast("date").alias("lo"), F.col("hi").cast("date").alias("hi"))
    span = (F.datediff("hi", "lo") + 1).cast("long")
    asked = w.select("name", span.alias("days"), F.explode(F.sequence("lo", "hi")).alias("day"))
    return asked.join(days, "day", "left").groupBy("name", "days").agg(F.count("n").alias("days_ok"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_kept")).withColumn("complete", F.col("days_ok") == F.col("days"))


@query(cte("ev") + """ select tx_hash as pool, epoch_us(block_timestamp) // 1000000 as date, amount_usd as tvl_usd, case when k % 3 > 0 then k end as tick, '["' || k || '", "' || log_index || '"]' as input_token_balances_raw from ev where event_type = 'Deposit'""")
def normalize_dex_bars(spark, d):
    e = A.events(spark, d).where("event_type = 'Deposit'")
    text = lambda c: c.cast("string")
    seconds = F.floor(F.unix_micros(F.col("block_timestamp").cast("timestamp")) / 1000000)
    raw = e.select(F.to_json(F.struct(F.col("tx_hash").alias("id"), text(seconds).alias("date"), text(F.col("amount_usd")).alias("tvlUSD"), F.when(F.col("k") % 3 > 0, text(F.col("k"))).alias("tick"), F.array(text(F.col("k")), text(F.col("log_index"))).alias("inputTokenBalances"))).alias("body"))
    return dex_bars(raw)


def dex_bars(raw):
    """Pool days from JSON rows of strings: typed numbers, a null tick on days without swaps, and the nested list kept as JSON."""
    x = raw.select(F.from_json("body", "id string, date string, tvlUSD string, tick string, inputTokenBalances array<string>").alias("x"))
    balances = F.concat(F.lit('["'), F.array_join("x.inputTokenBalances", '", "'), F.lit('"]'))
    return x.select(F.col("x.id").alias("pool"), F.col("x.date").cast("long").alias("date"), F.col("x.tvlUSD").cast("double").alias("tvl_usd"), F.col("x.tick").cast("long").alias("tick"), balances.alias("input_token_balances_raw"))


@query(cte("px") + " select asset as slug, epoch_us(block_timestamp) // 1000000 as date, price as tvl from px")
def explode_tvl_history(spark, d):
    p = A.price_updates(spark, d)
    seconds = F.floor(F.unix_micros(F.col("block_timestamp").cast("timestamp")) / 1000000)
    # a document holds the points of one asset within 1200 blocks
    docs = p.groupBy("asset", F.floor(F.col("block_number") / 1200).alias("part")).agg(F.to_json(F.collect_list(F.struct(seconds.alias("date"), F.col("price").alias("totalLiquidityUSD")))).alias("tvl"))
    points = docs.select(F.col("asset").alias("slug"), F.explode_outer(F.from_json("tvl", "array<struct<date long, totalLiquidityUSD double>>")).alias("x"))
    return points.select("slug", "x.date", F.col("x.totalLiquidityUSD").alias("tvl"))


@query(cte("ev", "reg") + " select asset as reserve, 'a-' || asset as collateral_token, 'sd-' || asset as stable_debt_token, 'vd-' || asset as variable_debt_token, count(*) as n_events from ev join reg using (asset) group by asset")
def token_registry(spark, d):
    tokens = A.registry(spark).select("asset", *[F.concat(F.lit(p), "asset").alias(n) for p, n in (("a-", "collateral_token"), ("sd-", "stable_debt_token"), ("vd-", "variable_debt_token"))])
    used = A.events(spark, d).groupBy("asset").agg(F.count("*").alias("n_events"))
    return used.join(F.broadcast(tokens), "asset").withColumnRenamed("asset", "reserve")

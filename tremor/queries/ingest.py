"""Queries: scans, projections, filters, dedup and simple joins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremor.operators import filters
from tremor.operators.asof import asof_join
from tremor.queries.registry import query
from tremor.sources import adapter as A
from tremor.sources import ingest as I
from tremor.sources.adapter import cte


@query(cte("liq") + ' select protocol, block_number, log_index, tx_hash, "user", collateral_asset, debt_asset, amount_usd, position_id from liq')
def scan_liquidations(spark, d):
    return filters.dedup_events(A.liquidations(spark, d)).select("protocol", "block_number", "log_index", "tx_hash", "user", "collateral_asset", "debt_asset", "amount_usd", "position_id")


@query(cte("ev") + """ select block_number, log_index, tx_hash, event_type, case when event_type = 'Borrow' and event_id % 5 = 0 then 'r' || event_id else "user" end as "user", debt_asset, amount_raw
from ev where protocol = 'p0' and event_type <> 'AnswerUpdated'""")
def scan_position_events(spark, d):
    e = A.events(spark, d).where("protocol = 'p0' and event_type != 'AnswerUpdated'")
    fix = A.events(spark, d).where("event_type = 'Borrow' and event_id % 5 = 0").select("tx_hash", "log_index", F.concat(F.lit("r"), F.col("event_id")).alias("owner"))
    e = filters.dedup_events(e, ["tx_hash", "log_index"]).join(fix, ["tx_hash", "log_index"], "left")
    return e.select("block_number", "log_index", "tx_hash", "event_type", F.coalesce("owner", "user").alias("user"), "debt_asset", "amount_raw")


@query(cte("ev") + """ select 1 as chain_id, block_number, block_timestamp, lower(tx_hash) as tx_hash, log_index, 'p9' as protocol, event_type, lower("user") as "user", cast(null as varchar) as liquidator, lower(collateral_asset) as collateral_asset,
lower(debt_asset) as debt_asset, amount_raw, amount_usd, collateral_seized_raw, cast(null as double) as collateral_seized_usd from ev""")
def normalize_events(spark, d):
    e = A.events(spark, d).withColumn("chain_id", F.lit("1")).withColumn("user", F.upper("user")).drop("protocol")
    return I.normalize_events(e, "p9").withColumn("block_timestamp", F.col("block_timestamp").cast("timestamp_ntz"))


@query(cte("ev") + """ select 10 as chain_id, tx_hash, coalesce(collateral_asset, debt_asset) as reserve, amount_usd from ev""")
def rename_source_columns(spark, d):
    e = A.events(spark, d).select(F.col("tx_hash").alias("hash"), F.col("collateral_asset").alias("collateralAsset"), F.col("debt_asset").alias("debtAsset"), F.col("amount_usd").alias("usd"))
    return I.rename_columns(e, {"hash": "tx_hash", "collateralAsset": "reserve", "debtAsset": "reserve", "usd": "amount_usd"}, F.lit("events_chain_10.parquet"))


@query(cte("liq") + """ select block_number, log_index, tx_hash, '0x' || lpad(collateral_asset, 40, '0') as collateral_asset, '0x' || lpad(debt_asset, 40, '0') as debt_asset, '0x' || lpad(right("user", length("user") - 1), 40, '0') as "user", amount_raw, collateral_seized_raw from liq""")
def decode_logs(spark, d):
    e = A.liquidations(spark, d)
    topic = lambda c: F.concat(F.lit("0x"), F.lpad(c, 64, "0"))
    word = lambda c: F.lpad(F.hex(c.cast("long")), 64, "0")
    num = lambda c: F.concat(F.lit("0x"), F.when(c == 0, F.lit("")).otherwise(F.lower(F.hex(c))))
    logs = e.select(F.array(F.lit("0xe413"), topic(F.col("collateral_asset")), topic(F.col("debt_asset")), topic(F.substring("user", 2, 60))).alias("topics"), F.concat(F.lit("0x"), word(F.col("amount_raw")), word(F.col("collateral_seized_raw"))).alias("data"), num(F.col("block_number")).alias("blockNumber"), num(F.col("log_index").cast("long")).alias("logIndex"), F.col("tx_hash").alias("transactionHash"))
    return I.decode_liquidation_logs(logs)


@query(cte("daily") + " select * from daily")
def scan_daily_prices(spark, d):
    return A.daily_prices(spark, d)


@query(cte("px") + " select feed, block_number, log_index, price from px where price is not null")
def scan_price_updates(spark, d):
    return A.price_updates(spark, d).where("price is not null").select(F.lower("feed").alias("feed"), "block_number", "log_index", "price")


@query(cte("idx") + " select reserve, block_number, liquidity_index, rate from idx")
def scan_reserve_index(spark, d):
    return A.reserve_index(spark, d).select("reserve", "block_number", "liquidity_index", "rate")


@query(cte("ev") + """ select asset, block_number, 0.5::double + 0.1::double * (k % 4) as liquidation_threshold from ev where event_type = 'Deposit' and event_id % 13 = 0""")
def scan_risk_config(spark, d):
    return risk_config(spark, d).select("asset", "block_number", "liquidation_threshold")


def risk_config(spark, d):
    e = A.events(spark, d).where("event_type = 'Deposit' and event_id % 13 = 0")
    return e.select("asset", "block_number", (0.5 + 0.1 * (F.col("k") % 4)).alias("liquidation_threshold"))


@query(cte("reg", "ev") + " select reg.*, count(*) as n_events, min(block_number) as first_block from reg join ev using (asset) group by all")
def reserve_registry(spark, d):
    """The registered reserves that the events know, with their first block."""
    seen = A.events(spark, d).groupBy("asset").agg(F.count("*").alias("n_events"), F.min("block_number").alias("first_block"))
    return A.registry(spark).join(seen, "asset")


_MINUTE = "minute as (select asset, date_trunc('minute', block_timestamp) as minute, avg(price) as price from px group by all)"
_CORE = " select block_number, log_index, event_type, asset, ev.amount_raw, cast(ev.amount_raw as double) / 100 * price as amount_usd from ev left join minute using (asset, minute) where block_number between 1000 and 150000"


def minute_prices(spark, d):
    return A.price_updates(spark, d).groupBy("asset", F.date_trunc("minute", F.col("block_timestamp").cast("timestamp")).alias("minute")).agg(F.avg("price").alias("price"))


def _core(spark, d, names):
    e = A.events(spark, d).withColumn("minute", F.date_trunc("minute", F.col("block_timestamp").cast("timestamp"))).select("block_number", "log_index", "asset", "amount_raw", "minute", F.col("event_type").alias("kind"))
    parts = {new: e.where(F.col("kind") == old).drop("kind") for old, new in names.items()}
    return I.core_events(parts, minute_prices(spark, d), 1000, 150000).select("block_number", "log_index", "event_type", "asset", "amount_raw", "amount_usd")


_EV_MIN = ", ev2 as (select *, date_trunc('minute', block_timestamp) as minute from ev)"


@query(cte("px") + ", " + _MINUTE + _EV_MIN + _CORE.replace("from ev left", "from ev2 ev left") + " and event_type in ('Deposit', 'Borrow', 'Repay', 'Withdraw')")
def ingest_v2_core(spark, d):
    return _core(spark, d, {k: k for k in ("Deposit", "Borrow", "Repay", "Withdraw")})


@query(cte("px") + ", " + _MINUTE + _EV_MIN + _CORE.replace("from ev left", "from ev2 ev left").replace("event_type,", "case event_type when 'Deposit' then 'Supply' else event_type end as event_type,") + " and event_type in ('Deposit', 'Borrow', 'Repay', 'Withdraw')")
def ingest_v3_core(spark, d):
    return _core(spark, d, {"Deposit": "Supply", "Borrow": "Borrow", "Repay": "Repay", "Withdraw": "Withdraw"})


def _liquidation_sql(p):
    return cte("liq", "px") + ", " + _MINUTE + f""" select block_number, log_index, collateral_asset, debt_asset, cast(amount_raw as double) / 100 * a.price as amount_usd, cast(collateral_seized_raw as double) / 100 * b.price as collateral_seized_usd
from liq left join minute a on debt_asset = a.asset and date_trunc('minute', block_timestamp) = a.minute left join minute b on collateral_asset = b.asset and date_trunc('minute', block_timestamp) = b.minute where protocol = '{p}'"""


def _liquidations(spark, d, p):
    e = A.liquidations(spark, d).where(F.col("protocol") == p).withColumn("minute", F.date_trunc("minute", F.col("block_timestamp").cast("timestamp")))
    m = minute_prices(spark, d)
    rows = I.priced(I.priced(e, m, "debt_asset", "amount_raw", "amount_usd"), m, "collateral_asset", "collateral_seized_raw", "collateral_seized_usd")
    return rows.select("block_number", "log_index", "collateral_asset", "debt_asset", "amount_usd", "collateral_seized_usd")


@query(_liquidation_sql("p0"))
def ingest_v2_liquidations(spark, d):
    return _liquidations(spark, d, "p0")


@query(_liquidation_sql("p1"))
def ingest_v3_liquidations(spark, d):
    return _liquidations(spark, d, "p1")


@query(cte("idx") + " select reserve, block_number, cast(cast(block_number * 100 + 1000000000 as bigint) as varchar) as liquidity_index_raw from idx")
def ingest_reserve_index(spark, d):
    return A.reserve_index(spark, d).select("reserve", "block_number", F.round(F.col("liquidity_index") * 1e9).cast("long").cast("string").alias("liquidity_index_raw"))


@query(cte("ev") + " select block_number, log_index, asset, cast(amount_raw as double) / 1e8 as answer from ev where event_type = 'AnswerUpdated'")
def ingest_price_feed(spark, d):
    e = A.events(spark, d).where("event_type = 'AnswerUpdated'")
    return e.select("block_number", "log_index", "asset", (F.expr("try_cast(amount_raw as double)") / 1e8).alias("answer"))


@query(cte("liq") + """ select block_number, log_index, 'c' || collateral_asset as market, "user", amount_raw, cast(null as double) as amount_usd from liq where collateral_asset in ('a0', 'a1')""")
def ingest_compound_v2(spark, d):
    e = A.liquidations(spark, d)
    one = lambda a: e.where(F.col("collateral_asset") == a).select("block_number", "log_index", F.lit(f"c{a}").alias("market"), "user", "amount_raw", F.lit(None).cast("double").alias("amount_usd"))
    return one("a0").unionByName(one("a1"))


@query(cte("ev") + """ select block_number, coalesce(nullif(log_index % 3, 0), 0) as tx_index, account from (select block_number, log_index, unnest(["user", "user" || 'b', "user" || 'c']) as account from ev where event_type = 'LiquidationCall' and k % 2 = 0)""")
def ingest_compound_v3(spark, d):
    calls = A.liquidations(spark, d).select("block_number", F.nullif(F.col("log_index") % 3, F.lit(0)).alias("tx_index"), F.array("user", F.concat("user", F.lit("b")), F.concat("user", F.lit("c"))).alias("accounts"), (F.col("k") % 2 == 0).alias("success"))
    return calls.where("success").select("block_number", F.coalesce("tx_index", F.lit(0)).alias("tx_index"), F.explode("accounts").alias("account"))


@query(cte("ev") + """ select block_number, log_index, 'Bite' as event_type, asset, amount_raw from ev where event_type = 'LiquidationCall' and block_number < 100000 union all select block_number, log_index, 'Bark', asset, amount_raw from ev where event_type = 'LiquidationCall' and block_number >= 100000""")
def ingest_maker(spark, d):
    e = A.liquidations(spark, d)
    part = lambda cond, kind: e.where(cond).select("block_number", "log_index", F.lit(kind).alias("event_type"), "asset", "amount_raw")
    return part("block_number < 100000", "Bite").unionByName(part("block_number >= 100000", "Bark"))


@query(cte("liq", "daily") + """ select block_number, log_index, cast(amount_raw as double) / 100 * p.price as amount_usd, cast(collateral_seized_raw as double) / 100 * c.price as collateral_seized_usd
from (select *, cast(block_timestamp as date) as d from liq) l asof left join daily p on l.debt_asset = p.asset and l.d >= p.day asof left join daily c on l.collateral_asset = c.asset and l.d >= c.day""")
def enrich_usd_daily(spark, d):
    p = A.daily_prices(spark, d).select("asset", F.unix_date("day").alias("t"), "price")
    e = A.liquidations(spark, d).withColumn("t", F.unix_date(F.col("block_timestamp").cast("date")))
    e = asof_join(e, p.withColumnRenamed("asset", "debt_asset").withColumnRenamed("price", "debt_price"), ["debt_asset"], "t", ["debt_price"], cell=64, right_t="t1")
    e = asof_join(e, p.withColumnRenamed("asset", "collateral_asset").withColumnRenamed("price", "coll_price"), ["collateral_asset"], "t", ["coll_price"], cell=64, right_t="t2")
    return e.select("block_number", "log_index", (F.col("amount_raw").cast("double") / 100 * F.col("debt_price")).alias("amount_usd"), (F.col("collateral_seized_raw").cast("double") / 100 * F.col("coll_price")).alias("collateral_seized_usd"))


@query(cte("liq") + " select tx_hash, log_index, position_id from liq")
def position_id(spark, d):
    return A.liquidations(spark, d).select("tx_hash", "log_index", "position_id")


_TWICE = ", twice as (select * from ev union all select * from ev where k % 2 = 0)"


def _twice(spark, d):
    e = A.events(spark, d)
    return e.unionByName(e.where("k % 2 = 0"))


@query(cte("ev") + _TWICE + " select count(*) as n_rows, cast(count(*) - count(distinct (tx_hash, log_index, \"user\")) as bigint) as n_duplicates, (select count(*) from (select distinct tx_hash, log_index, \"user\" from twice)) as n_kept from twice")
def dedup_events(spark, d):
    e = _twice(spark, d)
    return filters.count_duplicates(e).crossJoin(filters.dedup_events(e).agg(F.count("*").alias("n_kept")))


@query(cte("ev") + " select count(*) as n, count(*) filter (where amount_usd is null) as n_null, count(*) filter (where amount_usd < 0) as n_negative, count(*) filter (where not isfinite(amount_usd)) as n_non_finite, count(*) filter (where amount_usd > case when event_type = 'LiquidationCall' then 300 else 100 end) as n_too_large from ev")
def usd_sanity(spark, d):
    return filters.usd_sanity(A.events(spark, d), 100.0, 300.0)


@query(cte("px") + " select asset, block_number, log_index, price from (select *, row_number() over (partition by asset, block_number order by log_index desc) as n from px) where n = 1")
def tail_keep_last(spark, d):
    return filters.keep_last(A.price_updates(spark, d), ["asset", "block_number"], ["log_index"]).select("asset", "block_number", "log_index", "price")


@query(cte("px") + """, eras as (select * from (values ('f0', 'a0', 1, 0, 90000), ('f1', 'a0', 2, 90000, null), ('f2', 'a2', 2, null, null)) v(feed, asset, decimals, lo, hi))
select eras.asset, px.feed, block_number, log_index, price * 100 / pow(10, decimals) as price from px join eras using (feed) where block_number >= coalesce(lo, 0) and (hi is null or block_number < hi)""")
def era_clip(spark, d):
    eras = spark.createDataFrame([("f0", "a0", 1, 0, 90000), ("f1", "a0", 2, 90000, None), ("f2", "a2", 2, None, None)], "feed string, asset string, decimals int, lo long, hi long")
    p = A.price_updates(spark, d).drop("asset")
    return p.join(F.broadcast(eras), "feed").where("block_number >= coalesce(lo, 0) and (hi is null or block_number < hi)").select("asset", "feed", "block_number", "log_index", (F.col("price") * 100 / F.pow(F.lit(10.0), "decimals")).alias("price"))


@query(cte("ev") + """ select asset, block_number, n, 'kept' as part from (select asset, block_number, cast(max(case when k % 7 = 0 then null else amount_usd end) as double) as n from ev group by all) where n is not null
union all select asset, block_number, n, 'again' from (select asset, block_number, cast(max(case when k % 7 = 0 then null else amount_usd end) as double) as n from ev group by all) where n is null""")
def cache_evict_nulls(spark, d):
    cache = A.events(spark, d).groupBy("asset", "block_number").agg(F.max(F.when(F.col("k") % 7 != 0, F.col("amount_usd"))).alias("n"))
    return cache.withColumn("part", F.when(F.col("n").isNotNull(), "kept").otherwise("again"))


_TRANSFERS = """, transfers as (select 'tx' || (event_id - event_id % 5) as tx_hash, block_number, log_index, asset as reserve, case when event_id % 4 = 0 then '0x0' else "user" end as from_user, case when event_id % 6 = 0 then '0x0' else 'u' || (k % 50) end as to_user, cast(amount_raw as double) / 100 as value from ev where event_type in ('Repay', 'Withdraw'))"""


def transfers(spark, d):
    e = A.events(spark, d).where("event_type in ('Repay', 'Withdraw')")
    tx = F.concat(F.lit("tx"), F.col("event_id") - F.col("event_id") % 5).alias("tx_hash")  # as of another event, at times a liquidation
    return e.select(tx, "block_number", "log_index", F.col("asset").alias("reserve"), F.when(F.col("event_id") % 4 == 0, "0x0").otherwise(F.col("user")).alias("from_user"), F.when(F.col("event_id") % 6 == 0, "0x0").otherwise(F.concat(F.lit("u"), F.col("k") % 50)).alias("to_user"), (F.col("amount_raw").cast("double") / 100).alias("value"))


@query(cte("ev") + _TRANSFERS + " select * from transfers where from_user <> '0x0' and to_user <> '0x0'")
def naked_transfers(spark, d):
    return transfers(spark, d).where("from_user != '0x0' and to_user != '0x0'")


@query(cte("ev", "liq") + _TRANSFERS + " select t.* from transfers t where not exists (select 1 from liq where liq.tx_hash = t.tx_hash)")
def anti_same_tx(spark, d):
    t = transfers(spark, d)
    return t.join(A.liquidations(spark, d).select("tx_hash"), "tx_hash", "left_anti").select(t.columns)


_OWNERS = """, owners as (select tx_hash, log_index, 'r' || event_id as owner from ev where event_type in ('Borrow', 'Deposit') and event_id % 5 = 0)"""


def _owners(spark, d):
    return A.events(spark, d).where("event_type in ('Borrow', 'Deposit') and event_id % 5 = 0").select("tx_hash", "log_index", F.concat(F.lit("r"), F.col("event_id")).alias("owner"))


@query(cte("ev") + _OWNERS + """ select tx_hash, log_index, event_type, case when event_type in ('Borrow', 'Deposit') then coalesce(owner, "user") else "user" end as "user" from ev left join owners using (tx_hash, log_index)""")
def equi_left_correct(spark, d):
    e = A.events(spark, d).join(_owners(spark, d), ["tx_hash", "log_index"], "left")
    return e.select("tx_hash", "log_index", "event_type", F.when(F.col("event_type").isin("Borrow", "Deposit"), F.coalesce("owner", "user")).otherwise(F.col("user")).alias("user"))


@query(cte("ev") + _OWNERS + """ select distinct "user" as gateway from ev join owners using (tx_hash, log_index) where event_type = 'Deposit' and owner <> "user" """)
def gateway_detect(spark, d):
    e = A.events(spark, d).where("event_type = 'Deposit'").join(_owners(spark, d), ["tx_hash", "log_index"])
    return e.where(F.col("owner") != F.col("user")).select(F.col("user").alias("gateway")).distinct()


@query(cte("ev") + _OWNERS + """ select distinct 't' || asset as token, "user" as gateway from ev where event_type = 'Withdraw' and "user" in (select "user" from ev join owners using (tx_hash, log_index) where event_type = 'Deposit')""")
def needed_pairs(spark, d):
    g = A.events(spark, d).where("event_type = 'Deposit'").join(_owners(spark, d), ["tx_hash", "log_index"]).select("user").distinct()
    return A.events(spark, d).where("event_type = 'Withdraw'").join(g, "user", "left_semi").select(F.concat(F.lit("t"), F.col("asset")).alias("token"), F.col("user").alias("gateway")).distinct()


@query(cte("ev") + """, m as (select 'tx' || (event_id // 50) as tx, asset as token, cast(k % 7 * 1000 as varchar) as amount, log_index, event_type, "user" from ev where event_type in ('Withdraw', 'Repay'))
select w.tx, w.log_index, max_by(t."user", t.log_index) as owner from m w join m t on w.tx = t.tx and w.token = t.token and w.amount = t.amount and t.log_index < w.log_index where w.event_type = 'Withdraw' and t.event_type = 'Repay' group by all""")
def withdraw_owner(spark, d):
    """The sender of the closest transfer before a withdrawal, of its transaction, token and exact amount."""
    m = A.events(spark, d, "event_type not in ('error', 'signup', 'click', 'purchase')").select(
        F.concat(F.lit("tx"), F.floor(F.col("event_id") / 50)).alias("tx"), F.col("asset").alias("token"), (F.col("k") % 7 * 1000).cast("string").alias("amount"), "log_index", "event_type", "user"
    )
    return filters.withdraw_owners(m.where("event_type = 'Withdraw'"), m.where("event_type = 'Repay'"))


@query(cte("liq") + """ select distinct asset, block_number - 1 as block_number from (select collateral_asset as asset, block_number from liq union all select debt_asset, block_number from liq) where asset <> 'a4'""")
def oracle_probe_pairs(spark, d):
    e = A.liquidations(spark, d)
    legs = e.select(F.explode(F.array("collateral_asset", "debt_asset")).alias("asset"), (F.col("block_number") - 1).alias("block_number")).distinct()
    cached = legs.where("asset = 'a4'")
    return legs.join(cached, ["asset", "block_number"], "left_anti")


@query(cte("liq", "px") + """, feeds as (select distinct asset, block_number from px), l as (select *, exists (select 1 from feeds f where f.block_number = liq.block_number and f.asset = liq.collateral_asset) or exists (select 1 from feeds f where f.block_number = liq.block_number and f.asset = liq.debt_asset) as same from liq)
select block_number, log_index, amount_usd, same and block_number >= 50000 as routed from l""")
def same_block_svr(spark, d):
    f = A.price_updates(spark, d).select(F.lower("asset").alias("fa"), F.col("block_number").alias("fb")).distinct().withColumn("hit", F.lit(True))
    e = A.liquidations(spark, d)
    c, b = f.select(F.col("fa").alias("ca"), F.col("fb").alias("cb"), F.col("hit").alias("h1")), f.select(F.col("fa").alias("da"), F.col("fb").alias("db"), F.col("hit").alias("h2"))
    e = e.join(c, (F.lower("collateral_asset") == F.col("ca")) & (F.col("block_number") == F.col("cb")), "left").join(b, (F.lower("debt_asset") == F.col("da")) & (F.col("block_number") == F.col("db")), "left")
    same = F.coalesce("h1", F.lit(False)) | F.coalesce("h2", F.lit(False))
    return e.select("block_number", "log_index", "amount_usd", (same & (F.col("block_number") >= 50000)).alias("routed"))


@query(cte("liq", "ev") + """ select l.block_number, l.log_index from liq l where exists (select 1 from ev e where e."user" = l."user" and e.block_number = l.block_number and e.tx_hash <> l.tx_hash and e.log_index < l.log_index and e.event_type <> 'AnswerUpdated')""")
def same_block_earlier(spark, d):
    return filters.same_block_earlier(A.liquidations(spark, d), A.events(spark, d, "event_type != 'purchase'")).select("block_number", "log_index")


@query(cte("ev") + """ select feed, asset, min(block_number) as first_block from (select 'f' || (k % 7) as feed, asset, block_number from ev) where feed not in ('f0', 'f1') group by all""")
def era_map_diff(spark, d):
    used = A.events(spark, d).groupBy(F.concat(F.lit("f"), F.col("k") % 7).alias("feed"), "asset").agg(F.min("block_number").alias("first_block"))
    mapped = spark.createDataFrame([("f0",), ("f1",)], "feed string")
    return used.join(F.broadcast(mapped), "feed", "left_anti").select("feed", "asset", "first_block")


@query(cte("ev") + """ select distinct 'f' || (k % 7) as feed, upper(asset) as symbol, 2 as decimals from ev where event_type = 'AnswerUpdated'""")
def feed_plan(spark, d):
    m = A.events(spark, d).where("event_type = 'AnswerUpdated'").groupBy("asset").agg(F.collect_set(F.concat(F.lit("f"), F.col("k") % 7)).alias("feeds"))
    return m.select(F.explode("feeds").alias("feed"), F.upper("asset").alias("symbol"), F.lit(2).alias("decimals")).dropDuplicates()


@query(cte("ev") + """ select distinct "user", asset from ev""")
def distinct_pairs(spark, d):
    return A.events(spark, d).select("user", "asset").distinct()


@query(cte("ev") + """ select block_number, log_index, event_type from ev where event_type in ('Deposit', 'Borrow') union all select block_number, log_index, 'copy' from ev where event_type = 'Borrow'""")
def union_events(spark, d):
    e = A.events(spark, d).select("block_number", "log_index", "event_type")
    return e.where("event_type in ('Deposit', 'Borrow')").unionByName(e.where("event_type = 'Borrow'").withColumn("event_type", F.lit("copy")))


@query(cte("ev") + """ select "user", log_index, row_number() over (partition by "user" order by block_number, log_index) as nth from ev""")
def event_order(spark, d):
    return A.events(spark, d).select("user", "log_index", F.row_number().over(W.partitionBy("user").orderBy("block_number", "log_index")).cast("long").alias("nth"))

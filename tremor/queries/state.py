"""Queries: ledger, positions, prices and health factors."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremor.functions import exact, interest
from tremor.operators.asof import asof_join as asof
from tremor.operators.asof import merged_series
from tremor.operators.bars import percentiles
from tremor.operators.filters import same_block_earlier, without_dust
from tremor.operators.intervals import running
from tremor.plans import state as S
from tremor.queries.ingest import _TRANSFERS, risk_config, transfers
from tremor.queries.registry import once, query
from tremor.sources import adapter as A
from tremor.sources.adapter import cte
from tremor.sources.shared import saved

AT = 120000
_POS = """, pos as (select "user", reserve, sum(d_collateral) as collateral, sum(d_debt) as debt from ledger where block_number <= 120000 group by all having abs(sum(d_collateral)) > 1e-9 or abs(sum(d_debt)) > 1e-9)"""
_PRICE_AT = """, price_at as (select asset, max_by(price, ord) as price from px where block_number <= 120000 group by asset)"""
_LEGS = """, legs as (select pos.*, price, liquidation_threshold as threshold, historical_reliable as reliable, coalesce((select max_by(enabled, block_number * 1000000 + log_index) from toggles t where t."user" = pos."user" and t.reserve = pos.reserve and t.block_number <= 120000), true) as enabled from pos left join price_at on pos.reserve = price_at.asset left join reg on pos.reserve = reg.asset)"""
_HF = """, u as (select *, case when enabled then greatest(collateral, 0) else 0 end as c, greatest(debt, 0) as d from legs), hf as (select "user", sum(c * coalesce(price, 0)) as collateral_usd, sum(d * coalesce(price, 0)) as debt_usd,
 case when sum(d * coalesce(price, 0)) > 1e-12 then sum(c * coalesce(price, 0) * coalesce(threshold, 0)) / sum(d * coalesce(price, 0)) end as hf, bool_and(not (c > 1e-12 or d > 1e-12) or price is not null) as fully_covered, bool_and(not (c > 1e-12) or coalesce(reliable, false)) as historical_reliable from u group by "user")"""
STATE = cte("ledger", "px", "reg", "toggles") + _POS + _PRICE_AT + _LEGS + _HF


def led(spark, d):
    return S.ledger(A.events(spark, d))


def latest_prices(spark, d):
    return A.price_updates(spark, d).where(F.col("block_number") <= AT).groupBy(F.col("asset").alias("reserve")).agg(F.max_by("price", "ord").alias("price"))


def legs(spark, d):
    pos = S.positions_at(led(spark, d), AT)
    t = A.toggles(spark, d).where(F.col("block_number") <= AT).groupBy("user", "reserve").agg(F.max_by("enabled", F.struct("block_number", "log_index")).alias("on"))
    reg = A.registry(spark).select(F.col("asset").alias("reserve"), F.col("liquidation_threshold").alias("threshold"), F.col("historical_reliable").alias("reliable"))
    return pos.join(latest_prices(spark, d), "reserve", "left").join(F.broadcast(reg), "reserve", "left").join(t, ["user", "reserve"], "left").select("user", "reserve", "collateral", "debt", "price", "threshold", "reliable", F.coalesce("on", F.lit(True)).alias("enabled"))


def accounts(spark, d):
    return S.health_factor(legs(spark, d), ["user"])


@query(cte("ledger") + " select * from ledger")
def ledger(spark, d):
    return led(spark, d)


@query(cte("ev", "liq") + _TRANSFERS + """ select block_number, log_index, reserve, unnest([from_user, to_user]) as "user", unnest([-value, value]) as d_collateral from transfers where from_user <> '0x0' and to_user <> '0x0'""")
def transfer_ledger(spark, d):
    t = transfers(spark, d).where("from_user != '0x0' and to_user != '0x0'")
    return t.select("block_number", "log_index", "reserve", F.explode(F.array(F.struct(F.col("from_user").alias("user"), (-F.col("value")).alias("d_collateral")), F.struct(F.col("to_user").alias("user"), F.col("value").alias("d_collateral")))).alias("x")).select("block_number", "log_index", "reserve", "x.*")


@query(cte("ev", "liq") + _TRANSFERS + """, i as (select block_number, log_index, asset as reserve, "user", event_type, cast(amount_raw as double) / 100 / (1 + block_number / 1e7) as v from ev where event_type in ('Deposit', 'Withdraw', 'Borrow', 'Repay')),
t as (select block_number, log_index, reserve, from_user, to_user, value / (1 + block_number / 1e7) as v from transfers where from_user <> '0x0' and to_user <> '0x0')
select block_number, log_index, reserve, "user", case event_type when 'Deposit' then v when 'Withdraw' then -v else 0 end as scaled_collateral, case event_type when 'Borrow' then v when 'Repay' then -v else 0 end as scaled_debt from i
union all select block_number, log_index, reserve, from_user, -v, 0 from t union all select block_number, log_index, reserve, to_user, v, 0 from t""")
def exact_ledger(spark, d):
    """Scaled deltas of token events by the index of their own block: collateral minted and burnt, debt minted and burnt, and two legs of each transfer."""
    index = 1 + F.col("block_number") / 1e7
    e = A.events(spark, d).where("event_type in ('Deposit', 'Withdraw', 'Borrow', 'Repay')").withColumn("v", F.col("amount_raw").cast("double") / 100 / index)
    signed = lambda up, down: F.when(F.col("event_type") == up, F.col("v")).when(F.col("event_type") == down, -F.col("v")).otherwise(0.0)
    own = e.select("block_number", "log_index", F.col("asset").alias("reserve"), "user", signed("Deposit", "Withdraw").alias("scaled_collateral"), signed("Borrow", "Repay").alias("scaled_debt"))
    t = transfers(spark, d).where("from_user != '0x0' and to_user != '0x0'").withColumn("v", F.col("value") / index)
    legs = F.explode(F.array(F.struct(F.col("from_user").alias("user"), (-F.col("v")).alias("scaled_collateral")), F.struct(F.col("to_user").alias("user"), F.col("v").alias("scaled_collateral"))))
    moved = t.select("block_number", "log_index", "reserve", legs.alias("x")).select("block_number", "log_index", "reserve", "x.*", F.lit(0.0).alias("scaled_debt"))
    return own.unionByName(moved)


@query(cte("ledger", "idx") + """, i as (select reserve, block_number, liquidity_index from idx) select l.block_number, l.log_index, l."user", l.reserve, l.d_collateral / coalesce(i.liquidity_index, 1) as scaled_collateral, l.d_debt / coalesce(i.liquidity_index, 1) as scaled_debt from ledger l asof left join i on l.reserve = i.reserve and l.block_number >= i.block_number""")
def scale_ledger(spark, d):
    i = A.reserve_index(spark, d).select("reserve", "block_number", "liquidity_index")
    rows = asof(led(spark, d), i, ["reserve"], "block_number", ["liquidity_index"])
    k = F.coalesce("liquidity_index", F.lit(1.0))
    return rows.select("block_number", "log_index", "user", "reserve", (F.col("d_collateral") / k).alias("scaled_collateral"), (F.col("d_debt") / k).alias("scaled_debt"))


@query(STATE + " select * from pos")
def positions_at(spark, d):
    return S.positions_at(led(spark, d), AT)


@query(cte("ev", "liq") + _TRANSFERS + """, t as (select unnest([from_user, to_user]) as "user", reserve, unnest([-value, value]) as x from transfers where from_user <> '0x0' and to_user <> '0x0') select "user", reserve, sum(x) as collateral, 0.0::double as debt from t group by all having abs(sum(x)) > 40""")
def drop_dust(spark, d):
    """Net transferred balances, those of 40 or less dropped as dust."""
    net = transfer_ledger(spark, d).groupBy("user", "reserve").agg(F.sum("d_collateral").alias("collateral")).withColumn("debt", F.lit(0.0))
    return without_dust(net, 40)


@query(STATE + " select * from pos where \"user\" = 'u7'")
def account_snapshot(spark, d):
    return S.positions_at(led(spark, d).where(F.col("user") == "u7"), AT)


@query(cte("ledger") + """ select block_number, log_index, "user", reserve, sum(d_collateral) over w as collateral, sum(d_debt) over w as debt from ledger window w as (partition by "user", reserve order by block_number, log_index, d_debt rows unbounded preceding)""")
def cumulative_balance(spark, d):
    return S.cumulative(led(spark, d)).select("block_number", "log_index", "user", "reserve", "collateral", "debt")


@query(cte("ledger") + """, keys as (select distinct "user", block_number - 1 as block_number from liq), pairs as (select k."user", k.block_number, r.reserve from keys k join (select distinct "user", reserve from ledger) r on k."user" = r."user")
select p."user", p.block_number, p.reserve, coalesce(sum(d_collateral), 0) as collateral, coalesce(sum(d_debt), 0) as debt from pairs p left join ledger l on l."user" = p."user" and l.reserve = p.reserve and l.block_number <= p.block_number group by all""")
def positions_at_many(spark, d):
    keys = A.liquidations(spark, d).select("user", (F.col("block_number") - 1).alias("block_number"))
    return S.positions_at_many(led(spark, d), keys)


@query(cte("ev") + """, s as (select "user", asset as reserve, block_number, cast(amount_raw as double) / 100 * (case event_type when 'Borrow' then 1 else -1 end) + 1000 as principal from ev where event_type in ('Borrow', 'Repay') and k % 3 = 0) select * from s""")
def stable_checkpoints(spark, d):
    return _stable(spark, d)


def _stable(spark, d):
    e = A.events(spark, d).where("event_type in ('Borrow', 'Repay') and k % 3 = 0")
    return e.select("user", F.col("asset").alias("reserve"), "block_number", (F.col("amount_raw").cast("double") / 100 * F.when(F.col("event_type") == "Borrow", 1).otherwise(-1) + 1000).alias("principal"))


_COMP = "case when t <= 0 then 1 else 1 + t * p + t * (t - 1) * p * p / 2 + case when t > 2 then t * (t - 1) * (t - 2) * p * p * p / 6 else 0 end end"


@query(cte("liq") + """, s as (select "user", asset as reserve, block_number, max(cast(amount_raw as double) / 100 * (case event_type when 'Borrow' then 1 else -1 end) + 1000) as principal from ev where event_type in ('Borrow', 'Repay') and k % 3 = 0 group by all),
j as (select l.block_number, l.log_index, s.principal, (l.block_number - s.block_number) * 12.0::double as t, 0.05 / 31536000.0::double as p from liq l asof left join s on l."user" = s."user" and l.debt_asset = s.reserve and l.block_number >= s.block_number)
select block_number, log_index, coalesce(principal * (""" + _COMP + """), 0) as stable_debt from j""")
def stable_debt_units(spark, d):
    q = A.liquidations(spark, d).select("user", F.col("debt_asset").alias("reserve"), "block_number", "log_index")
    r = asof(q, _stable(spark, d).groupBy("user", "reserve", "block_number").agg(F.max("principal").alias("principal")), ["user", "reserve"], "block_number", ["principal"])
    t = (F.col("block_number") - F.col("block_number_r")) * 12.0
    return r.select("block_number", "log_index", F.coalesce(F.col("principal") * interest.compounded(F.lit(0.05), t), F.lit(0.0)).alias("stable_debt"))


@query(cte("ledger") + """, s as (select "user", 'a' || (k % 9) as reserve, min(block_number) as block_number from ev where event_type = 'AnswerUpdated' group by all) select s.* from s where not exists (select 1 from ledger l where l."user" = s."user" and l.reserve = s.reserve)""")
def anchor_missing_pairs(spark, d):
    s = A.events(spark, d).where("event_type = 'AnswerUpdated'").groupBy("user", F.concat(F.lit("a"), F.col("k") % 9).alias("reserve")).agg(F.min("block_number").alias("block_number"))
    return s.join(led(spark, d).select("user", "reserve").distinct(), ["user", "reserve"], "left_anti")


@query(cte("liq", "px") + """, r as (select asset, ord, price from px) select l.block_number, l.log_index, r.ord as at, r.price from (select *, block_number * 1000000 + log_index as ord from liq) l asof left join r on l.debt_asset = r.asset and l.ord > r.ord""")
def asof_join(spark, d):
    q = A.liquidations(spark, d).select("block_number", "log_index", F.col("debt_asset").alias("asset"), (F.col("block_number") * 1000000 + F.col("log_index")).alias("ord"))
    return asof(q, A.price_updates(spark, d).select("asset", "ord", "price"), ["asset"], "ord", ["price"], strict=True, cell=1 << 34, right_t="at").select("block_number", "log_index", "at", "price")


@query(cte("liq", "daily") + """, f as (select asset, min_by(price, day) as first_price from daily group by asset) select l.block_number, l.log_index, coalesce(p.price, first_price) as price from (select *, cast(block_timestamp as date) - 3 as d from liq) l asof left join daily p on l.collateral_asset = p.asset and l.d >= p.day left join f on l.collateral_asset = f.asset""")
def price_asof_daily(spark, d):
    p = A.daily_prices(spark, d).select("asset", F.unix_date("day").alias("t"), "price")
    q = A.liquidations(spark, d).select("block_number", "log_index", F.col("collateral_asset").alias("asset"), (F.unix_date(F.col("block_timestamp").cast("date")) - 3).alias("t"))
    first = p.groupBy("asset").agg(F.min_by("price", "t").alias("first_price"))
    return asof(q, p, ["asset"], "t", ["price"], cell=64).join(first, "asset", "left").select("block_number", "log_index", F.coalesce("price", "first_price").alias("price"))


@query(cte("liq", "px") + """ select l.block_number, l.log_index, case when l.block_number - px.block_number <= 300 then price end as price from (select *, block_number * 1000000 + log_index as ord from liq) l asof left join px on l.collateral_asset = px.asset and l.ord >= px.ord""")
def price_asof_log(spark, d):
    q = A.liquidations(spark, d).select("block_number", "log_index", F.col("collateral_asset").alias("asset"), (F.col("block_number") * 1000000 + F.col("log_index")).alias("ord"))
    r = asof(q, A.price_updates(spark, d).select("asset", "ord", "price", F.col("block_number").alias("pb")), ["asset"], "ord", ["pb", "price"], cell=1 << 34)
    return r.select("block_number", "log_index", F.when(F.col("block_number") - F.col("pb") <= 300, F.col("price")).alias("price"))


_ETH = " from (select * from px where asset <> 'a0') a asof join (select ord, price from px where asset = 'a0') e on a.ord >= e.ord"


@query(cte("px") + " select a.asset, a.ord, a.price * e.price as price_usd" + _ETH)
def price_cross_rate(spark, d):
    return _cross(spark, d).select("asset", "ord", (F.col("price") * F.col("eth")).alias("price_usd"))


def _cross(spark, d):
    p = A.price_updates(spark, d).select("asset", "ord", "price").withColumn("g", F.lit(1))
    eth = p.where("asset = 'a0'").select("g", "ord", F.col("price").alias("eth"))
    return asof(p.where("asset != 'a0'"), eth, ["g"], "ord", ["eth"], cell=1 << 34).where("eth is not null")


_RAW = ", raws as (select asset, ord, cast(round(price * 100) as bigint)::hugeint as raw from px)"


@query(cte("px") + _RAW + """, pts as (select asset, ord from raws where asset <> 'a0' union select a.asset, e.ord from (select distinct asset from raws where asset <> 'a0') a, raws e where e.asset = 'a0'),
two as (select p.asset, p.ord, a.raw as asset_raw, e.raw as eth_raw from pts p asof join raws a on p.asset = a.asset and p.ord >= a.ord asof join (select * from raws where asset = 'a0') e on p.ord >= e.ord),
three as (select p.ord, b.raw as balance, s.raw as supply, x.raw as price from (select ord from raws where asset in ('a1', 'a2', 'a3')) p asof join (select * from raws where asset = 'a1') b on p.ord >= b.ord
   asof join (select * from raws where asset = 'a2') s on p.ord >= s.ord asof join (select * from raws where asset = 'a3') x on p.ord >= x.ord)
select asset, ord, cast(asset_raw * 1000000000000000000::hugeint // eth_raw as varchar) as answer from two where asset_raw > 0 and eth_raw > 0
union all select 'share', ord, cast(price * balance // supply as varchar) from three where supply > 0""")
def combine_feeds(spark, d):
    """Two-feed cross rates at every breakpoint of either feed, and a share price at every breakpoint of three series, in whole numbers."""
    raw = F.round(F.col("price") * 100).cast("decimal(20,0)")
    p = A.price_updates(spark, d).select("asset", "ord", raw.alias("raw"))
    eth = p.where("asset = 'a0'").select(F.explode(F.array(*[F.lit(a) for a, *_ in A.REGISTRY if a != "a0"])).alias("asset"), "ord", F.lit("eth").alias("series"), "raw")
    two = merged_series(p.where("asset != 'a0'").select("asset", "ord", F.lit("own").alias("series"), "raw").unionByName(eth), ["asset"], "ord", "series", "raw", ["own", "eth"], 1 << 34)
    two = two.where("own > 0 and eth > 0").select("asset", "ord", F.expr("cast(cast(own as decimal(18, 0)) * cast(1000000000000000000 as decimal(19, 0)) as decimal(38, 0))").alias("n"), "eth")
    two = two.select("asset", "ord", _floor_div("n", "eth").alias("answer"))
    parts = F.create_map(F.lit("a1"), F.lit("balance"), F.lit("a2"), F.lit("supply"), F.lit("a3"), F.lit("price"))
    three = merged_series(p.select("ord", parts[F.col("asset")].alias("series"), "raw"), [], "ord", "series", "raw", ["balance", "supply", "price"], 1 << 34)
    three = three.where("supply > 0").select(F.lit("share").alias("asset"), "ord", F.expr("cast(cast(price as decimal(18, 0)) * cast(balance as decimal(18, 0)) as decimal(38, 0))").alias("n"), "supply")
    return two.unionByName(three.select("asset", "ord", _floor_div("n", "supply").alias("answer")))


def _floor_div(a: str, b: str):
    """a // b of non-negative whole decimals as text, exact beyond 64 bits: the remainder goes first, so that the division has none."""
    return F.expr(f"cast(cast(({a} - {a} % {b}) / cast({b} as decimal(20, 0)) as decimal(38, 0)) as string)")


@query(cte("liq", "px") + """ select l.block_number, l.log_index, case when l.collateral_asset = 'a0' then 1.0::double when l.collateral_asset = 'a3' and l.block_number >= 150000 then null else price end as price_eth from (select *, block_number * 1000000 + log_index as ord from liq) l asof left join px on l.collateral_asset = px.asset and l.ord >= px.ord""")
def price_eth_numeraire(spark, d):
    q = A.liquidations(spark, d).select("block_number", "log_index", F.col("collateral_asset").alias("asset"), (F.col("block_number") * 1000000 + F.col("log_index")).alias("ord"))
    r = asof(q, A.price_updates(spark, d).select("asset", "ord", "price"), ["asset"], "ord", ["price"], cell=1 << 34)
    over = (F.col("asset") == "a3") & (F.col("block_number") >= 150000)
    return r.select("block_number", "log_index", F.when(F.col("asset") == "a0", 1.0).when(~over, F.col("price")).alias("price_eth"))


@query(cte("liq", "px", "daily") + """ select l.block_number, l.log_index, coalesce(case when l.block_number - x.block_number <= 300 then x.price end, p.price) as price from (select *, block_number * 1000000 + log_index as ord, cast(block_timestamp as date) as d from liq) l asof left join px x on l.collateral_asset = x.asset and l.ord >= x.ord asof left join daily p on l.collateral_asset = p.asset and l.d >= p.day""")
def price_blended(spark, d):
    near = price_asof_log(spark, d)
    p = A.daily_prices(spark, d).select("asset", F.unix_date("day").alias("t"), F.col("price").alias("daily"))
    q = A.liquidations(spark, d).select("block_number", "log_index", F.col("collateral_asset").alias("asset"), F.unix_date(F.col("block_timestamp").cast("date")).alias("t"))
    return asof(q, p, ["asset"], "t", ["daily"], cell=64).join(near, ["block_number", "log_index"]).select("block_number", "log_index", F.coalesce("price", "daily").alias("price"))


@query(STATE + """, e as (select *, min(case when reserve = 'a4' then 0 else 1 end) over (partition by "user") = 1 as all_eth from legs) select "user", reserve, case when all_eth then price / 2 else price end as price, all_eth from e""")
def price_whole_position(spark, d):
    rows = legs(spark, d).withColumn("eth", F.when(F.col("reserve") != "a4", F.col("price") / 2))
    has = F.min(F.when(F.col("reserve") == "a4", 0).otherwise(1)).over(W.partitionBy("user")) == 1
    return rows.withColumn("all_eth", has).select("user", "reserve", F.when(F.col("all_eth"), F.col("eth")).otherwise(F.col("price")).alias("price"), "all_eth")


@query(cte("liq", "px") + """, c as (select asset, block_number + 1 as block_number, max(price) as price from px group by all) select l.block_number, l.log_index, case when l.debt_asset = 'a0' then 1.0::double else c.price end as price from liq l left join c on l.debt_asset = c.asset and l.block_number = c.block_number""")
def price_override_cached(spark, d):
    c = A.price_updates(spark, d).groupBy(F.col("asset").alias("debt_asset"), (F.col("block_number") + 1).alias("block_number")).agg(F.max("price").alias("price"))
    return A.liquidations(spark, d).join(c, ["debt_asset", "block_number"], "left").select("block_number", "log_index", F.when(F.col("debt_asset") == "a0", 1.0).otherwise(F.col("price")).alias("price"))


@query(cte("liq") + """, c as (select asset, block_number, max(0.5::double + 0.1::double * (k % 4)) as lt from ev where event_type = 'Deposit' and event_id % 13 = 0 group by all) select l.block_number, l.log_index, c.lt as threshold from liq l asof left join c on l.collateral_asset = c.asset and l.block_number >= c.block_number""")
def threshold_asof(spark, d):
    c = risk_config(spark, d).groupBy(F.col("asset").alias("collateral_asset"), "block_number").agg(F.max("liquidation_threshold").alias("threshold"))
    return asof(A.liquidations(spark, d), c, ["collateral_asset"], "block_number", ["threshold"]).select("block_number", "log_index", "threshold")


@query(cte("liq", "idx") + """, i as (select reserve, block_number, liquidity_index, rate from idx), j as (select l.block_number, l.log_index, case when l.block_number - i.block_number <= 200 then liquidity_index end as x, (l.block_number - i.block_number) * 12.0::double as t, rate / 31536000.0::double as p from liq l asof left join i on l.debt_asset = i.reserve and l.block_number >= i.block_number) select block_number, log_index, x as index, x * (1 + p * t) as linear_index, x * (""" + _COMP + ") as compounded_index from j")
def index_asof(spark, d):
    i = A.reserve_index(spark, d).select(F.col("reserve").alias("debt_asset"), "block_number", "liquidity_index", "rate")
    r = asof(A.liquidations(spark, d).select("block_number", "log_index", "debt_asset"), i, ["debt_asset"], "block_number", ["liquidity_index", "rate"], tolerance=200)
    t = (F.col("block_number") - F.col("block_number_r")) * 12.0
    x = F.col("liquidity_index")
    return r.select("block_number", "log_index", x.alias("index"), (x * interest.linear(F.col("rate"), t)).alias("linear_index"), (x * interest.compounded(F.col("rate"), t)).alias("compounded_index"))


@query(cte("liq", "idx") + """, e as (select "user", asset, block_number, max(event_id) as event_id from ev where event_type in ('Deposit', 'Borrow') group by all),
j as (select l.debt_asset, l.block_number as late, e.block_number as early from liq l asof join e on l."user" = e."user" and l.debt_asset = e.asset and l.block_number > e.block_number),
g as (select j.debt_asset, (late - early) * 12 / 86400.0::double as days, x.liquidity_index / y.liquidity_index - 1 as growth from j asof left join idx x on j.debt_asset = x.reserve and j.late >= x.block_number asof left join idx y on j.debt_asset = y.reserve and j.early >= y.block_number)
select debt_asset, count(*) as n, avg(days) as mean_days, median(days) as median_days, max(days) as max_days, count(growth) as n_growth, avg(growth) as mean_growth, median(growth) as median_growth, max(growth) as max_growth from g group by all""")
def last_event_before(spark, d):
    """How long before a liquidation its user last deposited or borrowed the reserve, and how much the reserve's index grew in between."""
    e = A.events(spark, d).where("event_type in ('Deposit', 'Borrow')").select("user", F.col("asset").alias("debt_asset"), "block_number", "event_id")
    r = asof(A.liquidations(spark, d).select("user", "debt_asset", "block_number"), e, ["user", "debt_asset"], "block_number", ["event_id"], strict=True).where("event_id is not null")
    index = A.reserve_index(spark, d).select(F.col("reserve").alias("debt_asset"), "block_number", "liquidity_index")
    r = asof(r.drop("event_id").withColumnRenamed("block_number_r", "early"), index, ["debt_asset"], "block_number", ["liquidity_index"])
    r = r.select("debt_asset", ((F.col("block_number") - F.col("early")) * 12 / 86400.0).alias("days"), F.col("early").alias("block_number"), F.col("liquidity_index").alias("late_index"))
    r = asof(r, index, ["debt_asset"], "block_number", ["liquidity_index"])
    r = saved(r.select("debt_asset", "days", (F.col("late_index") / F.col("liquidity_index") - 1).alias("growth")))
    out = r.groupBy("debt_asset").agg(F.count("*").alias("n"), F.avg("days").alias("mean_days"), F.max("days").alias("max_days"), F.count("growth").alias("n_growth"), F.avg("growth").alias("mean_growth"), F.max("growth").alias("max_growth"))
    for c in ("days", "growth"):
        out = out.join(percentiles(r, ["debt_asset"], c, [0.5]).select("debt_asset", F.col("p")[0].alias(f"median_{c}")), "debt_asset", "left")
    return out


@query(STATE + """ select "user", collateral_usd, debt_usd, hf, fully_covered, historical_reliable from hf""")
def health_factor(spark, d):
    return accounts(spark, d)


@query(STATE + """ select "user", collateral_usd, debt_usd from hf order by collateral_usd desc, "user" limit 20""")
def whale_positions(spark, d):
    return accounts(spark, d).select("user", "collateral_usd", "debt_usd").orderBy(F.desc_nulls_last("collateral_usd"), "user").limit(20)


@query(STATE + """ select "user", reserve, round(greatest(collateral, 0) * coalesce(price, 0), 6) as collateral_usd, round(greatest(debt, 0) * coalesce(price, 0), 6) as debt_usd, round(greatest(collateral, 0) * coalesce(price, 0) * coalesce(threshold, 0), 6) as weighted_usd from legs""")
def position_frame(spark, d):
    return frame(spark, d)


def frame(spark, d):
    p, c = F.coalesce("price", F.lit(0.0)), F.greatest("collateral", F.lit(0.0))
    return legs(spark, d).select("user", "reserve", F.round(c * p, 6).alias("collateral_usd"), F.round(F.greatest("debt", F.lit(0.0)) * p, 6).alias("debt_usd"), F.round(c * p * F.coalesce("threshold", F.lit(0.0)), 6).alias("weighted_usd"))


@query(cte("liq") + """ select "user", block_number, log_index, lag(log_index) over (partition by "user", block_number // 500 order by block_number, log_index) as previous, count(*) over (partition by "user", block_number // 500) as cascade_size from liq""")
def prev_trigger(spark, d):
    w = W.partitionBy("user", F.floor(F.col("block_number") / 500))
    return A.liquidations(spark, d).select("user", "block_number", "log_index", F.lag("log_index").over(w.orderBy("block_number", "log_index")).alias("previous"), F.count("*").over(w).alias("cascade_size"))


_TRIGGER = """, keys as (select "user", block_number, log_index, protocol, tx_hash, block_number * 1000000 + log_index as ord, lag(block_number * 1000000 + log_index) over (partition by "user", tx_hash order by block_number, log_index) as after,
  count(*) over (partition by "user", block_number) > 1 or exists (select 1 from ev e where e."user" = liq."user" and e.block_number = liq.block_number and e.tx_hash <> liq.tx_hash and e.log_index < liq.log_index and e.event_type <> 'AnswerUpdated') as precise from liq),
own as (select k."user", k.ord, least(k.ord, min(l.block_number * 1000000 + l.log_index)) as cut from keys k left join ledger l on l."user" = k."user" and l.tx_hash = k.tx_hash and l.block_number * 1000000 + l.log_index > coalesce(k.after, -1) group by k."user", k.ord),
bal as (select k."user", k.block_number, k.log_index, k.protocol, k.ord, r.reserve, coalesce(sum(d_collateral), 0) as collateral, coalesce(sum(d_debt), 0) as debt from keys k join own using ("user", ord) join (select distinct "user", reserve from ledger) r on k."user" = r."user" left join ledger l on l."user" = k."user" and l.reserve = r.reserve
  and case when precise then l.block_number * 1000000 + l.log_index < own.cut else l.block_number < k.block_number end group by all),
rc as (select asset, block_number, max(0.5::double + 0.1::double * (k % 4)) as lt from ev where event_type = 'Deposit' and event_id % 13 = 0 group by all),
tg as (select "user", reserve, block_number, max_by(enabled, log_index) as enabled from toggles group by all),
t1 as (select bal.*, p.price from bal asof left join px p on bal.reserve = p.asset and bal.ord >= p.ord),
t2 as (select t1.*, rc.lt from t1 asof left join rc on t1.reserve = rc.asset and t1.block_number >= rc.block_number),
t3 as (select t2.*, coalesce(tg.enabled, true) as enabled from t2 asof left join tg on t2."user" = tg."user" and t2.reserve = tg.reserve and t2.block_number > tg.block_number),
tl as (select t3.*, coalesce(lt, liquidation_threshold) as threshold, lt is not null or coalesce(historical_reliable, false) as reliable, case when enabled then greatest(collateral, 0) else 0 end as c, greatest(debt, 0) as b from t3 left join reg on t3.reserve = reg.asset),
th as (select "user", block_number, log_index, protocol, case when sum(b * coalesce(price, 0)) > 1e-12 then sum(c * coalesce(price, 0) * coalesce(threshold, 0)) / sum(b * coalesce(price, 0)) end as hf, bool_and(not (c > 1e-12 or b > 1e-12) or price is not null) as fully_covered, bool_and(not (c > 1e-12) or reliable) as historical_reliable from tl group by all),
rep as (select *, hf is not null and fully_covered as measurable, coalesce(hf >= 1.01 and fully_covered, false) as mismatch, coalesce(hf >= 1.0 and fully_covered, false) as mismatch_exact from th)"""
TRIGGER = cte("ledger", "px", "reg", "toggles") + _TRIGGER


@once
def trigger_legs(spark, d):
    """Each trigger's balances, with the price before its log, the threshold at its block and the toggles as of the block before.

    Balances are those of the block before; where the user has another trigger in the block, or earlier activity there
    under another transaction, those just before the trigger's own transaction.
    """
    q = A.liquidations(spark, d).withColumn("ord", F.col("block_number") * 1000000 + F.col("log_index"))
    same = W.partitionBy("user", "block_number")
    q = q.withColumn("several", F.count("*").over(same) > 1).withColumn("after", F.lag("ord").over(W.partitionBy("user", "tx_hash").orderBy("ord")))
    earlier = same_block_earlier(q, A.events(spark, d, "event_type != 'purchase'")).select("user", "ord", F.lit(True).alias("earlier"))
    q = saved(q.join(earlier, ["user", "ord"], "left").select("user", "block_number", "log_index", "protocol", "tx_hash", "ord", "after", (F.col("several") | F.col("earlier").isNotNull()).alias("precise")))
    ledger = saved(led(spark, d).withColumn("ord", F.col("block_number") * 1000000 + F.col("log_index")))
    key = ["user", "block_number", "log_index", "protocol", "ord"]
    solo = q.where("not precise")
    pos = S.positions_at_many(ledger, solo.select("user", (F.col("block_number") - 1).alias("block_number")))
    rows = solo.select(*key).join(pos.withColumn("block_number", F.col("block_number") + 1), ["user", "block_number"])
    own = q.where("precise").withColumnRenamed("tx_hash", "tx")
    exact = S.positions_before(ledger.withColumnRenamed("tx_hash", "tx"), own.select("user", "tx", "ord", "after")).join(own.select(*key), ["user", "ord"])
    columns = [*key, "reserve", "collateral", "debt"]
    rows = rows.select(*columns).unionByName(exact.select(*columns))
    rows = asof(rows, A.price_updates(spark, d).select(F.col("asset").alias("reserve"), "ord", "price"), ["reserve"], "ord", ["price"], cell=1 << 34).drop("ord_r")
    config = risk_config(spark, d).groupBy(F.col("asset").alias("reserve"), "block_number").agg(F.max("liquidation_threshold").alias("lt"))
    rows = asof(rows, config, ["reserve"], "block_number", ["lt"]).drop("block_number_r")
    toggles = A.toggles(spark, d).groupBy("user", "reserve", "block_number").agg(F.max_by("enabled", "log_index").alias("on"))
    rows = asof(rows, toggles, ["user", "reserve"], "block_number", ["on"], strict=True).drop("block_number_r")
    reg = A.registry(spark).select(F.col("asset").alias("reserve"), "liquidation_threshold", "historical_reliable")
    rows = rows.join(F.broadcast(reg), "reserve", "left")  # a row per reserve of the registry
    reliable = F.col("lt").isNotNull() | F.coalesce("historical_reliable", F.lit(False))
    return rows.select(*columns, "price", F.coalesce("lt", "liquidation_threshold").alias("threshold"), reliable.alias("reliable"), F.coalesce("on", F.lit(True)).alias("enabled"))


@once
def trigger_report(spark, d):
    hf = S.health_factor(trigger_legs(spark, d), ["user", "block_number", "log_index", "protocol"])
    ok, at = F.col("fully_covered"), lambda x: F.coalesce((F.col("hf") >= x) & F.col("fully_covered"), F.lit(False))
    return hf.select("user", "block_number", "log_index", "protocol", "hf", "fully_covered", "historical_reliable", (F.col("hf").isNotNull() & ok).alias("measurable"), at(1.01).alias("mismatch"), at(1.0).alias("mismatch_exact"))


@query(TRIGGER + " select * from rep")
def hf_at_trigger(spark, d):
    return trigger_report(spark, d)


@query(TRIGGER + " select coalesce(protocol, 'OVERALL') as protocol, count(*) as triggers, count(*) filter (where measurable) as measurable, count(*) filter (where measurable) / count(*) as coverage, count(*) filter (where mismatch) / nullif(count(*) filter (where measurable), 0) as rate, count(*) filter (where mismatch_exact) / nullif(count(*) filter (where measurable), 0) as rate_exact from rep group by rollup(protocol)")
def mismatch_summary(spark, d):
    n = F.count_if("measurable")
    return trigger_report(spark, d).rollup("protocol").agg(F.count("*").alias("triggers"), n.alias("measurable"), (n / F.count("*")).alias("coverage"), F.try_divide(F.count_if("mismatch"), n).alias("rate"), F.try_divide(F.count_if("mismatch_exact"), n).alias("rate_exact")).withColumn("protocol", F.coalesce("protocol", F.lit("OVERALL")))


@query(TRIGGER + """ select l.tx_hash, l.log_index, r.hf, r.mismatch from liq l left join rep r using ("user", block_number, log_index)""")
def diagnostics_join(spark, d):
    r = trigger_report(spark, d).select("user", "block_number", "log_index", "hf", "mismatch")
    return A.liquidations(spark, d).join(r, ["user", "block_number", "log_index"], "left").select("tx_hash", "log_index", "hf", "mismatch")


@query(STATE + """ select pos.reserve, count(*) as n, avg(pos.debt - o.debt) as mean_diff, max(abs(pos.debt - o.debt)) as max_diff, count(*) filter (where o.debt is null) as n_missing from pos left join (select "user", reserve, floor(debt + 0.123) as debt from pos where reserve <> 'a3') o using ("user", reserve) group by all""")
def ledger_crosscheck(spark, d):
    p = S.positions_at(led(spark, d), AT)
    o = p.where("reserve != 'a3'").select("user", "reserve", F.floor(F.col("debt") + 0.123).alias("seen"))
    diff = F.col("debt") - F.col("seen")
    return p.join(o, ["user", "reserve"], "left").groupBy("reserve").agg(F.count("*").alias("n"), F.avg(diff).alias("mean_diff"), F.max(F.abs(diff)).alias("max_diff"), F.count_if(F.col("seen").isNull()).alias("n_missing"))


@query(cte("ev") + """, s as (select event_type, block_number, log_index, sum(cast(amount_raw as hugeint)) over w as hi, sum(event_id) over w as lo from ev where event_type in ('Deposit', 'Withdraw') window w as (partition by event_type order by block_number, log_index rows unbounded preceding))
select event_type, block_number, log_index, case when event_type = 'Withdraw' then '-' else '' end || ltrim(cast(hi as varchar) || lpad(cast(lo as varchar), 42, '0'), '0') as total from s""")
def signed_supply(spark, d):
    """Running supply by kind, in text: amounts of up to 256 bits (here the raw amount followed by 42 digits of the event's id) signed by their kind."""
    rows = A.events(spark, d).where("event_type in ('Deposit', 'Withdraw')")
    raw = F.concat("amount_raw", F.lpad(F.col("event_id").cast("string"), 42, "0"))
    sign = F.when(F.col("event_type") == "Withdraw", -1).otherwise(1)
    rows = rows.select("event_type", "block_number", "log_index", *[c.alias(f"raw{k}") for k, c in enumerate(exact.limbs(raw, sign))])
    names = [f"limb{k}" for k in range(exact.LIMBS)]
    out = running(rows, ["event_type"], "block_number", ["block_number", "log_index"], **{n: ("sum", F.col(f"raw{k}")) for k, n in enumerate(names)})
    return out.select("event_type", "block_number", "log_index", exact.to_text([F.col(n) for n in names]).alias("total"))

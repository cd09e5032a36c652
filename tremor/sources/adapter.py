"""The canonical event view over the given tables, and the tables derived from it.

Every table is a plain DataFrame; SQL holds the same definitions for the DuckDB oracle as CTEs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENESIS_US, BLOCK_US = 1704067200000000, 12000000
#: Blocks of a cascade's window, between two waves of it, and of a bar. Fixed: ten, ten and two times the usual 100, 20 and 5,
#: as the given month of events is thin.
WINDOW, LAG, BAR = 1000, 200, 10
#: The label grid: widths, ten times the usual ones, least positions, and percentiles; and its primary point.
WIDTHS, POSITIONS, THETAS = (500, 1000, 3000), (3, 5, 10), (90.0, 95.0, 99.0)
PRIMARY = (WINDOW, 5, 95.0)
#: asset, decimals, liquidation threshold (fixed values)
REGISTRY = [("a0", 2, 0.80), ("a1", 2, 0.75), ("a2", 2, 0.70), ("a3", 2, 0.65), ("a4", 2, 0.005)]

#: event name in the given table -> canonical type; view is split by the event's parity
_KINDS = "case event_type when 'error' then 'LiquidationCall' when 'signup' then 'Deposit' when 'click' then 'Borrow' when 'purchase' then 'AnswerUpdated' else case when event_id % 2 = 0 then 'Repay' else 'Withdraw' end end"

SQL = {
    "ev": f"""ev as (select *, case when event_type = 'LiquidationCall' then asset end as collateral_asset,
        case when event_type = 'LiquidationCall' then 'a' || ((k + 1) % 5) else asset end as debt_asset,
        case when event_type = 'LiquidationCall' then cast(cast(round(amount_usd * 105) as bigint) as varchar) end as collateral_seized_raw
        from (select cast(floor((epoch_us(ts) - {GENESIS_US}) / {BLOCK_US}) as bigint) as block_number, cast(event_id as int) as log_index, ts as block_timestamp,
        'tx' || event_id as tx_hash, case when event_id % 3 = 0 then 'p1' else 'p0' end as protocol, {_KINDS} as event_type, 'u' || user_id as "user",
        cast(json_extract_string(props, '$.k') as bigint) as k, 'a' || (cast(json_extract_string(props, '$.k') as bigint) % 5) as asset,
        cast(cast(round(value * 100) as bigint) as varchar) as amount_raw, value as amount_usd, event_id from events))""",
    "liq": """liq as (select *, "user" || '|' || coalesce(collateral_asset, '') || '|' || coalesce(debt_asset, '') as position_id from ev where event_type = 'LiquidationCall')""",
    "px": """px as (select asset, 'f' || (k % 5) as feed, block_number, log_index, block_timestamp, cast(amount_raw as double) / 100 as price, block_number * 1000000 + log_index as ord from ev where event_type = 'AnswerUpdated')""",
    "idx": """idx as (select asset as reserve, block_number, max(block_timestamp) as block_timestamp, 1 + block_number / 1e7 as liquidity_index, 0.03::double as rate from ev where event_type = 'AnswerUpdated' group by asset, block_number)""",
    "reg": "reg as (select * from (values " + ", ".join(f"('{a}', {d}, {t}::double, {str(t > 0.01).lower()})" for a, d, t in REGISTRY) + ") v(asset, decimals, liquidation_threshold, historical_reliable))",
    "toggles": """toggles as (select "user", asset as reserve, block_number, log_index, event_type = 'Deposit' as enabled from ev where (event_type = 'Withdraw' and event_id % 7 = 0) or (event_type = 'Deposit' and event_id % 11 = 0))""",
    "daily": """daily as (select asset, cast(block_timestamp as date) as day, avg(cast(amount_raw as double) / 100) as price from ev where event_type = 'AnswerUpdated' group by all)""",
    "grid": f"grid as (select {WINDOW} as w, {LAG} as lag, {BAR} as bw)",
    "ledger": """ledger as (select block_number, log_index, tx_hash, "user", debt_asset as reserve, case event_type when 'Deposit' then 1 when 'Withdraw' then -1 else 0 end * cast(amount_raw as double) / 100 as d_collateral,
        case event_type when 'Borrow' then 1 when 'Repay' then -1 else 0 end * cast(amount_raw as double) / 100 as d_debt from ev where event_type in ('Deposit', 'Withdraw', 'Borrow', 'Repay')
        union all select block_number, log_index, tx_hash, "user", debt_asset, 0, -cast(amount_raw as double) / 100 from liq
        union all select block_number, log_index, tx_hash, "user", collateral_asset, -cast(collateral_seized_raw as double) / 100, 0 from liq)""",
}
_NEEDS = {"liq": ["ev"], "px": ["ev"], "idx": ["ev"], "toggles": ["ev"], "daily": ["ev"], "grid": ["liq"], "ledger": ["ev", "liq"], "ev": [], "reg": []}


def cte(*names: str) -> str:
    """`with` and the named definitions with all that they need."""
    done: list[str] = []

    def add(n):
        for m in _NEEDS[n]:
            add(m)
        if n not in done:
            done.append(n)

    for n in names:
        add(n)
    return "with " + ",\n".join(SQL[n] for n in done)


def events(spark: SparkSession, sf_dir: str, raw: str | None = None) -> DataFrame:
    """The canonical events; `raw` is a condition on the table's own columns, which reaches the scan."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    if raw:
        e = e.where(raw)
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.expr(_KINDS)
    rows = e.select(
        F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - GENESIS_US) / BLOCK_US).cast("long").alias("block_number"),
        F.col("event_id").cast("int").alias("log_index"),
        F.col("ts").alias("block_timestamp"),
        F.concat(F.lit("tx"), F.col("event_id")).alias("tx_hash"),
        F.when(F.col("event_id") % 3 == 0, "p1").otherwise("p0").alias("protocol"),
        kind.alias("event_type"),
        F.concat(F.lit("u"), F.col("user_id")).alias("user"),
        k.alias("k"),
        F.concat(F.lit("a"), k % 5).alias("asset"),
        F.round(F.col("value") * 100).cast("long").cast("string").alias("amount_raw"),
        F.col("value").alias("amount_usd"),
        "event_id",
    )
    liq = F.col("event_type") == "LiquidationCall"
    return rows.select("*", F.when(liq, F.col("asset")).alias("collateral_asset"), F.when(liq, F.concat(F.lit("a"), (F.col("k") + 1) % 5)).otherwise(F.col("asset")).alias("debt_asset"), F.when(liq, F.round(F.col("amount_usd") * 105).cast("long").cast("string")).alias("collateral_seized_raw"))


def liquidations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremor.operators.filters import with_position_id

    return with_position_id(events(spark, sf_dir, "event_type = 'error'"))


def price_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir, "event_type = 'purchase'")
    return e.select("asset", F.concat(F.lit("f"), F.col("k") % 5).alias("feed"), "block_number", "log_index", "block_timestamp", (F.col("amount_raw").cast("double") / 100).alias("price"), (F.col("block_number") * 1000000 + F.col("log_index")).alias("ord"))


def reserve_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir, "event_type = 'purchase'")
    return e.groupBy(F.col("asset").alias("reserve"), "block_number").agg(F.max("block_timestamp").alias("block_timestamp")).select("*", (1 + F.col("block_number") / 1e7).alias("liquidity_index"), F.lit(0.03).alias("rate"))


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, d, t, t > 0.01) for a, d, t in REGISTRY], "asset string, decimals int, liquidation_threshold double, historical_reliable boolean")


def toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("(event_type = 'Withdraw' and event_id % 7 = 0) or (event_type = 'Deposit' and event_id % 11 = 0)")
    return e.select("user", F.col("asset").alias("reserve"), "block_number", "log_index", (F.col("event_type") == "Deposit").alias("enabled"))


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir, "event_type = 'purchase'")
    return e.groupBy("asset", F.col("block_timestamp").cast("date").alias("day")).agg(F.avg(F.col("amount_raw").cast("double") / 100).alias("price"))

"""Ledger, balances as of blocks, prices and health factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremor.operators.asof import asof_join
from tremor.operators.filters import without_dust

EPS = 1e-12


def ledger(events: DataFrame, decimals: int = 2) -> DataFrame:
    """Signed deltas (block_number, log_index, tx_hash, user, reserve, d_collateral, d_debt); a liquidation gives two rows."""
    kind, scale = F.col("event_type"), 10.0**decimals
    a, s = F.col("amount_raw").cast("double") / scale, F.col("collateral_seized_raw").cast("double") / scale
    row = lambda r, c, d: F.struct(r.alias("reserve"), c.alias("d_collateral"), d.alias("d_debt"))
    zero = F.lit(0.0)
    c = F.when(kind == "Deposit", a).when(kind == "Withdraw", -a).otherwise(zero)
    d = F.when(kind == "Borrow", a).when(kind == "Repay", -a).otherwise(zero)
    legs = F.when(kind == "LiquidationCall", F.array(row(F.col("debt_asset"), zero, -a), row(F.col("collateral_asset"), -s, zero))).when(kind.isin("Deposit", "Withdraw", "Borrow", "Repay"), F.array(row(F.col("debt_asset"), c, d)))
    return events.select("block_number", "log_index", "tx_hash", "user", F.inline(legs))


def cumulative(led: DataFrame) -> DataFrame:
    w = W.partitionBy("user", "reserve").orderBy("block_number", "log_index", "d_debt").rowsBetween(W.unboundedPreceding, 0)
    return led.select("*", F.sum("d_collateral").over(w).alias("collateral"), F.sum("d_debt").over(w).alias("debt"))


def positions_at(led: DataFrame, block: int, dust: float = 1e-9) -> DataFrame:
    p = led.where(F.col("block_number") <= block).groupBy("user", "reserve").agg(F.sum("d_collateral").alias("collateral"), F.sum("d_debt").alias("debt"))
    return without_dust(p, dust)


def positions_at_many(led: DataFrame, keys: DataFrame) -> DataFrame:
    """Balances after `block_number` for keys (user, block_number), of every reserve the user ever touched."""
    per = led.groupBy("user", "reserve", "block_number").agg(F.sum("d_collateral").alias("c"), F.sum("d_debt").alias("d"))
    w = W.partitionBy("user", "reserve").orderBy("block_number").rowsBetween(W.unboundedPreceding, 0)
    run = per.select("user", "reserve", "block_number", F.sum("c").over(w).alias("collateral"), F.sum("d").over(w).alias("debt"))
    pairs = keys.select("user", "block_number").distinct().join(led.select("user", "reserve").distinct(), "user")
    got = asof_join(pairs, run, ["user", "reserve"], "block_number", ["collateral", "debt"])
    return got.select("user", "block_number", "reserve", F.coalesce("collateral", F.lit(0.0)).alias("collateral"), F.coalesce("debt", F.lit(0.0)).alias("debt"))


def positions_before(led: DataFrame, triggers: DataFrame) -> DataFrame:
    """Balances just before triggers (user, tx, ord, after), without what their own transaction did before them.

    led: user, reserve, tx, ord, d_collateral, d_debt. The cutoff is the first ledger row of the trigger's user and
    transaction after `after`, the trigger before it there (null: none), or the trigger itself. Of every reserve the
    user ever touched: (user, ord, reserve, collateral, debt).
    """
    own = triggers.join(led.select("user", "tx", F.col("ord").alias("__own")), ["user", "tx"], "left")
    first = F.min(F.when(F.col("__own") > F.coalesce("after", F.lit(-1)), F.col("__own")))
    cut = own.groupBy("user", "ord").agg(first.alias("__first")).select("user", "ord", F.least("ord", "__first").alias("cut"))
    per = led.groupBy("user", "reserve", F.col("ord").alias("cut")).agg(F.sum("d_collateral").alias("c"), F.sum("d_debt").alias("d"))
    w = W.partitionBy("user", "reserve").orderBy("cut").rowsBetween(W.unboundedPreceding, 0)
    run = per.select("user", "reserve", "cut", F.sum("c").over(w).alias("collateral"), F.sum("d").over(w).alias("debt"))
    pairs = cut.join(led.select("user", "reserve").distinct(), "user")
    got = asof_join(pairs, run, ["user", "reserve"], "cut", ["collateral", "debt"], strict=True, cell=1 << 34)
    return got.select("user", "ord", "reserve", F.coalesce("collateral", F.lit(0.0)).alias("collateral"), F.coalesce("debt", F.lit(0.0)).alias("debt"))


def health_factor(legs: DataFrame, by: list[str]) -> DataFrame:
    """legs: by.., collateral, debt, price, threshold, reliable, enabled -> hf (null without debt), fully_covered, historical_reliable.

    Disabled collateral neither counts nor needs a price.
    """
    c = F.when(F.coalesce("enabled", F.lit(True)), F.greatest("collateral", F.lit(0.0))).otherwise(0.0)
    debt = F.greatest("debt", F.lit(0.0))
    used = (c > EPS) | (debt > EPS)
    rows = legs.withColumn("__c", c).withColumn("__d", debt).withColumn("__u", used)
    g = rows.groupBy(*by).agg(F.sum(F.col("__c") * F.coalesce("price", F.lit(0.0)) * F.coalesce("threshold", F.lit(0.0))).alias("weighted"), F.sum(F.col("__c") * F.coalesce("price", F.lit(0.0))).alias("collateral_usd"), F.sum(F.col("__d") * F.coalesce("price", F.lit(0.0))).alias("debt_usd"), F.bool_and(~F.col("__u") | F.col("price").isNotNull()).alias("fully_covered"), F.bool_and(~(F.col("__c") > EPS) | F.coalesce("reliable", F.lit(False))).alias("historical_reliable"))
    return g.select(*by, "collateral_usd", "debt_usd", F.when(F.col("debt_usd") > EPS, F.col("weighted") / F.col("debt_usd")).alias("hf"), "fully_covered", "historical_reliable")

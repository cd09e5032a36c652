"""Keys, dedup, sanity counts and small filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NATURAL_KEY = ["tx_hash", "log_index", "user"]
ADDRESSES = ["user", "liquidator", "collateral_asset", "debt_asset", "tx_hash"]


def with_position_id(df: DataFrame) -> DataFrame:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("user", "collateral_asset", "debt_asset")]
    return df.withColumn("position_id", F.concat_ws("|", *parts))


def dedup_events(df: DataFrame, key=NATURAL_KEY) -> DataFrame:
    """One row per key, the first by block and log; nulls are equal to each other."""
    w = W.partitionBy(*key).orderBy("block_number", "log_index", "amount_raw")
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def count_duplicates(df: DataFrame, key=NATURAL_KEY) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def usd_sanity(df: DataFrame, ceiling: float = 5e8, liquidation_ceiling: float = 5e9) -> DataFrame:
    """Counts of null, negative, non-finite and too large USD values; infinities count as non-finite."""
    usd = F.col("amount_usd")
    bad = F.isnan(usd) | (F.abs(usd) == float("inf"))
    top = F.when(F.col("event_type") == "LiquidationCall", liquidation_ceiling).otherwise(ceiling)
    return df.agg(F.count("*").alias("n"), F.count_if(usd.isNull()).alias("n_null"), F.count_if(usd < 0).alias("n_negative"), F.count_if(F.coalesce(bad, F.lit(False))).alias("n_non_finite"), F.count_if(F.coalesce((usd > top) & ~bad, F.lit(False))).alias("n_too_large"))


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`."""
    w = W.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def same_block_earlier(triggers: DataFrame, activity: DataFrame) -> DataFrame:
    """The triggers whose user has activity in the same block under another transaction and a lower log index."""
    first = activity.groupBy(F.col("user").alias("__u"), F.col("block_number").alias("__b"), F.col("tx_hash").alias("__tx")).agg(F.min("log_index").alias("__first"))
    cond = (F.col("user") == F.col("__u")) & (F.col("block_number") == F.col("__b")) & (F.col("__tx") != F.col("tx_hash")) & (F.col("__first") < F.col("log_index"))
    return triggers.join(first, cond, "left_semi")


def withdraw_owners(withdraws: DataFrame, transfers: DataFrame) -> DataFrame:
    """(tx, log_index, owner): the sender of the last transfer before each withdrawal in its transaction, of the same token and exact amount."""
    t = transfers.select("tx", "token", "amount", F.col("log_index").alias("__log"), F.col("user").alias("__from"))
    met = withdraws.select("tx", "token", "amount", "log_index").join(t, ["tx", "token", "amount"]).where("__log < log_index")
    return met.groupBy("tx", "log_index").agg(F.max_by("__from", "__log").alias("owner"))


def without_dust(positions: DataFrame, dust: float = 1e-9) -> DataFrame:
    """Positions of which a leg (collateral, debt) is more than `dust`."""
    return positions.where((F.abs("collateral") > dust) | (F.abs("debt") > dust))

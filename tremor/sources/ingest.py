"""Canonical schema, source projections and log decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANONICAL = T.StructType([
    T.StructField("chain_id", T.IntegerType()), T.StructField("block_number", T.LongType()), T.StructField("block_timestamp", T.TimestampType()),
    T.StructField("tx_hash", T.StringType()), T.StructField("log_index", T.IntegerType()), T.StructField("protocol", T.StringType()),
    T.StructField("event_type", T.StringType()), T.StructField("user", T.StringType()), T.StructField("liquidator", T.StringType()),
    T.StructField("collateral_asset", T.StringType()), T.StructField("debt_asset", T.StringType()), T.StructField("amount_raw", T.StringType()),
    T.StructField("amount_usd", T.DoubleType()), T.StructField("collateral_seized_raw", T.StringType()), T.StructField("collateral_seized_usd", T.DoubleType()),
])
LOWERED = {"tx_hash", "user", "liquidator", "collateral_asset", "debt_asset"}


def normalize_events(df: DataFrame, protocol: str | None = None) -> DataFrame:
    """df in the canonical schema: absent columns null, addresses lower-cased, all cast and ordered."""
    have = set(df.columns)
    out = []
    for f in CANONICAL:
        c = F.lit(protocol) if f.name == "protocol" and protocol else F.col(f"`{f.name}`") if f.name in have else F.lit(None)
        c = c.cast(f.dataType)
        out.append((F.lower(c) if f.name in LOWERED else c).alias(f.name))
    return df.select(out)


def rename_columns(df: DataFrame, mapping: dict[str, str], file_name: Column) -> DataFrame:
    """Source columns under canonical names (several sources of one name coalesce in order), chain_id from a file name like chain_1."""
    targets: dict[str, list[str]] = {}
    for old, new in mapping.items():
        if old in df.columns:
            targets.setdefault(new, []).append(old)
    return df.select(F.try_to_number(F.nullif(F.regexp_extract(file_name, r"chain[_=](\d+)", 1), F.lit("")), F.lit("999999")).cast("int").alias("chain_id"), *[F.coalesce(*[F.col(c) for c in old]).alias(new) for new, old in targets.items()])


def core_events(parts: dict[str, DataFrame], prices: DataFrame, low: int, high: int) -> DataFrame:
    """UNION ALL of event tables (asset, raw, decimals, block_number, minute, ..) between two blocks, valued with a left join on (asset, minute)."""
    rows = None
    for kind, df in parts.items():
        df = df.withColumn("event_type", F.lit(kind))
        rows = df if rows is None else rows.unionByName(df)
    rows = rows.where(F.col("block_number").between(low, high))
    return priced(rows, prices, "asset", "amount_raw", "amount_usd")


def priced(rows: DataFrame, prices: DataFrame, asset: str, raw: str, out: str) -> DataFrame:
    """rows with `out` = raw / 100 * price at (asset, minute); null without a price or a number."""
    p = prices.select(F.col("asset").alias("__a"), F.col("minute").alias("__m"), F.col("price").alias("__p"))
    joined = rows.join(p, (F.col(asset) == F.col("__a")) & (F.col("minute") == F.col("__m")), "left")
    return joined.withColumn(out, F.expr(f"try_cast({raw} as double)") / 100 * F.col("__p")).drop("__a", "__m", "__p")


def address(word: Column) -> Column:
    return F.lower(F.concat(F.lit("0x"), F.right(word, F.lit(40))))


def hex_int(h: Column) -> Column:
    """A hex number of up to 63 bits; 0x and empty are 0."""
    digits = F.regexp_replace(h, "^0x", "")
    return F.when(digits == "", F.lit(0)).otherwise(F.conv(digits, 16, 10).cast("long")).cast("long")


def data_word(data: Column, i: int) -> Column:
    """The i-th word of 64 hex digits."""
    return F.substring(data, 3 + 64 * i, 64)


def word_text(word: Column, signed: bool = False) -> Column:
    """A big-endian word of up to 64 hex digits as decimal text, exactly; `signed`: two's complement of 256 bits.

    The word is read in groups of 7 digits into limbs of 10**9, each step a multiplication and a carry, as no SQL number holds 78 digits.
    """
    digits = F.lower(F.regexp_replace(word, "^0x", ""))
    negative = F.lit(signed) & (F.length(digits) == 64) & (F.substring(digits, 1, 1) >= "8")
    flipped = F.translate(digits, "0123456789abcdef", "fedcba9876543210")  # 2**256 - 1 - x; one is added below
    hexes = F.lpad(F.when(negative, flipped).otherwise(digits), 70, "0")
    groups = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.conv(F.substring(hexes, i * 7 + 1, F.lit(7)), 16, 10).cast("long"))
    carried = lambda limbs, factor, start: F.aggregate(
        limbs,
        F.struct(F.array().cast("array<bigint>").alias("out"), start.cast("bigint").alias("carry")),
        lambda a, x: F.struct(F.concat(a["out"], F.array((x * factor + a["carry"]) % 10**9)).alias("out"), F.floor((x * factor + a["carry"]) / 10**9).cast("bigint").alias("carry")),
        lambda a: a["out"],
    )
    zero = F.array_repeat(F.lit(0).cast("bigint"), 9)
    limbs = F.aggregate(groups, zero, lambda a, g: carried(a, F.lit(1 << 28), g))
    limbs = carried(limbs, F.lit(1), F.when(negative, 1).otherwise(0))
    text = F.ltrim(F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 9, "0")), ""), F.lit("0"))
    text = F.when(text == "", "0").otherwise(text)
    return F.when(negative, F.concat(F.lit("-"), text)).otherwise(text)


def decode_liquidation_logs(logs: DataFrame) -> DataFrame:
    """Raw logs (topics, data, blockNumber, logIndex, transactionHash) -> typed rows; amounts of up to 256 bits as decimal text."""
    topic = lambda i: address(F.element_at("topics", i))
    amount = lambda i: word_text(data_word(F.col("data"), i))
    return logs.select(
        hex_int(F.col("blockNumber")).alias("block_number"), hex_int(F.col("logIndex")).cast("int").alias("log_index"), F.col("transactionHash").alias("tx_hash"),
        topic(2).alias("collateral_asset"), topic(3).alias("debt_asset"), topic(4).alias("user"), amount(0).alias("amount_raw"), amount(1).alias("collateral_seized_raw"),
    )

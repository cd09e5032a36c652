"""Fixed-width block bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremor.sources.shared import saved


def bounds(events: DataFrame) -> tuple[int, int]:
    r = events.agg(F.min("block_number").alias("a"), F.max("block_number").alias("b")).first()
    return (r.a or 0), (r.b or 0)


def dense_bars(liq: DataFrame, width: int, origin: int | None = None, end: int | None = None) -> DataFrame:
    """(i, start_block, end_block, n_liquidations, liquidated_usd) from the first to the last block, quiet bars kept.

    Bars are [start, end), and the last is closed on the right; a stream inside one block makes one bar. With `origin` the
    edges are fixed there, and with `end` only bars that close by it are kept, none closed on the right.
    """
    if origin is None:
        lo, hi = bounds(liq)
        n = max(1, -(-(hi - lo) // width))
        slot = F.least(F.floor((F.col("block_number") - lo) / width), F.lit(n - 1))
    else:
        lo, n = origin, max(0, (end - origin) // width)
        slot = F.floor((F.col("block_number") - lo) / width)
    counts = liq.groupBy(slot.cast("long").alias("i")).agg(F.count("*").alias("n"), F.sum("amount_usd").alias("usd"))
    bars = liq.sparkSession.range(n).withColumnRenamed("id", "i").join(counts, "i", "left")
    return bars.select("i", (F.col("i") * width + lo).alias("start_block"), (F.col("i") * width + lo + width).alias("end_block"), F.coalesce("n", F.lit(0)).alias("n_liquidations"), F.coalesce("usd", F.lit(0.0)).alias("liquidated_usd"))


def channel_counts(liq: DataFrame, width: int, origin: int, channels: list[str]) -> DataFrame:
    slot = F.floor((F.col("block_number") - origin) / width).cast("long").alias("i")
    return liq.groupBy(slot).pivot("collateral_asset", channels).count().na.fill(0, channels)


def stress_windows(bars: DataFrame, window: int, least: int, z: float) -> DataFrame:
    """[start_block, next start) of runs of bars whose USD is z deviations above the mean of the `window` bars before them."""
    from tremor.operators.intervals import runs, trailing

    rows = trailing(bars, [], "i", window + 1, m=lambda w: F.avg("liquidated_usd").over(w.rowsBetween(-window, -1)), s=lambda w: F.stddev_pop("liquidated_usd").over(w.rowsBetween(-window, -1)), c=lambda w: F.count("*").over(w.rowsBetween(-window, -1)))
    hot = rows.where((F.col("c") >= least) & (F.col("s") > 0) & (F.col("liquidated_usd") - F.col("m") >= z * F.col("s")))
    found = runs(hot, [], "i", 1)
    return found.groupBy("run").agg(F.min("start_block").alias("start_block"), F.max("end_block").alias("end_block"), F.count("*").alias("n_bars")).drop("run")


def percentiles(df: DataFrame, by: list[str], value: str, at: list[float], cells: int = 4096) -> DataFrame:
    """(by.., p): exact percentiles of a column for each key, interpolated, as an array in the order of `at`.

    Values are counted, then counted by cells between a key's least and greatest; only the cells that hold the wanted ranks
    are sorted, so no task takes all values of a key. Null values take no part.
    """
    v = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    one = F.lit(1).alias("__one")
    v = saved(v.withColumn("__one", one))
    by = [*by, "__one"]
    ends = v.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    slot = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells), F.lit(cells - 1))).otherwise(0)
    rows = v.join(F.broadcast(ends), by).withColumn("cell", slot) if len(by) == 1 else v.join(ends, by).withColumn("cell", slot)
    sums = rows.groupBy(*by, "cell", "total").agg(F.sum("n").alias("c"))
    sums = sums.withColumn("before", F.sum("c").over(W.partitionBy(*by).orderBy("cell")) - F.col("c"))  # a row per cell
    ranks = lambda q, i: F.array(*[F.struct(i.alias("i"), q.alias("q"), up(q * (F.col("total") - 1)).cast("long").alias("rank"), F.lit(k).alias("k")) for k, up in enumerate((F.floor, F.ceil))])
    want = F.explode(F.flatten(F.transform(F.array(*[F.lit(float(q)) for q in at]), ranks)))
    asked = sums.select(*by, "cell", "before", "c", "total", want.alias("__want")).where((F.col("__want.rank") >= F.col("before")) & (F.col("__want.rank") < F.col("before") + F.col("c")))
    inside = rows.join(asked.select(*by, "cell", "before").distinct(), [*by, "cell"])
    upto = F.sum("n").over(W.partitionBy(*by, "cell").orderBy("v"))
    inside = inside.select(*by, "cell", "v", (F.col("before") + upto - F.col("n")).alias("a"), (F.col("before") + upto).alias("b"))
    got = asked.join(inside, [*by, "cell"]).where((F.col("__want.rank") >= F.col("a")) & (F.col("__want.rank") < F.col("b")))
    pick = lambda k: F.max(F.when(F.col("__want.k") == k, F.col("v")))
    each = got.groupBy(*by, F.col("__want.i").alias("i"), (F.col("__want.q") * (F.col("total") - 1)).alias("at")).agg(pick(0).alias("low"), pick(1).alias("high"))
    value_at = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high"))
    out = each.select(*by, "i", value_at.alias("x")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("p"))
    return out.drop("__one")


def ranked(df: DataFrame, order: str) -> DataFrame:
    """df with `place`, 0, 1, .. in the order of a column. Rows are sorted in ranges, and only the ranges' sizes reach the driver."""
    rows = saved(df.orderBy(order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__at", 33)
    starts, before = {}, 0
    for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row per range
        starts[r.part], before = before, before + r.n
    if not starts:
        return rows.withColumnRenamed("__at", "place")
    first = F.create_map(*[F.lit(x) for k, v in starts.items() for x in (k, v)])
    return rows.withColumn("place", first[part] + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at")

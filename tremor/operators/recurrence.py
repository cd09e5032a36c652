"""The decayed history R_i = d * (R_{i-1} + m_{i-1}) as a chunked scan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def decayed_history(df: DataFrame, by: list[str], order: str, mark: str, beta: float | Column, out: str = "r", start: float = 0.0, least: float | None = None) -> DataFrame:
    """df with `out` = sum over earlier rows j of mark_j * exp(-beta * (i - j)), i being the integer `order` (gaps decay too).

    Rows are cut into chunks of about 64 / beta units. Within a chunk it is a scaled running sum; what a chunk leaves is
    carried over the table of chunks, of which those within 745 / beta units matter in double precision. `start` is R at order 0.
    beta may be a column that is the same for all rows of a key, if `least` is the smallest of its values.
    """
    least = beta if least is None else least
    chunk = lambda b: max(1, min(1 << 20, int(64 / b)))
    size = F.greatest(F.lit(1), F.least(F.lit(1 << 20), F.floor(64 / beta))) if isinstance(beta, Column) else F.lit(chunk(beta))
    reach = int(math.ceil(745 / min(32.0, least * chunk(least)))) + 1
    beta = beta if isinstance(beta, Column) else F.lit(beta)
    rows = df.withColumn("__beta", beta).withColumn("__size", size)
    beta, size = F.col("__beta"), F.col("__size")
    rows = rows.withColumn("__c", F.floor(F.col(order) / size)).withColumn("__k", F.col(order) - F.col("__c") * size)
    w = W.partitionBy(*by, "__c").orderBy("__k")
    grow = F.coalesce(F.col(mark), F.lit(0.0)) * F.exp(beta * F.col("__k"))
    rows = rows.withColumn("__local", F.coalesce(F.sum(grow).over(w.rangeBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    tails = rows.groupBy(*by, "__c", "__beta", "__size").agg(F.sum(F.coalesce(F.col(mark), F.lit(0.0)) * F.exp(-beta * (size - F.col("__k")))).alias("__tail"))
    back = W.partitionBy(*by).orderBy("__c").rangeBetween(-reach, -1)
    carry = tails.withColumn("__p", F.collect_list(F.struct("__c", "__tail")).over(back))
    carry = carry.select(*by, "__c", F.aggregate("__p", F.lit(0.0), lambda a, x: a + x["__tail"] * F.exp(-beta * size * (F.col("__c") - x["__c"] - 1))).alias("__carry"))
    joined = rows.join(carry, [*by, "__c"])
    value = F.exp(-beta * F.col("__k")) * (F.col("__local") + F.col("__carry")) + start * F.exp(-beta * F.col(order))
    return joined.withColumn(out, value).drop("__c", "__k", "__local", "__carry", "__beta", "__size")

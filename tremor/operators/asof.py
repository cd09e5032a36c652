"""Backward as-of join for keys with any number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Width of the cells that an as-of series is cut into, in units of the order column.
CELL = 1 << 14


def asof_join(left: DataFrame, right: DataFrame, by: list[str], t: str, values: list[str], *, strict: bool = False, tolerance: float | None = None, cell: int = CELL, right_t: str | None = None) -> DataFrame:
    """left with, for each row, `values` and `right_t` (default t + "_r") of the last right row of its key at or before t.

    strict: only before t. tolerance: null if that row is more than `tolerance` older. Of right rows with equal key and t the
    greatest values count. No key is sorted as a whole: rows are ordered within cells of t, and each cell's last value is
    carried to later cells over a table of one row per key and cell, so a key with most of all rows is spread out.
    """
    out_t = right_t or f"{t}_r"
    at = F.floor(F.col(t) / cell).alias("__cell")
    r = right.select(*by, at, F.col(t).alias("__t"), F.struct(F.col(t).alias(out_t), *values).alias("__v"))
    left_names = [F.col(c) for c in left.columns]
    marked = left.select(*by, at, F.col(t).alias("__t"), F.struct(*left_names).alias("__l"))
    both = marked.withColumn("__side", F.lit(0 if strict else 1)).unionByName(r.withColumn("__side", F.lit(1 if strict else 0)), allowMissingColumns=True)
    w = W.partitionBy(*by, "__cell").orderBy("__t", "__side", "__v").rowsBetween(W.unboundedPreceding, 0)
    rows = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__l is not null")
    tails = r.groupBy(*by, "__cell").agg(F.max("__v").alias("__tail"))
    cells = marked.select(*by, "__cell").distinct().join(tails, [*by, "__cell"], "full")
    before = cells.withColumn("__before", F.last("__tail", ignorenulls=True).over(W.partitionBy(*by).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1))).drop("__tail").where("__before is not null")
    got = rows.join(before, [*by, "__cell"], "left").withColumn("__v", F.coalesce("__v", "__before"))
    if tolerance is not None:
        got = got.withColumn("__v", F.when(F.col("__t") - F.col(f"__v.{out_t}") <= tolerance, F.col("__v")))
    return got.select("__l.*", *[F.col(f"__v.{c}").alias(c) for c in (out_t, *values)])


def merged_series(points: DataFrame, by: list[str], t: str, name: str, value: str, names: list[str], cell: int = CELL) -> DataFrame:
    """(by.., t, one column for each of `names`): at each t at which any of the named series of a key has a value, the last value of every one,
    once all have begun. points: by.., t, `name`, `value`; of equal t and name the greatest value counts.

    One union of all series, whatever their number: rows of a time become one, and each series is carried within cells of t and over the table of cells.
    """
    from tremor.operators.intervals import running

    at = points.where(F.col(name).isin(names)).groupBy(*by, t).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(f"__{n}") for n in names])
    carried = running(at, by, t, [t], cell, **{n: ("last", F.col(f"__{n}")) for n in names})
    return carried.where(" and ".join(f"`{n}` is not null" for n in names)).select(*by, t, *names)

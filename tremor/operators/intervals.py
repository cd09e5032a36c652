"""Intervals, runs and alarms over ordered rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremor.sources.shared import saved


#: Width of the cells that an ordered series is cut into, in units of its order column.
CELL = 1 << 10


def running(df: DataFrame, by: list[str], t: str, order: list, cell: int = CELL, inclusive: bool = True, **columns) -> DataFrame:
    """df with running aggregates over each key's rows in order: name=(function, column), such as ("sum", F.col("x")).

    `order` begins with the number t, as its ties must be in one cell. Aggregates are made within cells of t, and what the
    cells before add up to comes from a table of one row a key and cell, so a key with most of all rows is many
    tasks. Functions: sum, max, min, count and last (of the rows before, the last that isn't null). Not inclusive: of the
    rows before alone, null for a first one.
    """
    fold = {"sum": lambda a, b: a + b, "count": lambda a, b: a + b, "max": F.greatest, "min": F.least, "last": lambda a, b: F.coalesce(b, a)}
    rows = df.withColumn("__cell", F.floor(F.col(t) / cell))
    for name, (_, c) in columns.items():
        rows = rows.withColumn(f"__x_{name}", c)
    rows = saved(rows)
    upto = 0 if inclusive else -1
    w = W.partitionBy(*by, "__cell").orderBy(*order).rowsBetween(W.unboundedPreceding, upto)
    over = lambda kind, c, w: F.last(c, ignorenulls=True).over(w) if kind == "last" else getattr(F, kind)(c).over(w)
    here = rows.select("*", *[over(kind, F.col(f"__x_{name}"), w).alias(f"__in_{name}") for name, (kind, _) in columns.items()])
    at = F.struct(*order)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))
    ends = rows.groupBy(*by, "__cell").agg(*[(last(f"__x_{name}") if kind == "last" else getattr(F, kind)(f"__x_{name}")).alias(f"__t_{name}") for name, (kind, _) in columns.items()])
    back = W.partitionBy(*by).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    again = {"count": "sum"}
    before = ends.select(*by, "__cell", *[over(again.get(kind, kind), F.col(f"__t_{name}"), back).alias(f"__b_{name}") for name, (kind, _) in columns.items()])
    mine, other = here.alias("mine"), before.alias("other")
    cond = F.col("mine.__cell") == F.col("other.__cell")
    for c in by:
        cond &= F.col(f"mine.{c}").eqNullSafe(F.col(f"other.{c}"))
    met = mine.join(other, cond)
    out = [F.coalesce(fold[kind](F.col(f"__b_{name}"), F.col(f"__in_{name}")), F.col(f"__in_{name}"), F.col(f"__b_{name}")).alias(name) for name, (kind, _) in columns.items()]
    return met.select(*[F.col(f"mine.{c}") for c in df.columns], *out)


def merge_intervals(df: DataFrame, by: list[str], start: str = "start_block", end: str = "end_block", touch: int = 0, cell: int = CELL) -> DataFrame:
    """(by.., start, end, n): unions of intervals that overlap or touch (start <= last end + touch)."""
    each = df.groupBy(*by, start, end).agg(F.count("*").alias("__k"))
    rows = running(each, by, start, [start, end], cell, inclusive=False, __last=("max", F.col(end)))
    rows = rows.withColumn("__new", F.coalesce((F.col(start) > F.col("__last") + touch).cast("int"), F.lit(1)))
    rows = running(rows, by, start, [start, end], cell, __g=("sum", F.col("__new")))
    return rows.groupBy(*by, "__g").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("__k").alias("n")).drop("__g")


def runs(df: DataFrame, by: list[str], order: str, gap: int, cell: int = CELL) -> DataFrame:
    """df with `run`, the number of the row's run within its key: a run ends where the next row is more than `gap` away."""
    points = df.select(*by, order).distinct()
    points = running(points, by, order, [order], cell, inclusive=False, __before=("max", F.col(order)))
    points = points.withColumn("__new", F.coalesce((F.col(order) - F.col("__before") > gap).cast("int"), F.lit(1)))
    points = running(points, by, order, [order], cell, run=("sum", F.col("__new")))
    return df.join(points.drop("__before", "__new"), [*by, order])


def in_parts(df: DataFrame, by: list[str], order: str, part: int) -> DataFrame:
    """df with `__part`, the row's range of `part` units of the order column, for windows that are not over a whole series."""
    return df.withColumn("__part", F.floor(F.col(order) / part))


def _with_margin(df: DataFrame, by: list[str], order: str, rows: int, part: int) -> tuple[DataFrame, object]:
    """Rows dealt to ranges of a dense integer `order`, each range with copies of the `rows` rows before it (__own false)."""
    own = df.withColumn("__part", F.floor(F.col(order) / part)).withColumn("__own", F.lit(True))
    far = -(-rows // part)
    copies = [df.withColumn("__part", F.floor(F.col(order) / part) + k).withColumn("__own", F.lit(False)).where(F.col(order) >= F.col("__part") * part - rows) for k in range(1, far + 1)]
    for c in copies:
        own = own.unionByName(c)
    return own, W.partitionBy(*by, "__part").orderBy(order)


def trailing(df: DataFrame, by: list[str], order: str, rows: int, part: int = 1 << 16, **columns) -> DataFrame:
    """df with columns made over at most `rows` preceding rows of a dense integer order: name=lambda w: column.

    Each range of `part` order values is a window of its own, with the rows that it looks back on copied to it.
    """
    part = max(part, rows)
    both, w = _with_margin(df, by, order, rows, part)
    for name, make in columns.items():
        both = both.withColumn(name, make(w))
    return both.where("__own").drop("__own", "__part")


def rising_edges(df: DataFrame, by: list[str], order: str, above: Column) -> DataFrame:
    """The first row of each run of rows that are above; the first row counts. `order` is a dense integer."""
    rows = df.withColumn("__above", F.coalesce(above, F.lit(False)))
    rows = trailing(rows, by, order, 1, __before=lambda w: F.lag("__above").over(w))
    return rows.where(F.col("__above") & ~F.coalesce("__before", F.lit(False))).drop("__above", "__before")


def debounced(df: DataFrame, by: list[str], order: str, above: Column, k: int, window: int) -> DataFrame:
    """The rows where at least k of the last `window` rows come to be above."""
    window = max(window, k)
    rows = df.withColumn("__above", F.coalesce(above, F.lit(False)).cast("int"))
    rows = trailing(rows, by, order, window, __n=lambda w: F.sum("__above").over(w.rowsBetween(1 - window, 0)), __m=lambda w: F.sum("__above").over(w.rowsBetween(-window, -1)))
    return rows.where((F.col("__n") >= k) & (F.coalesce("__m", F.lit(0)) < k)).drop("__above", "__n", "__m")


def kth_largest(df: DataFrame, by: list[str], order: str, value: str, ks: list[int], window: int, part: int = 1 << 16) -> DataFrame:
    """(by.., order, k, before, level): for each k, the k-th largest value of a row and the `window` - 1 rows before it in a dense integer order, and that of the row before.

    At least k of these values reach a threshold just if the level does, so debouncing at any threshold is a rising edge of the level.
    Null where there are fewer than k values. Rows are dealt to ranges, with the rows that they look back on.
    """
    window = max(window, *ks)
    rows, _ = _with_margin(df.select(*by, order, F.col(value).cast("double").alias("__v")), by, order, window, max(part, window))

    def levels(key, pdf):
        pdf = pdf.sort_values(order, ignore_index=True)
        v = np.concatenate([np.full(window, -np.inf), pdf["__v"].fillna(-np.inf).to_numpy()])
        own = np.flatnonzero(pdf["__own"].to_numpy())
        out = []
        for begin in range(0, len(own), 1 << 14):
            at = own[begin : begin + (1 << 14)]
            near = -np.lib.stride_tricks.sliding_window_view(v, window)[np.concatenate([at, at + 1])]  # before, and with, the row
            near = -np.partition(near, [k - 1 for k in ks], axis=1)[:, [k - 1 for k in ks]]
            near[np.isneginf(near)] = np.nan
            for c, k in enumerate(ks):
                out.append(pdf.loc[at, [*by, order]].assign(k=k, before=near[: len(at), c], level=near[len(at) :, c]))
        return pd.concat(out) if out else pd.DataFrame(columns=[*by, order, "k", "before", "level"])

    kinds = dict(df.dtypes)
    fields = ", ".join([f"{c} {kinds[c]}" for c in (*by, order)] + ["k int", "before double", "level double"])
    found = rows.groupBy(*by, "__part").applyInPandas(levels, fields)
    return found.withColumn("before", F.nanvl("before", F.lit(None).cast("double"))).withColumn("level", F.nanvl("level", F.lit(None).cast("double")))


def within_spans(points: DataFrame, t: str, spans: DataFrame, lo: str, hi: str, cell: int = 1 << 12, how: str = "inner", by: list[str] | None = None) -> DataFrame:
    """Rows of points joined with the spans of equal `by` whose [lo, hi] holds t: an equi-join on cells of t, so neither side is sent whole to every task."""
    cut = spans.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))))
    at = points.withColumn("__cell", F.floor(F.col(t) / cell))
    for k in by or []:
        cut = cut.withColumnRenamed(k, f"__{k}")
    cond = (at["__cell"] == cut["__cell"]) & (F.col(t) >= F.col(lo)) & (F.col(t) <= F.col(hi))
    for k in by or []:
        cond &= F.col(k) == F.col(f"__{k}")
    return at.join(cut, cond, how).drop("__cell", *[f"__{k}" for k in by or []])

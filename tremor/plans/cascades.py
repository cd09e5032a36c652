"""Cascade labels: windows over liquidations, percentile of their sums, merged episodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.operators.bars import percentiles
from tremor.operators.intervals import merge_intervals, running

#: Anchors of so many widest windows are one task's; it also gets the liquidations of one window more.
WINDOWS = 4


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """How many of the ranges [start, end] of places hold each of the places 0 .. n - 1."""
    return np.cumsum(np.bincount(starts, minlength=n + 1)[:n] - np.bincount(ends + 1, minlength=n + 1)[:n])


def _before(codes: np.ndarray) -> np.ndarray:
    """The place of the row before of the same code, else -1."""
    order = np.argsort(codes, kind="stable")
    out, same = np.full(len(codes), -1), codes[order][1:] == codes[order][:-1]
    out[order[1:][same]] = order[:-1][same]
    return out


def _waves(block: np.ndarray, assets: np.ndarray, before: np.ndarray, first: np.ndarray, lag: int) -> np.ndarray:
    """For each anchor the most waves of an asset in its window; `first` is the first anchor whose window holds a row.

    A row is the first of its asset for the anchors after the row before it. Such an anchor has v waves or more if its window
    reaches the start of the (v - 1)-th wave after the row's own, so for each v the anchors are ranges that end at rows.
    """
    n = len(block)
    order = np.argsort(assets, kind="stable")
    new = np.ones(n, bool)
    new[1:] = (assets[order][1:] != assets[order][:-1]) | (block[order][1:] - block[order][:-1] > lag)
    wave = np.cumsum(new) - 1
    begins, asset = order[new], assets[order]
    out, v = np.ones(n, np.int64), 1
    while True:
        there = np.minimum(wave + v, len(begins) - 1)
        far = (wave + v < len(begins)) & (assets[begins[there]] == asset)
        start, end = np.maximum(before[order[far]] + 1, first[begins[there[far]]]), order[far]
        reached = start <= end
        if not reached.any():
            return out
        out += covered(start[reached], end[reached], n) > 0
        v += 1


def _stats_of(rows: pd.DataFrame, widths: list[int], lag: int) -> Iterator[pd.DataFrame]:
    """A table a width for rows in order; each row is an anchor."""
    block = rows["block_number"].to_numpy()
    position, owner, asset = (pd.factorize(rows[c], use_na_sentinel=False)[0] for c in ("position_id", "user", "asset_key"))
    upto = np.concatenate([[0.0], np.cumsum(rows["amount_usd"].fillna(0.0).to_numpy())])
    place, n = np.arange(len(block)), len(block)
    befores = [_before(c) for c in (position, owner, asset)]
    for w in widths:
        end = np.searchsorted(block, block + w)
        first = np.searchsorted(block, block - w, "right")
        # a row counts for the anchors after the row before of its key whose windows reach it
        distinct = [covered(np.maximum(b + 1, first), place, n) for b in befores[:2]]
        yield rows[["protocol", "block_number", "log_index"]].assign(w=w, sum_usd=upto[end] - upto[:-1], n_positions=distinct[0], n_users=distinct[1], generations=_waves(block, asset, befores[2], first, lag), last_block=block[end - 1])


def window_stats(liq: DataFrame, widths: list[int], lag: int) -> DataFrame:
    """For each liquidation as anchor and each width w: USD, distinct positions and users, most waves of an asset and last block of
    the liquidations at or after it in [block, block + w). Null USD counts as zero, a null asset as one of its own.

    All widths come from one ordered pass, linear in rows: running sums for USD, and for what is counted, ranges of anchors that
    each row counts for, so no anchor meets the rows of its window. Rows are dealt to ranges of blocks, with the rows of one
    widest window after a range copied to it.
    """
    widths, cell = sorted(widths), WINDOWS * max(widths)
    rows = liq.select("protocol", "block_number", "log_index", "user", "position_id", F.col("amount_usd").cast("double").alias("amount_usd"), F.coalesce("collateral_asset", F.lit("unknown")).alias("asset_key"))
    own = F.floor(F.col("block_number") / cell)
    before = F.floor((F.col("block_number") - max(widths)) / cell)
    rows = rows.withColumn("own", own).withColumn("cell", F.explode(F.when(own == before, F.array(own)).otherwise(F.array(own, own - 1))))

    def stats(key, pdf):
        pdf = pdf.sort_values(["block_number", "log_index", "position_id"], kind="stable", ignore_index=True)
        mine = (pdf["own"] == pdf["cell"]).to_numpy()
        return pd.concat([t[mine] for t in _stats_of(pdf, widths, lag)])

    fields = "protocol string, block_number long, log_index int, w long, sum_usd double, n_positions long, n_users long, generations long, last_block long"
    return rows.groupBy("protocol", "cell").applyInPandas(stats, fields)


def label_grid(liq: DataFrame, stats: DataFrame, ks: list[int], thetas: list[float], lag: int) -> DataFrame:
    """(protocol, w, k, theta, theta_usd, start_block, end_block, ..): for each width in window_stats(), least number of positions k and
    percentile theta, the merged windows whose USD is at or above the percentile (per protocol), with k positions, two users
    and two waves or more, and what they hold: n_events, severity_usd, n_positions, n_users, generations, start_time, end_time."""
    levels = percentiles(stats, ["protocol", "w"], "sum_usd", [t / 100 for t in thetas])
    points = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(float(t)).alias("theta"), F.col("p")[i].alias("theta_usd")) for i, t in enumerate(thetas) for k in ks])
    some = stats.where((F.col("n_users") >= 2) & (F.col("generations") >= 2) & (F.col("n_positions") >= min(ks)))
    hits = some.join(levels, ["protocol", "w"]).withColumn("g", F.explode(points)).where((F.col("sum_usd") >= F.col("g.theta_usd")) & (F.col("n_positions") >= F.col("g.k")))
    by = ["protocol", "w", "k", "theta", "theta_usd"]
    merged = merge_intervals(hits.select("protocol", "w", "g.*", F.col("block_number").alias("start_block"), F.col("last_block").alias("end_block")), by).drop("n")
    return interval_rollup(liq, merged, int(max(1000, lag * 5)), by, lag)


def interval_rollup(liq: DataFrame, spans: DataFrame, cell: int, by: list[str] = ["protocol"], lag: int | None = None) -> DataFrame:  # noqa: B006
    """Events, USD, positions and users of the liquidations inside each [start_block, end_block] of their protocol, for spans of keys
    `by`, protocol first; with `lag` also their times and the most waves of an asset more than `lag` blocks apart."""
    key = [*by, "start_block", "end_block"]
    s = spans.select(*key, F.explode(F.sequence(F.floor(F.col("start_block") / cell), F.floor(F.col("end_block") / cell))).alias("c")).withColumnRenamed("protocol", "p")
    x = liq.select("protocol", "block_number", "log_index", "block_timestamp", "user", "position_id", "amount_usd", F.coalesce("collateral_asset", F.lit("unknown")).alias("asset_key"))
    if lag is not None:
        x = running(x, ["protocol", "asset_key"], "block_number", ["block_number", "log_index"], inclusive=False, __before=("max", F.col("block_number")))
    x = x.withColumn("cc", F.floor(F.col("block_number") / cell))
    inside = s.join(x, (F.col("p") == F.col("protocol")) & (F.col("c") == F.col("cc")) & F.col("block_number").between(F.col("start_block"), F.col("end_block"))).drop("p")
    counts = [F.count("*").alias("n_events"), F.sum("amount_usd").alias("severity_usd"), F.countDistinct("position_id").alias("n_positions"), F.countDistinct("user").alias("n_users")]
    if lag is None:
        return inside.groupBy(*key).agg(*counts)
    wave = F.coalesce((F.col("__before") < F.col("start_block")) | (F.col("block_number") - F.col("__before") > lag), F.lit(True))
    waves = inside.groupBy(*key, "asset_key").agg(F.count_if(wave).alias("n")).groupBy(*key).agg(F.max("n").alias("generations"))
    return inside.groupBy(*key).agg(*counts, F.min("block_timestamp").alias("start_time"), F.max("block_timestamp").alias("end_time")).join(waves, key)

"""Alert evaluation: classification, sweeps over thresholds, and score metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremor.operators.intervals import kth_largest, merge_intervals, trailing, within_spans
from tremor.sources.shared import saved


def classify_alerts(alerts: DataFrame, episodes: DataFrame, lead: int) -> DataFrame:
    """(block, episode, kind): an alert is true for the first episode with block in [start - lead, start), false unless it is inside some
    [start, end], else neither. alerts: block; episodes: ep, start_block, end_block, ep being the order."""
    spans = episodes.select("ep", "start_block", "end_block", (F.col("start_block") - lead).alias("lo"))
    met = within_spans(alerts.select("block").distinct(), "block", spans, "lo", "end_block")
    early = F.col("block") < F.col("start_block")
    best = met.groupBy("block").agg(F.min(F.when(early, F.col("ep"))).alias("episode"), F.max(~early).alias("inside"))
    out = alerts.join(best, "block", "left")
    return out.select("block", "episode", F.when(F.col("episode").isNotNull(), "true").when(F.col("inside"), "neither").otherwise("false").alias("kind"))


def classify_fires(fires: DataFrame, episodes: DataFrame, lead: int) -> DataFrame:
    """(block, ep) for every episode whose [start - lead, end] holds the fire; null ep for a false alarm."""
    spans = episodes.select("ep", (F.col("start_block") - lead).alias("lo"), F.col("end_block").alias("hi"))
    met = within_spans(fires.select("block").distinct(), "block", spans, "lo", "hi").select("block", "ep")
    return fires.select("block").join(met, "block", "left")


def sweep(scores: DataFrame, episodes: DataFrame, lead: int, thresholds: list[float]) -> DataFrame:
    """(threshold, alerts, true_alerts, false_alarms, detected) for all thresholds in one pass.

    Bar i alerts at the thresholds in (score before, score]: it adds 1 at the first such rank and takes it away past the last,
    and sums over ranks give the counts. An episode is detected at the union of its alerts' ranks. scores: i, block, score.
    """
    array = F.array(*[F.lit(float(t)) for t in thresholds])
    rank = lambda c: F.size(F.filter(array, lambda t: t <= c))
    rows = trailing(scores.select("i", "block", "score"), [], "i", 1, before=lambda w: F.lag("score").over(w))
    rows = rows.withColumn("a", rank(F.coalesce("before", F.lit(float("-inf"))))).withColumn("b", rank(F.col("score"))).where("b > a")
    kinds = classify_alerts(rows.select("block"), episodes, lead)
    edges = rows.join(kinds, "block").select("kind", "episode", (F.col("a") + 1).alias("lo"), F.col("b").alias("hi"))
    ends = edges.select("kind", F.explode(F.array(F.struct(F.col("lo").alias("rank"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("rank"), F.lit(-1).alias("d")))).alias("x")).groupBy("x.rank").agg(F.sum("x.d").alias("alerts"), F.sum(F.when(F.col("kind") == "true", F.col("x.d"))).alias("t"), F.sum(F.when(F.col("kind") == "false", F.col("x.d"))).alias("f"))
    spans = merge_intervals(edges.where("episode is not null"), ["episode"], "lo", "hi", touch=1)
    found = spans.select(F.explode(F.array(F.struct(F.col("lo").alias("rank"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("rank"), F.lit(-1).alias("d")))).alias("x")).groupBy("x.rank").agg(F.sum("x.d").alias("e"))
    ranks = scores.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(thresholds)], "rank int, threshold double")
    w = W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)  # a row per threshold
    run = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(w).cast("long")
    out = ranks.join(ends, "rank", "left").join(found, "rank", "left")
    return out.select("threshold", run("alerts").alias("alerts"), run("t").alias("true_alerts"), run("f").alias("false_alarms"), run("e").alias("detected"))


def lead_frontier(scores: DataFrame, episodes: DataFrame, leads: list[int], thresholds: list[float], floor: float) -> DataFrame:
    """(lead_blocks, feasible, threshold, best_recall, precision): for each lead, the lowest threshold of best recall above zero with a precision
    of `floor` or more; null where there is none.

    All leads and thresholds in one pass: alerts meet episodes once, within the longest lead, and are judged for each lead; counts are sums
    of rank differences as in sweep().
    """
    array = F.array(*[F.lit(float(t)) for t in thresholds])
    rank = lambda c: F.size(F.filter(array, lambda t: t <= c))
    rows = trailing(scores.select("i", "block", "score"), [], "i", 1, before=lambda w: F.lag("score").over(w))
    rows = rows.withColumn("lo", rank(F.coalesce("before", F.lit(float("-inf")))) + 1).withColumn("hi", rank(F.col("score"))).where("hi >= lo")
    each = F.explode(F.array(*[F.lit(h) for h in leads])).alias("lead")
    edges = saved(rows.select("block", "lo", "hi"))
    spans = episodes.select("ep", "start_block", "end_block", (F.col("start_block") - max(leads)).alias("first"))
    met = within_spans(edges.select("block").distinct(), "block", spans, "first", "end_block").select("block", "ep", "start_block", each).where("block >= start_block - lead")
    early = F.col("block") < F.col("start_block")
    kinds = met.groupBy("block", "lead").agg(F.min(F.when(early, F.col("ep"))).alias("episode"), F.max(~early).alias("inside"))
    judged = saved(edges.select("block", "lo", "hi", each).join(kinds, ["block", "lead"], "left"))
    steps = F.explode(F.array(F.struct(F.col("lo").alias("rank"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("rank"), F.lit(-1).alias("d"))))
    false = F.col("episode").isNull() & ~F.coalesce("inside", F.lit(False))
    counts = judged.select("lead", "episode", "inside", steps.alias("x")).groupBy("lead", "x.rank").agg(F.sum(F.when(F.col("episode").isNotNull(), F.col("x.d"))).alias("t"), F.sum(F.when(false, F.col("x.d"))).alias("f"))
    found = merge_intervals(judged.where("episode is not null").select("lead", "episode", "lo", "hi"), ["lead", "episode"], "lo", "hi", touch=1)
    found = found.select("lead", steps.alias("x")).groupBy("lead", "x.rank").agg(F.sum("x.d").alias("e"))
    points = scores.sparkSession.createDataFrame([(h, i + 1, float(t)) for h in leads for i, t in enumerate(thresholds)], "lead int, rank int, threshold double")
    w = W.partitionBy("lead").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)  # a row per threshold
    run = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(w)
    out = points.join(counts, ["lead", "rank"], "left").join(found, ["lead", "rank"], "left").select("lead", "threshold", run("t").alias("t"), run("f").alias("f"), run("e").alias("e"))
    out = out.crossJoin(F.broadcast(episodes.agg(F.count("*").alias("n")))).withColumn("precision", F.col("t") / F.nullif(F.col("t") + F.col("f"), F.lit(0)))  # n is one row
    good = (F.col("precision") >= floor) & (F.col("e") > 0)
    best = F.max_by(F.struct("threshold", (F.col("e") / F.col("n")).alias("best_recall"), "precision"), F.when(good, F.struct("e", -F.col("threshold"))))
    return out.groupBy("lead").agg(best.alias("x")).select(F.col("lead").cast("long").alias("lead_blocks"), F.col("x").isNotNull().alias("feasible"), "x.*")


def debounced_sweep(scores: DataFrame, episodes: DataFrame, lead: int, thresholds: list[float], ks: list[int], window: int, pad: int, minutes: float = 0.2) -> DataFrame:
    """(k, threshold, fires, false_alarms, detected, detected_primary, n_leads, mean_lead) for all thresholds and k in one pass.

    A bar fires at the thresholds between the k-th largest of the last `window` scores before it and with it. A fire is false if it
    lies in no episode's [start - lead, end], else it detects all episodes whose it lies in. The lead of a primary episode is
    counted from the first fire in [start - pad, start + pad), in blocks of `minutes` each. scores: i, block, score; episodes: ep,
    start_block, end_block, is_primary. Counts are sums of rank differences; only fires near primary episodes are dealt to their thresholds.
    """
    array = F.array(*[F.lit(float(t)) for t in thresholds])
    rank = lambda c: F.size(F.filter(array, lambda t: t <= c))
    low = F.lit(float("-inf"))
    levels = kth_largest(scores, [], "i", "score", ks, window)
    fires = levels.withColumn("a", rank(F.coalesce("before", low)) + 1).withColumn("b", rank(F.coalesce("level", low))).where("b >= a")
    fires = saved(fires.join(scores.select("i", "block"), "i").select("k", "block", "a", "b"))
    spans = episodes.select("ep", "is_primary", (F.col("start_block") - lead).alias("lo"), F.col("end_block").alias("hi"))
    met = saved(within_spans(fires.select("block").distinct(), "block", spans, "lo", "hi").select("block", "ep", "is_primary"))
    true = met.select("block").distinct().withColumn("true", F.lit(1))
    steps = lambda df, by, lo, hi: df.select(*by, F.explode(F.array(F.struct(F.col(lo).alias("rank"), F.lit(1).alias("d")), F.struct((F.col(hi) + 1).alias("rank"), F.lit(-1).alias("d")))).alias("x")).select(*by, "x.*")
    counts = steps(fires.join(true, "block", "left"), ["k", "true"], "a", "b").groupBy("k", "rank").agg(F.sum("d").alias("fires"), F.sum(F.when(F.col("true").isNull(), F.col("d"))).alias("false"))
    found = merge_intervals(fires.join(met, "block"), ["k", "ep", "is_primary"], "a", "b", touch=1)
    found = steps(found, ["k", "is_primary"], "a", "b").groupBy("k", "rank").agg(F.sum("d").alias("found"), F.sum(F.when(F.col("is_primary"), F.col("d"))).alias("primary"))
    near = episodes.where("is_primary").select("ep", "start_block", (F.col("start_block") - pad).alias("lo"), (F.col("start_block") + pad - 1).alias("hi"))
    first = within_spans(fires, "block", near, "lo", "hi").select("k", "ep", "start_block", "block", F.explode(F.sequence("a", "b")).alias("rank"))
    first = first.groupBy("k", "rank", "ep").agg(F.max(F.col("start_block") - F.col("block")).alias("lead"))
    leads = first.groupBy("k", "rank").agg(F.count("*").alias("n_leads"), (F.avg("lead") * minutes).alias("mean_lead"))
    spark = scores.sparkSession
    points = spark.createDataFrame([(k, i + 1, float(t)) for k in ks for i, t in enumerate(thresholds)], "k int, rank int, threshold double")
    w = W.partitionBy("k").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)  # a row per threshold
    run = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(w).cast("long")
    out = points.join(counts, ["k", "rank"], "left").join(found, ["k", "rank"], "left").join(leads, ["k", "rank"], "left")
    return out.select("k", "threshold", run("fires").alias("fires"), run("false").alias("false_alarms"), run("found").alias("detected"), run("primary").alias("detected_primary"), F.coalesce("n_leads", F.lit(0)).alias("n_leads"), F.coalesce("mean_lead", F.lit(0.0)).alias("mean_lead"))


def bootstrap_totals(values: DataFrame, replicates: int, at: list[float]) -> DataFrame:
    """One row `p`: the percentiles `at` of the totals of resamples with replacement of rows (place, x), place being 0, 1, ...

    Draw j of replicate b is the row whose place is a hash of (b, j) modulo their number, so each rerun, and any other program,
    makes the same draws. Replicates are dealt over tasks; no rows give no percentiles.
    """
    from tremor.operators.bars import percentiles

    values = saved(values.select("place", "x"))
    n = values.count()
    number = F.conv(F.substring(F.md5(F.concat_ws(":", "b", "j")), 1, 15), 16, 10).cast("long") % max(n, 1)
    draws = values.sparkSession.range(replicates).select(F.col("id").alias("b")).select("b", F.explode(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")).alias("j"))
    totals = draws.select("b", number.alias("place")).join(values, "place").groupBy("b").agg(F.sum("x").alias("total"))
    return percentiles(totals, [], "total", at)


def auprc(rows: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Average precision, of each key if `by` is given: the sum over distinct scores, from the highest, of recall gained times precision.

    Scores are first grouped, then cumulated in ranges of the score, so no task sorts all rows.
    """
    by = by or []
    g = rows.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("tp"), F.count("*").alias("n"))
    g = g.withColumn("cell", F.floor(F.col(score) * 256))
    cells = g.groupBy(*by, "cell").agg(F.sum("tp").alias("ctp"), F.sum("n").alias("cn"))
    down = W.partitionBy(*by).orderBy(F.desc("cell"))  # as many rows as there are cells
    cells = cells.select(*by, "cell", (F.sum("ctp").over(down) - F.col("ctp")).alias("tp0"), (F.sum("cn").over(down) - F.col("cn")).alias("n0"))
    w = W.partitionBy(*by, "cell").orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    g = g.join(cells, [*by, "cell"]).withColumn("ctp", F.col("tp0") + F.sum("tp").over(w)).withColumn("cn", F.col("n0") + F.sum("n").over(w))
    gained = F.sum(F.col("tp") * F.col("ctp") / F.col("cn")) / F.nullif(F.sum("tp"), F.lit(0))
    return g.groupBy(*by).agg(gained.alias("auprc"), F.sum("tp").alias("positives"), F.sum("n").alias("n"))


def calibration(rows: DataFrame, p: Column, y: Column, bins: int) -> DataFrame:
    slot = F.greatest(F.ceil(p * bins) - 1, F.lit(0)).cast("long")
    return rows.groupBy(slot.alias("bin")).agg(F.avg(p).alias("predicted"), F.avg(y.cast("double")).alias("observed"), F.count("*").alias("n"))

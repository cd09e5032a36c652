"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremor.llm.common import boxed, checkpoint, column, words

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source, and so a document, is taken this many times at most.
REPEATS = 3
#: Ranges of the shuffle key within a source; each is one window partition.
RANGES = 4096


def ranked(df: DataFrame, order) -> DataFrame:
    """df with `place`, 0, 1, .. in the order of a column. Rows are sorted in ranges, and only the ranges' sizes reach the driver."""
    rows = checkpoint(df.orderBy(order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__at", 33).alias("part")
    sizes = sorted((r.part, r.n) for r in rows.groupBy(part).agg(F.count("*").alias("n")).collect())  # a row per range
    starts, before = {}, 0
    for k, n in sizes:
        starts[k], before = before, before + n
    if not starts:
        return rows.withColumn("place", F.col("__at")).drop("__at")
    first = F.create_map(*[F.lit(x) for k, v in starts.items() for x in (k, v)])
    return rows.withColumn("place", first[F.shiftrightunsigned("__at", 33)] + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at")


def targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size): shares of the total by weight, none above `repeats`
    times its size, the excess shared again.

    A source is full if the share of a unit of weight is at least its limit; that share only grows as full sources
    leave the rest more, so each round takes one pass over the sources, and only sums reach the driver.
    """
    rows = ranked(sizes, F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = checkpoint(rows.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * repeats).alias("limit")))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    share, n_full = 0.0, -1
    while True:
        full = F.lit(share) * F.col("weight") >= F.col("limit") if n_full >= 0 else F.lit(False)
        r = rows.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("limit")).otherwise(0)).alias("used"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if r.n == n_full or not r.open:
            break
        share, n_full = (float(total) - r.used) / r.open, max(r.n, 0)
    full = F.lit(share) * F.col("weight") >= F.col("limit")
    return rows.select("source", "source_size", F.when(full, F.col("limit").cast("double")).otherwise(F.lit(share) * F.col("weight")).alias("target"))


def mix(documents: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, ranges: int = RANGES) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (= copies * size).

    Each source's documents are shuffled by the md5 of their id. A document's copy in round r (0, 1, ..) finishes at
    (r * source_size + sizes before and with it) / target. All copies are then sorted by finishing time, and taken
    from the start while their sizes add up to no more than the sum of all targets. No source is a single window:
    running sums are made within ranges of the shuffle key and the ranges' sums added up; nor is the final order,
    which is cut in equal ranges of time of which only the last is looked into.

    Null texts have size 0 and documents of size 0 are taken 0 times. A null source is a source of its own. Rows with
    a null doc_id take part; rows that repeat one are documents of their own, side by side in the shuffle.
    """
    docs = documents.select("doc_id", "source", F.size(words(F.col("text"), lower=False)).cast("long").alias("size"))
    return schedule(docs, weights, repeats, ranges)


def schedule(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, ranges: int = RANGES, keep: tuple[str, ...] = ()) -> DataFrame:
    """mix() for rows (doc_id, source, size) and the columns in `keep`."""
    docs = docs.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    docs = checkpoint(docs.withColumn("cell", F.floor(F.conv(F.substring("key", 1, 6), 16, 10).cast("long") * ranges / (1 << 24)).cast("int")))
    cells = docs.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    plan = checkpoint(targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, repeats))
    budget = round(plan.agg(F.sum("target")).first()[0] or 0)
    before = F.sum("cell_size").over(W.partitionBy("source").orderBy("cell")) - F.col("cell_size")
    sums = cells.select(F.col("source").alias("s"), F.col("cell").alias("c"), before.alias("before"))
    plan = plan.withColumnRenamed("source", "p")
    offsets = sums.join(plan, F.col("s").eqNullSafe(F.col("p"))).drop("p")
    rows = docs.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c"))).drop("s", "c")
    within = W.partitionBy("source", "cell").orderBy("key", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = checkpoint(rows.withColumn("upto", F.col("before") + F.sum("size").over(within)).drop("before", "cell", "key"))
    finish = lambda r: (r * F.col("source_size") + F.col("upto")) / F.expr("nullif(target, 0)")
    copies = rows.where("size > 0").select("size", F.explode(F.array(*[finish(r) for r in range(repeats)])).alias("finish")).where("finish < 2")  # every source has reached its target at 1
    limit = _last_taken(copies, budget, ranges)
    count = sum((F.coalesce(finish(r) <= limit, F.lit(False)).cast("long") for r in range(repeats)), F.lit(0).cast("long"))
    return rows.withColumn("copies", F.when(F.col("size") > 0, count).otherwise(0).cast("long")).select("doc_id", "source", *keep, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _last_taken(copies: DataFrame, budget: int, ranges: int, small: int = 100_000) -> float:
    """The latest finishing time up to which the sizes of copies (size, finish) add up to no more than `budget`.

    Times are counted in `ranges` equal ranges, then those of the range where the budget ends, until that range
    has few copies, which are resolved exactly. The driver gets two rows a range at most.
    """
    low, width, taken = 0.0, 2.0, 0
    while True:
        inside = copies.where((F.col("finish") >= low) & (F.col("finish") < low + width)) if width < 2 else copies
        slot = F.least(F.floor((F.col("finish") - low) * (ranges / width)), F.lit(ranges - 1))
        end = None
        for r in inside.groupBy(slot.alias("slot")).agg(F.sum("size").alias("n"), F.count("*").alias("c"), F.min("finish").alias("first"), F.max("finish").alias("last")).orderBy("slot").collect():
            if taken + r.n > budget:
                end = r
                break
            taken += r.n
        if end is None:
            return 2.0 if width >= 2 else low + width
        if end.c <= small or end.first == end.last or end.last - end.first < 1e-12:
            break
        low, width = end.first, (end.last - end.first) * (1 + 1e-9)
    at = copies.where((F.col("finish") >= end.first) & (F.col("finish") <= end.last)).groupBy("finish").agg(F.sum("size").alias("n"))
    at = at.withColumn("n", F.lit(taken) + F.sum("n").over(W.orderBy("finish")))
    last = at.where(F.col("n") <= budget).agg(F.max("finish").alias("t")).first().t
    return last if last is not None else end.first - 1e-12


def mixed(documents: DataFrame, **how) -> DataFrame:
    """The documents that mix() takes, each once, with its number of copies and its words taken as columns mix_copies and mix_taken.

    Each row has copies of its own, whether or not its doc_id is null or repeated. Rows of equal doc_id, source and text share what
    they get: they are counted within the tasks they lie in, and the first of them get the more copies. Columns of these
    two names are replaced; all others stay, whatever their names.
    """
    text = F.xxhash64("text").alias("hash")
    docs = documents.select("doc_id", "source", text, F.size(words(F.col("text"), lower=False)).cast("long").alias("size"))
    key = lambda *c: F.struct(*[F.coalesce(F.concat(F.lit("="), F.col(x).cast("string")), F.lit("")) for x in c])  # noqa: E731  never null
    shares = schedule(docs, keep=("hash",), **how).groupBy(key("doc_id", "source", "hash").alias("k"), "copies", "size").agg(F.count("*").alias("n"))
    shares = shares.groupBy("k").agg(F.first("size").alias("size"), F.max("copies").alias("most"), F.sort_array(F.collect_list(F.struct("copies", "n")), False).alias("each")).where("most > 0")
    shares = checkpoint(shares)  # a row a document; `each` has a number of copies once, so it is short
    names = [c for c in documents.columns if c not in ("mix_copies", "mix_taken")]
    rows = boxed(documents.select(*[column(c) for c in names]), "doc_id", "source", "text").select("row", text, "doc_id", "source").select("row", key("doc_id", "source", "hash").alias("k"))
    alone = rows.join(shares.where("size(each) = 1").select("k", "size", F.col("most").alias("copies")), "k").select("row", "size", "copies")
    some = checkpoint(rows.join(shares.where("size(each) > 1").select("k", "size", "each"), "k").withColumn("part", F.spark_partition_id()))
    counts = some.groupBy("k", "part").agg(F.count("*").alias("n"))
    counts = counts.select("k", "part", (F.sum("n").over(W.partitionBy("k").orderBy("part")) - F.col("n")).alias("before"))  # a row a task
    nth = F.row_number().over(W.partitionBy("k", "part").orderBy("size")) + F.col("before")
    some = some.join(counts, ["k", "part"]).withColumn("nth", nth)
    upto = F.expr("aggregate(each, named_struct('left', nth, 'copies', cast(null as bigint)), (a, x) -> if(a.left <= 0, a, named_struct('left', a.left - x.n, 'copies', x.copies)), a -> a.copies)")
    out = alone.unionByName(some.select("row", "size", upto.alias("copies"))).where("copies > 0")
    return out.select("row.*", F.col("copies").alias("mix_copies"), (F.col("copies") * F.col("size")).alias("mix_taken"))

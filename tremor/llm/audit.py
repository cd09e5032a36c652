"""Filter interaction audit: what each of five filters removes from a corpus, in every order of them."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremor.llm.common import checkpoint
from tremor.llm.spans import CAPITAL, CONTINUES, SYMBOL, TEXT, Spans, pieces

FILTERS = "ABCDE"
#: Least number of words; least percentage of distinct words; largest percentage of capitals.
WORDS, DISTINCT, CAPITALS = 50, 65, 5


def statistics(documents: DataFrame, *keep: str) -> DataFrame:
    """The columns in `keep`, and of each row's whole text: n_words, n_distinct (words, case-sensitive), n_capitals, n_chars
    (code points), n_symbols, as the byte transducer counts them in one pass. Null is the empty text, and all zero."""
    kinds = dict(documents.dtypes)

    def run(batches):
        for batch in batches:
            for i, j, data, ends in pieces(batch.column("__text")):
                s = Spans(data, ends, TEXT)
                starts = ends - np.diff(ends, prepend=-1) + 1
                count = lambda mask: np.add.reduceat(mask.astype(np.int64), starts)  # noqa: E731  the blanks are of class SPACE
                out = {c: batch.column(c).slice(i, j - i) for c in keep}
                out["n_words"], out["n_distinct"] = np.bincount(s.doc, minlength=j - i), s.distinct()
                out["n_capitals"], out["n_symbols"] = count(s.kinds == CAPITAL), count(s.kinds == SYMBOL)
                out["n_chars"] = count(s.kinds != CONTINUES) - 1
                yield pa.RecordBatch.from_pydict({k: pa.array(v) if isinstance(v, np.ndarray) else v for k, v in out.items()})

    fields = [f"`{c}` {kinds[c]}" for c in keep] + [f"{c} long" for c in ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_chars")]
    return documents.select(*keep, F.col("text").cast("binary").alias("__text")).mapInArrow(run, ", ".join(fields))


def failures() -> F.Column:
    """The filters of a text alone that statistics() fail, as bits: A 1, B 2, C 4, D 8."""
    a = F.col("n_words") < WORDS
    b = 100 * F.col("n_distinct") < DISTINCT * F.col("n_words")
    c = 100 * F.col("n_capitals") > CAPITALS * F.col("n_chars")
    d = F.col("n_symbols") > 0
    return sum((x.cast("int") * (1 << k) for k, x in enumerate((a, b, c, d))), F.lit(0))


def patterns(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): for each source and set of failed filters (bits of FILTERS), documents, those of
    quality 1 and those of toxic 1.

    A document fails E if a smaller doc_id anywhere has its text; texts are the same if their SHA-256 is. A row without a
    doc_id neither fails E nor makes another fail, and rows that repeat a doc_id don't make each other fail. Equal rows are
    counted before they are shuffled, so that large groups of copies are few rows.
    """
    own = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), "text")
    rows = statistics(own, "doc_id", "part", "digest").select("doc_id", "part", "digest", failures().alias("mask"))
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = F.lit(False)
    named = rows.where("doc_id is not null").join(marks, "doc_id", "left").withColumn("good", F.coalesce("good", no)).withColumn("toxic", F.coalesce("toxic", no))
    rows = named.unionByName(rows.where("doc_id is null").withColumn("good", no).withColumn("toxic", no))
    copies = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"))
    least = F.min("first").over(W.partitionBy("digest"))  # a row for each source and label of a text
    copies = copies.withColumn("kept", F.col("unnamed") + F.when(F.col("first") == least, F.col("n_first")).otherwise(0))
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("kept").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))
    each = copies.select("part", "good", "toxic", F.explode(both).alias("x")).where("x.n > 0")
    of = lambda c: F.sum(F.when(F.col(c), F.col("x.n")).otherwise(0))
    return each.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))


def _steps() -> F.Column:
    """All steps of all orders: (filter_order, step, the bit of its filter, the bits of the filters before it)."""
    found = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            found.append(f"named_struct('filter_order', '{name}', 'step', {step}, 'own', {1 << k}, 'before', {before})")
            before |= 1 << k
    return F.expr(f"array({', '.join(found)})")


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each source, order of the five filters and step: part, filter_order, step (from 1), kept, removed,
    redundant (failing this step's filter, removed earlier), unique_fails (failing it alone), good_lost, toxic_lost and
    shapley (what the filter removes, added up over all 120 orders).

    Documents are counted once by the set of filters that they fail, 32 sets a source at most; all orders follow from these
    counts. A document that fails k filters is removed by each of them in 120 / k of the orders. A null source is
    the part ''; rows count each on their own, repeated or not; labels that repeat a doc_id count as good or toxic if any
    of them says so. Empty documents give no rows.
    """
    full = 1 << len(FILTERS)
    masks = f"sequence(0, {(1 << len(FILTERS)) - 1})"
    counts = patterns(documents, labels).groupBy("part").agg(*[F.map_from_entries(F.collect_list(F.struct("mask", c))).alias(c) for c in ("n", "good", "toxic")])
    passes = lambda c: F.expr(f"transform({masks}, x -> aggregate({masks}, 0L, (a, m) -> a + if(m & x = 0, coalesce({c}[m], 0L), 0L)))")
    share = F.expr(f"transform(sequence(0, {len(FILTERS) - 1}), k -> aggregate({masks}, 0L, (a, m) -> a + if(getbit(m, k) = 1, coalesce(n[m], 0L) * (120 div greatest(bit_count(m), 1)), 0L)))")
    alone = F.expr(f"transform(sequence(0, {len(FILTERS) - 1}), k -> coalesce(n[shiftleft(1, k)], 0L))")
    counts = counts.select("part", *[passes(c).alias(c) for c in ("n", "good", "toxic")], alone.alias("alone"), share.alias("share"))  # n[x]: documents that pass all filters of x
    rows = checkpoint(counts).select("*", F.explode(_steps()).alias("at")).select("*", "at.*")
    kept = lambda c: F.expr(f"{c}[own | before]")
    removed = lambda c: F.expr(f"{c}[before] - {c}[own | before]")
    return rows.select(
        "part",
        "filter_order",
        "step",
        kept("n").alias("kept"),
        removed("n").alias("removed"),
        F.expr("n[0] - n[own] - (n[before] - n[own | before])").alias("redundant"),
        F.expr("alone[bit_count(own - 1)]").alias("unique_fails"),
        removed("good").alias("good_lost"),
        removed("toxic").alias("toxic_lost"),
        F.expr("share[bit_count(own - 1)]").alias("shapley"),
    )

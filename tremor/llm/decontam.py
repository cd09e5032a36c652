"""Benchmark decontamination: token windows of documents against a hash set of benchmark windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import NOT_ALNUM, boxed, words

WINDOW = 13
#: The benchmark's block table is broadcast only up to this many rows (of about 19 words each); beyond it Spark shuffles.
BROADCAST_ROWS = 1_000_000


def _around(w: str, at: str, b: int, m: int) -> str:
    """SQL: the words from m - b before a block of b words at position `at` to m - b after it."""
    return f"slice({w}, greatest({at} - {m - b}, 1), {b} + {m - b} + least({at} - 1, {m - b}))"


def row_of() -> Column:
    """A hash of the text of a row without a doc_id, else null."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("row")


def _key(doc_id: str, row: str) -> Column:
    """Never null, so that rows without a doc_id share no join key but with their equals."""
    return F.struct(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(row), F.lit(0).cast("long")))


def find_windows(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows (doc_id, row, n_words, start, length, items): each document once with null start, and each verified window with
    the ids of the items that hold it.

    A window of m words always covers a whole aligned block of b = (m + 1) // 2 words, so a document only looks up its
    words in steps of b: the lookups shrink by b and none is missed. A block that is in the table brings its
    surroundings, and the windows around it are compared word by word, so hash collisions do no harm. Items of fewer
    than `window` words form one window of their own length. Null texts have no words; rows with a null item_id take no
    part. row tells documents without a doc_id apart, by their text; it is null for others.
    """
    items = benchmark.where("item_id is not null").select("item_id", words(F.col("text"), NOT_ALNUM).alias("w")).where("size(w) > 0")
    items = items.withColumn("m", F.least(F.size("w"), F.lit(window)))
    sizes = {r.m: r.n for r in items.groupBy("m").agg(F.sum("m").alias("k"), F.sum(F.size("w")).alias("n")).collect()}  # at most `window` rows
    docs = documents.select("doc_id", row_of(), words(F.col("text"), NOT_ALNUM).alias("w"))
    docs = docs.withColumn("n_words", F.size("w").cast("long"))
    if not sizes:
        return docs.select("doc_id", "row", "n_words", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("array<string>").alias("items"))
    parts, tables = ["array(named_struct('m', 0, 'b', 0, 'p', 0, 'h', 0L))"], []
    for m in sorted(sizes):
        b = (m + 1) // 2
        at = f"transform(sequence(1, size(w) - {b - 1}, {{}}), p -> named_struct('m', {m}, 'b', {b}, 'p', p, 'h', xxhash64(slice(w, p, {b}))))"
        parts.append(f"if(size(w) >= {m}, {at.format(b)}, array())")
        t = items.where(f"m = {m}").select("item_id", "w", F.expr(f"inline({at.format(1)})"))
        tables.append(t.select("m", "h", F.expr(f"least(p - 1, {m - b})").alias("item_pre"), F.expr(_around("w", "p", b, m)).alias("item_words"), F.col("item_id").cast("string").alias("item_id")))
    blocks = tables[0]
    for t in tables[1:]:
        blocks = blocks.unionByName(t)
    blocks = blocks.groupBy("m", "h", "item_pre", "item_words").agg(F.collect_set("item_id").alias("items"))
    small = sum(sizes.values()) <= broadcast_rows
    cases = lambda f: "case m " + " ".join(f"when {m} then {f((m + 1) // 2, m)}" for m in sorted(sizes)) + " end"
    near = F.expr(cases(lambda b, m: _around("w", "p", b, m))).alias("doc_words")
    rows = docs.select("doc_id", "row", "n_words", "w", F.explode(F.expr(f"concat({', '.join(parts)})")).alias("x")).select("doc_id", "row", "n_words", "w", "x.m", "x.p", "x.h")
    if small:
        rows = rows.join(F.broadcast(blocks), ["m", "h"], "left").where("p = 0 or items is not null").select("*", near)
    else:
        apart = F.when(F.col("p") == 0, F.xxhash64("doc_id", "row")).otherwise(F.col("h")).alias("h")  # the rows that stand for documents match nothing and share no key
        rows = rows.select("doc_id", "row", "n_words", "m", "p", apart, near).join(blocks, ["m", "h"], "left").where("p = 0 or items is not null")
    same = "slice(doc_words, doc_pre - d + 1, m) = slice(item_words, item_pre - d + 1, m) and size(slice(doc_words, doc_pre - d + 1, m)) = m"
    rows = rows.withColumn("doc_pre", F.expr(cases(lambda b, m: f"least(p - 1, {m - b})"))).withColumn("starts", F.expr(f"if(p = 0, array(cast(null as int)), transform(filter(sequence(0, least(doc_pre, item_pre)), d -> {same}), d -> p - d))"))
    return rows.select("doc_id", "row", "n_words", F.explode("starts").alias("start"), F.when(F.col("p") > 0, F.col("m")).alias("length"), "items")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per doc_id: row, n_words, n_hit (words inside any window), n_items, items (sorted ids), spans of hit words
    (start from 1, length) and contaminated (20 * n_hit >= n_words, n_hit > 0).

    Rows that repeat a doc_id count as one document: n_words is their largest and their hits are united. Rows without a doc_id
    are a document for each different text. An empty
    benchmark gives no hits; an empty documents table gives no rows.
    """
    hits = find_windows(documents, benchmark, window, broadcast_rows)
    out = hits.groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(F.expr("if(start is null, null, named_struct('start', start, 'length', length))"))).alias("windows"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    merged = """aggregate(windows, cast(array() as array<struct<start:int,length:int>>), (a, x) ->
        case when size(a) = 0 or x.start > element_at(a, -1).start + element_at(a, -1).length then concat(a, array(x))
        else concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start,
             'length', greatest(element_at(a, -1).length, x.start + x.length - element_at(a, -1).start)))) end)"""
    # words beyond the end of all windows before, which are in the order of their starts
    hit = """aggregate(windows, named_struct('n', 0L, 'end', 0), (a, x) -> named_struct('n', a.n + greatest(0, x.start + x.length - greatest(a.end, x.start)),
        'end', greatest(a.end, x.start + x.length)), a -> a.n)"""
    out = out.withColumn("spans", F.expr(merged)).withColumn("n_hit", F.expr(hit))
    return out.select("doc_id", "row", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", F.expr("n_hit > 0 and 20 * n_hit >= n_words").alias("contaminated"))


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, unchanged, whatever their columns; those without a doc_id are judged by their text."""
    bad = contamination(documents.select("doc_id", "text"), benchmark).where("contaminated").select(_key("doc_id", "row").alias("bad"))
    rows = boxed(documents, "doc_id", "text").withColumn("__row", row_of()).withColumn("__key", _key("doc_id", "__row"))
    return rows.join(bad, F.col("__key") == F.col("bad"), "left_anti").select("row.*")

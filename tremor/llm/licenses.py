"""Licence scans: canonical digests of texts against known licence texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import NOT_ALNUM, checkpoint, lower_ascii
from tremor.llm.licence_texts import TEXTS

#: Spellings that count as one (fixed values), applied to whole words in this order.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("organisation", "organization"), ("recognise", "recognize"), ("merchantibility", "merchantability"), ("whilst", "while"), ("v2", "version 2"), ("v3", "version 3")]
#: A copyright statement at the start of a line, up to the end of its sentence or of the line.
COPYRIGHT = r"(?m)^[ \t]*(?:copyright\b|\(c\)|©)(?:[^\n.]|\.[^ \t\n])*\.?"
#: The known table is broadcast up to this many rows and shuffled beyond.
BROADCAST_ROWS = 100_000
#: Words of a known text's start that a document must hold to be looked into.
HEAD = 3


def plain(text: Column) -> Column:
    """Lower case, copyright statements out, punctuation to single spaces. Null and empty give ''."""
    c = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), COPYRIGHT, " ")
    return F.trim(F.regexp_replace(c, NOT_ALNUM, " "))


def spelled(text: Column) -> Column:
    """One spelling for each of SPELLINGS."""
    for old, new in SPELLINGS:
        text = F.regexp_replace(text, rf"\b{old}\b", new)
    return text


def canonical(text: Column) -> Column:
    return spelled(plain(text))


def known(spark: SparkSession, rows=TEXTS) -> DataFrame:
    return spark.createDataFrame(rows, "license_id string, text string")


def any_spelling(word: str) -> str:
    """A regular expression of a canonical word and what SPELLINGS make it of."""
    return "(?:" + "|".join([word, *[old for old, new in SPELLINGS if new == word]]) + ")"


def scan(documents: DataFrame, licenses: DataFrame) -> DataFrame:
    """One row per document: doc_id, license (of the whole text, else null), n_notices (runs of lines that are a known text)
    and notices (their ids, sorted and comma-joined).

    A known text is found where a run of whole lines has its digest after canonical(), however it is wrapped; the whole
    text is such a run, too. Only documents that hold the first words of a known text are looked into, and there
    only lines that begin with such a word: the words from there on, in as many as each known text of that
    first word has, are hashed and the digests joined. Of two ids with one digest the smaller counts. Empty or null texts and
    licences match nothing. Rows that repeat a doc_id add up to one row; rows with a null doc_id take no part.
    """
    small = licenses.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = licenses.select("license_id", F.split(canonical(F.col("text")), " ").alias("k")).where("k[0] != ''")
    table = texts.groupBy(F.sha2(F.array_join("k", " "), 256).alias("digest"), F.col("k")[0].alias("first"), F.size("k").alias("m"), F.slice("k", 1, HEAD).alias("head")).agg(F.min("license_id").alias("license_id"))
    table = checkpoint(table)
    docs = documents.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    longest = table.agg(F.max("m")).first()[0]
    if not longest:
        return docs.groupBy("doc_id").agg(F.lit(None).cast("string").alias("license"), F.lit(0).cast("long").alias("n_notices"), F.lit("").alias("notices"))
    lines = docs.select("doc_id", F.filter(F.transform(F.split("text", "\n"), plain), lambda x: x != "").alias("lines"))
    if small:  # first words as one expression; a larger table leaves all documents in
        heads = sorted({tuple(r["head"]) for r in table.select("head").distinct().collect()})
        holds = F.array_join("lines", " ").rlike(r"\b(?:" + "|".join(" ".join(any_spelling(w) for w in h) for h in heads) + r")\b")
        firsts = F.array(*[F.lit(w) for w in sorted({h[0] for h in heads})])
    else:
        holds, firsts = F.lit(True), None
    lines = lines.select("doc_id", F.when(holds, F.transform("lines", spelled)).otherwise(F.array()).alias("lines"))
    word = lambda x: F.substring_index(x, " ", 1)
    starts = F.expr("if(size(lines) = 0, array(), sequence(0, size(lines) - 1))")
    starts = F.filter(starts, lambda i: F.array_contains(firsts, word(F.get("lines", i)))) if small else starts
    # each line is a word or more, so a known text takes `longest` lines at most
    rest = F.transform(starts, lambda i: F.struct(word(F.get("lines", i)).alias("first"), (i == 0).alias("begins"), F.slice("lines", i + 1, longest).alias("ahead"), (F.size("lines") - i).alias("left")))
    at = lines.select("doc_id", F.explode_outer(rest).alias("x")).select("doc_id", "x.*")
    ends = F.expr("aggregate(ahead, cast(array() as array<int>), (a, x) -> concat(a, array(if(size(a) = 0, 0, element_at(a, -1)) + size(split(x, ' ')))))")
    at = at.select("doc_id", "first", "begins", "left", F.split(F.array_join("ahead", " "), " ").alias("w"), ends.alias("ends"))
    apart = F.concat(F.lit("no word "), F.pmod(F.xxhash64("doc_id"), F.lit(4096)))  # rows without a start match nothing and share no key
    at = at.withColumn("first", F.coalesce("first", apart))
    rows = at.join(F.broadcast(table.drop("head")) if small else table.drop("head"), "first", "left")
    same = F.array_contains("ends", F.col("m")) & (F.sha2(F.array_join(F.slice("w", 1, F.coalesce("m", F.lit(0))), " "), 256) == F.col("digest"))
    whole = F.col("begins") & (F.element_at("ends", -1) == F.col("m")) & (F.size("ends") == F.col("left"))
    found = rows.select("doc_id", F.when(same, F.col("license_id")).alias("id"), F.when(same & whole, F.col("license_id")).alias("whole"))
    return found.groupBy("doc_id").agg(F.min("whole").alias("license"), F.count("id").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("id")), ",").alias("notices"))

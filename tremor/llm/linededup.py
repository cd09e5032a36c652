"""Line dedup: winnowed line hashes find repeated runs of lines; all runs but the first are deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremor.llm.common import KEY_ROWS, SPACES, boxed, checkpoint, spread_join

#: A run of lines counts as a passage from this many words on.
MIN_WORDS = 50


def _row(text) -> Column:
    """A number of 60 bits made of a text's md5: names the row among those of its doc_id and orders them."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _lines(documents: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, row, pos, h, g, n, i, upto, picked) for each line with a word; row tells texts of one id apart, pos the line's
    place in it, i its place among such lines, h and g two hashes of the line.

    Winnowing: of each two neighbouring lines the one with the smaller hash is picked, and each line of `min_words` or
    more. Every run of `min_words` words has one long line or two lines, so it holds a picked line.
    """
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", _row("text").alias("row"), "text")
    lines = texts.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    hashed = lines.select("doc_id", "row", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("line"), "line").alias("g"), F.size(F.array_remove(F.split("line", SPACES), "")).alias("n"))
    # rows of one id and text are one text here, however many they are
    once = hashed.where("n > 0").groupBy("doc_id", "row", "pos").agg(*[F.first(c).alias(c) for c in ("h", "g", "n")])
    w = W.partitionBy("doc_id", "row").orderBy("pos")
    smaller = lambda f: F.coalesce(f("h").over(w) >= F.col("h"), F.lit(False))
    alone = F.lag("h").over(w).isNull() & F.lead("h").over(w).isNull()
    picked = smaller(F.lag) | smaller(F.lead) | alone | (F.col("n") >= min_words)
    return once.select("*", F.row_number().over(w).alias("i"), F.sum("n").over(w).alias("upto"), picked.alias("picked"))


def repeated_lines(documents: DataFrame, min_words: int = MIN_WORDS, key_rows: int = KEY_ROWS) -> DataFrame:
    """(doc_id, row, pos) of each line that lies in a run of lines of `min_words` or more words which also begins earlier,
    in the order of (doc_id, row, line), row being the start of the text's md5.

    Lines are compared whole; lines without a word are skipped over. 1. Picked lines meet by their hash; those picked
    twice or more are anchors. Of two neighbours in a repeated run one is an anchor, as is a long line, so texts are cut
    between two lines that aren't, and pieces without an anchor or of few words drop out. 2. In what is left, matches
    are extended both ways to the shortest runs of `min_words` words forward and back; a line is in a repeated run
    exactly if it is in such a run that is repeated. 3. Runs meet by two hashes of their lines, 128 bits, at
    their first place, and all later ones are deleted. Nothing pairs two occurrences, and joins by a line or run that
    very many texts hold are dealt over tasks, so a line in a third of all documents is linear, even work.
    """
    lines = checkpoint(_lines(documents, min_words))
    many = lines.count()
    counts = checkpoint(lines.groupBy("h").agg(F.count("*").alias("n"), F.count_if("picked").alias("k")).where("n > 1"))
    often = counts.where("k > 1").select("h", F.lit(True).alias("again"))
    doc, piece = W.partitionBy("doc_id", "row").orderBy("i"), W.partitionBy("doc_id", "row", "piece")
    rows = spread_join(lines.withColumnRenamed("n", "words"), often, "h", counts.select("h", "n"), many, ["doc_id", "row", "pos"], "left", key_rows)
    rows = rows.withColumnRenamed("words", "n").withColumn("anchor", F.col("picked") & F.col("again").isNotNull())
    cut = ~F.col("anchor") & ~F.coalesce(F.lag("anchor").over(doc), F.lit(False))
    rows = rows.withColumn("cut", cut.cast("int")).withColumn("piece", F.sum("cut").over(doc))
    rows = rows.withColumn("total", F.sum("n").over(piece)).withColumn("any", F.max("anchor").over(piece)).where(F.col("any") & (F.col("total") >= min_words))
    start = (F.col("upto") - F.col("n")).alias("start")
    line, at = F.struct("pos", start, "upto", "h", "g"), piece.orderBy("i")
    ahead = F.collect_list(line).over(at.rowsBetween(0, min_words - 1)).alias("ahead")
    back = F.collect_list(line).over(at.rowsBetween(1 - min_words, 0)).alias("back")
    rows = rows.select("doc_id", "row", "upto", start, ahead, back)
    # lines that don't yet make min_words words, and one more, if there is one
    forward = f"""if(size(filter(ahead, x -> x.upto - start >= {min_words})) = 0, null,
        slice(ahead, 1, 1 + size(filter(ahead, x -> x.upto - start < {min_words}))))"""
    backward = f"""if(size(filter(back, x -> upto - x.start >= {min_words})) = 0, null,
        slice(back, size(filter(back, x -> upto - x.start >= {min_words})), size(back)))"""
    runs = rows.select("doc_id", "row", F.explode(F.array(F.expr(forward), F.expr(backward))).alias("run")).where("run is not null")
    key = F.expr("named_struct('h', xxhash64(transform(run, x -> x.h)), 'g', xxhash64(transform(run, x -> x.g)))").alias("key")
    runs = checkpoint(runs.select("doc_id", "row", key, F.expr("run[0].pos").alias("first"), F.expr("transform(run, x -> x.pos)").alias("places")))
    place = F.struct("doc_id", "row", "first")
    origin = runs.groupBy("key").agg(F.min(place).alias("origin"), F.max(place).alias("last"), F.count("*").alias("n")).where("origin < last")
    origin = checkpoint(origin.drop("last"))
    later = spread_join(runs, origin.drop("n"), "key", origin.select("key", "n"), runs.count(), ["doc_id", "row", "first"], "inner", key_rows)
    return later.where("struct(doc_id, row, first) > origin").select("doc_id", "row", F.explode("places").alias("pos")).distinct()


def _deduped(documents: DataFrame, min_words: int, key_rows: int) -> DataFrame:
    """(row: the whole row as a struct, lines, gone: places of deleted lines or null, text: what is left)."""
    gone = repeated_lines(documents.select("doc_id", "text"), min_words, key_rows).groupBy("doc_id", "row").agg(F.collect_list("pos").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row"), "gone")
    whole = boxed(documents).withColumn("lines", F.split("row.text", "\n"))
    rows = whole.join(gone, (F.col("row.doc_id") == F.col("gone_id")) & (_row("row.text") == F.col("gone_row")), "left")
    rest = "array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\n')"
    return rows.select("row", "lines", "gone", F.expr(f"if(gone is null, row.text, {rest})").alias("text"))


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS, key_rows: int = KEY_ROWS) -> DataFrame:
    """One row per row of documents: doc_id, n_lines, n_deleted, text without the deleted lines.

    Null texts stay null with no lines; texts without a repeated run stay as they are, as do rows with a null doc_id.
    Rows of one doc_id and different texts are texts of their own, in the order of their md5; rows of one
    doc_id and the same text count as one text, and each of them gets what is left of it.
    """
    out = _deduped(documents.select("doc_id", "text"), min_words, key_rows)
    lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    deleted = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return out.select("row.doc_id", lines.alias("n_lines"), deleted.alias("n_deleted"), "text")


def without_repeats(documents: DataFrame, min_words: int = MIN_WORDS, key_rows: int = KEY_ROWS) -> DataFrame:
    """The documents with their later repeated runs deleted from text; all rows and columns stay, whatever their names."""
    out = _deduped(documents, min_words, key_rows)
    return out.select(F.col("row").withField("text", F.col("text")).alias("row")).select("row.*")

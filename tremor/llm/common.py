"""Small helpers that the operators of this package share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
#: Words are runs of digits, a-z and non-ASCII characters (after lower-casing).
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def words(text: Column, separator: str = SPACES, lower: bool = True) -> Column:
    """The words of a text as an array; null has none."""
    text = F.coalesce(text, F.lit(""))
    return F.array_remove(F.split(lower_ascii(text) if lower else text, separator), "")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of an id written as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def column(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(df: DataFrame, *keep: str) -> DataFrame:
    """(row, keep..): all columns as one struct, so that names of our own can't clash with them; open with `row.*`."""
    return df.select(F.struct(*[column(c) for c in df.columns]).alias("row"), *[column(c) for c in keep])


#: A key with more rows than this, and than a 4096th of all rows, is dealt over several tasks by spread_join.
KEY_ROWS = 1000


def spread_join(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, total: int, by: list[str], how: str = "inner", key_rows: int = KEY_ROWS) -> DataFrame:
    """left.join(right, key, how) for a left whose keys may be hot and a right of few rows a key.

    `sizes` has (key, n), at least for keys of many left rows, and `total` is the number of left rows. Keys of more than
    max(key_rows, total / 4096) rows, so 4096 keys at most, are found first and broadcast with their number of parts: left rows of such
    a key go to a part by a hash of the columns `by`, and its right rows to every part.
    """
    limit = max(key_rows, -(-total // 4096))
    hot = sizes.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("__parts"))
    found = hot.collect() if total > limit else []  # 4096 keys at most
    if not found:
        return left.join(right, key, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(found, hot.schema))
    part = F.pmod(F.xxhash64(*by), F.coalesce("__parts", F.lit(1)).cast("long")).cast("int")
    dealt = left.join(hot, key, "left").withColumn("__part", part).drop("__parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    met = right.join(hot, key, "left").withColumn("__part", copies).drop("__parts")
    return dealt.join(met, [key, "__part"], how).drop("__part")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir or the one set on the context; a new temporary one in local mode alone."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tremor-checkpoint-")
        sc.setCheckpointDir(named)
    return named


def release(spark: SparkSession) -> None:
    """Has shuffle files dropped that nothing refers to any more, as their results are checkpointed, now and not when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()

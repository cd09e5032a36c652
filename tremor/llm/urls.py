"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import checkpoint, lower_ascii

#: Fixed values: (verdict, host, start of the path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Rates of label 1 (block) of a URL's suffix (last host label), last two labels, and first and second path segment, and the second's first character.
RATES = ["suffix_rate", "domain_rate", "segment1_rate", "segment2_rate", "start2_rate"]
FEATURES = [
    "length", "depth", "digit_ratio", "entropy", "n_params", "n_labels", "host_length", "hyphens", "suffix_length", "path_length", "last_length",
    "first_label", "has_extension", "has_fragment", *RATES,
]
#: A value's rate is kept from so many labelled URLs on, and at most so many values of each kind, the commonest; others have the rate of all.
LEAST_SEEN, MOST_VALUES = 5, 2_000
#: Labelled URLs that are learned from, about.
SAMPLE = 10_000


def host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; '' without one."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; '' without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits columns host and path; null without one. Of equally long rules the first wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits a character of a text's own frequencies; 0 for an empty one."""
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.length(text) - F.length(F.replace(text, c, F.lit(""))))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    return F.aggregate(F.filter(counts, lambda k: k > 0), F.lit(0.0), lambda a, k: a - k / n * F.log2(k / n))


def lexical(pages: DataFrame, *keep: str) -> DataFrame:
    """The lexical features of column url, the columns in `keep`, and `values`, the five strings that RATES are looked up by; null counts as empty."""
    u = F.coalesce(F.col("url"), F.lit(""))
    rows = pages.select(*keep, u.alias("u"), host(u).alias("h"), path(u).alias("p"))
    one = F.lit(1)
    digits = F.length("u") - F.length(F.translate("u", "0123456789", ""))
    labels, segments = F.split("h", r"\."), F.filter(F.split("p", "/"), lambda x: x != "")
    last = F.element_at(F.split("p", "/"), -1)
    query = F.regexp_extract("u", r"(?s)\?([^#]*)", 1)
    part = lambda i: F.coalesce(F.get(segments, F.lit(i)), F.lit(""))
    values = F.array(F.element_at(labels, -1), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, one), 2), "."), part(0), part(1), F.substring(part(1), 1, 1))
    d = lambda c, name: c.cast("double").alias(name)
    return rows.select(
        *keep,
        d(F.length("u"), "length"),
        d(F.size(segments), "depth"),
        d(digits / F.greatest(F.length("u"), one), "digit_ratio"),
        entropy(F.col("u")).alias("entropy"),
        d(F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "n_params"),
        d(F.size(labels), "n_labels"),
        d(F.length("h"), "host_length"),
        d(F.length("h") - F.length(F.replace(F.col("h"), F.lit("-"), F.lit(""))), "hyphens"),
        d(F.length(F.element_at(labels, -1)), "suffix_length"),
        d(F.length("p"), "path_length"),
        d(F.length(last), "last_length"),
        d(F.length(F.element_at(labels, 1)), "first_label"),
        d(last.contains("."), "has_extension"),
        d(F.col("u").contains("#"), "has_fragment"),
        values.alias("values"),
    )


def learned_rates(rows: DataFrame, share: float) -> list[dict[str, float]]:
    """For each of RATES, value -> rate of label 1 among the labelled URLs that have it, drawn towards `share` by LEAST_SEEN URLs."""
    out = []
    for k in range(len(RATES)):
        seen = rows.groupBy(F.get("values", F.lit(k)).alias("v")).agg(F.count("*").alias("n"), F.sum("label").alias("y")).where(F.col("n") >= LEAST_SEEN)
        top = seen.orderBy(F.desc("n"), "v").limit(MOST_VALUES).collect()
        out.append({r.v: (r.y + share * LEAST_SEEN) / (r.n + LEAST_SEEN) for r in top})
    return out


def with_rates(rows: DataFrame, rates: list[dict[str, float]], share: float) -> DataFrame:
    """rows with the columns RATES in place of `values`; the tables are joined as small broadcasts."""
    spark = rows.sparkSession
    for k, (name, table) in enumerate(zip(RATES, rates)):
        t = spark.createDataFrame(list(table.items()), f"__v string, {name} double")
        rows = rows.withColumn("__k", F.get("values", F.lit(k))).join(F.broadcast(t), F.col("__k") == F.col("__v"), "left")  # MOST_VALUES rows at most
        rows = rows.drop("__k", "__v").withColumn(name, F.coalesce(name, F.lit(share)))
    return rows.drop("values")


def fit(urls: DataFrame, sample: int = SAMPLE, trees: int = 20, depth: int = 4):
    """Boosted trees from rows (url, label 1 = block, 0 = allow), each url once; about `sample` urls, chosen by a hash, are used.

    A url with both labels counts by the greater. Returns {"trees": model, "rates": .., "share": share of label 1}; where
    only one label is there, trees is None and the share is 1.0 or 0.0 (0.0 without any).
    """
    rows = urls.where("label is not null and url is not null")
    rows = rows.groupBy("url").agg(F.max("label").cast("double").alias("label"))
    many = rows.count()
    rows = rows.where(F.pmod(F.xxhash64(F.lit("fit"), "url"), F.lit(1 << 20)) < min(1.0, sample / max(many, 1)) * (1 << 20))
    rows = checkpoint(lexical(rows, "label").coalesce(4))  # a bounded sample
    seen = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = seen.get(1.0, 0) / max(sum(seen.values()), 1)
    rates = learned_rates(rows, share)
    if len(seen) < 2:
        return {"trees": None, "rates": rates, "share": share}
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(with_rates(rows, rates, share))
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7).fit(vectors)
    return {"trees": model, "rates": rates, "share": share}


def judge(pages: DataFrame, model: dict, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_score (the trees' probability of a block).

    The longest rule that fits decides; without one the trees do, a block from `threshold` on. Null urls, and urls
    without ://, have an empty host and path and are judged by the trees. Repeated rows and null ids are judged like any.
    """
    rows = lexical(pages, "page_id", "url").withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    if model["trees"] is None:
        rows = rows.withColumn("block_score", F.lit(model["share"]))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(with_rates(rows, model["rates"], model["share"]))
        rows = model["trees"].transform(vectors).withColumn("block_score", F.element_at(vector_to_array("probability"), 2))
    rule, verdict = matching_rule(rules)
    guess = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, guess).alias("verdict"), "block_score")


def rule_labels(pages: DataFrame, rules=RULES) -> DataFrame:
    """(url, label) of the pages that a rule decides: the labelled URLs that the trees learn from."""
    rows = pages.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    _, verdict = matching_rule(rules)
    return rows.select("url", F.when(verdict == "block", 1.0).when(verdict == "allow", 0.0).alias("label")).where("label is not null")

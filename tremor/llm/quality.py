"""Quality classifier: a sparse ensemble of rules taken from tree paths, compiled into column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import UPPER, checkpoint, words

FEATURES = ["n_words", "word_length", "punct", "upper", "digits", "distinct", "repeats", "line_words", "long_words"]
#: Labelled rows that are learned from, about; a documented bound on the fit, not on what is scored.
SAMPLE = 8_000
PUNCT = "!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~"


def features(documents: DataFrame, *keep: str) -> DataFrame:
    """Statistics of whole texts, and the columns named in `keep`. Null and empty texts have 0 in each."""
    t = documents.select(*keep, F.coalesce("text", F.lit("")).alias("text")).withColumn("w", words(F.col("text"), lower=False))
    n, size = F.size("w"), F.length("text")
    share = lambda chars: (size - F.length(F.translate("text", chars, ""))) / F.greatest(size, F.lit(1))
    per_word = lambda x: x / F.greatest(n, F.lit(1))
    twice = F.expr("if(size(w) < 2, 0, size(filter(w, (x, i) -> i > 0 and x = w[greatest(i - 1, 0)])))")
    return t.select(
        *keep,
        n.cast("double").alias("n_words"),
        per_word(size).alias("word_length"),
        share(PUNCT).alias("punct"),
        share(UPPER).alias("upper"),
        share("0123456789").alias("digits"),
        per_word(F.size(F.array_distinct("w"))).alias("distinct"),
        per_word(twice).alias("repeats"),
        (n / F.greatest(F.size(F.split("text", "\n")), F.lit(1))).alias("line_words"),
        per_word(F.size(F.filter("w", lambda x: F.length(x) > 12))).alias("long_words"),
    )


def tree_rules(debug: str) -> list[list[tuple[int, str, float]]]:
    """The paths of a printed tree ensemble, inner nodes too, as lists of (feature, <= or >, threshold)."""
    path, rules = [], {}
    for line in debug.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth = len(m[1])
            path = [x for x in path if x[0] < depth] + [(depth, (int(m[2]), m[3], float(m[4])))]
            rules[tuple(sorted(x[1] for x in path))] = None
        elif "Tree " in line:
            path = []
    return [list(r) for r in rules]


def condition(rule: list[tuple[int, str, float]]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(FEATURES[i]) <= x if op == "<=" else F.col(FEATURES[i]) > x for i, op, x in rule])


def fit(documents: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE, trees: int = 12, depth: int = 3, penalty: float = 0.002) -> dict:
    """Learn {"bias": b, "rules": [(rule, weight), ..]} from labelled documents where `usable` (a condition on doc_id) holds.

    About `sample` labelled rows are used, chosen by a hash of the id, the rest being left. Trees are grown on the
    statistics, all their paths become rules, and a logistic regression with an L1 penalty keeps few. Without labels of both
    kinds, or without a rule, the score is the share of label 1 everywhere (0.5 without any). Other columns than doc_id and text, whatever their
    names, take no part.
    """
    marked = labels.where(usable & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    many = marked.count()
    marked = marked.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) < min(1.0, sample / max(many, 1)) * (1 << 20))
    rows = checkpoint(features(documents.select("doc_id", "text").join(F.broadcast(marked), "doc_id"), "label").coalesce(8))  # marked has about `sample` rows
    seen = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = (seen.get(1.0, 0) / sum(seen.values())) if seen else 0.5
    flat = {"prior": min(max(share, 1e-3), 1 - 1e-3), "rules": []}
    if len(seen) < 2:
        return flat
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="onethird", subsamplingRate=0.8).fit(vectors)
    rules = tree_rules(forest.toDebugString)
    if not rules:  # no split tells the labels apart
        return flat
    fired = rows.select("label", *[condition(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    fired = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(fired).select("label", "x")
    lasso = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=True).fit(fired)
    weights = lasso.coefficients.toArray()
    return {"bias": float(lasso.intercept), "rules": [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6]}


def compile_score(model: dict) -> Column:
    """The model as a column expression over FEATURES: a sum of rule weights through a logistic."""
    if "prior" in model:
        return F.lit(model["prior"])
    total = F.lit(model["bias"])
    for rule, weight in model["rules"]:
        total = total + F.when(condition(rule), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def classify(documents: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 from `threshold` on). Each row, repeated or not, is scored on its own text alone."""
    return features(documents, "doc_id").select("doc_id", compile_score(model).alias("score")).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))

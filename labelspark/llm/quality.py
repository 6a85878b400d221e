"""Quality classifier: a sparse ensemble of rules over text statistics, as Spark columns."""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import WORD, held_out, query, table
from labelspark.session import materialize

#: Labelled rows a model is trained on at most, taken by hash order of their ids.
TRAINING_ROWS = 20_000
THRESHOLD = 0.3

Rule = tuple[tuple[int, str, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; 0 where a text has nothing to measure. Null counts as empty."""
    t = F.coalesce(text, F.lit(""))

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace(t, pattern, ""))

    def per(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")

    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    n, chars, n_lines = F.size(words), F.length(t), F.size(lines)
    return {
        "log_words": F.log1p(n).cast("double"),
        "distinct_share": per(F.size(F.array_distinct(words)), n),
        "distinct_root": per(F.size(F.array_distinct(words)), F.sqrt(n)),
        "word_length": per(left(r"[\x20\x09-\x0D]+"), n),
        "upper_share": per(left(r"[^\p{Lu}]+"), chars),
        "digit_share": per(left(r"[^0-9]+"), chars),
        "symbol_share": per(left(r"[\p{L}\p{N}\s.,;:'\"()-]+"), chars),
        "stop_marks": per(F.regexp_count(t, F.lit(r"[.!?]")), n),
        "commas": per(F.regexp_count(t, F.lit(",")), n),
        "distinct_lines": per(F.size(F.array_distinct(lines)), n_lines),
        "line_words": per(n, n_lines),
    }


FEATURES = [
    "log_words", "distinct_share", "distinct_root", "word_length", "upper_share", "digit_share", "symbol_share",
    "stop_marks", "commas", "distinct_lines", "line_words",
]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of its text."""
    return docs.select("doc_id", *[c.alias(name) for name, c in statistics(F.col("text")).items()])


def tree_paths(described: str) -> list[Rule]:
    """The conjunctions leading to every node below the root of the printed trees."""
    rules: dict[Rule, None] = {}
    path: list[tuple[int, str, float, int]] = []
    for line in described.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line)
        if line.strip().startswith("Tree"):
            path = []
        elif found:
            depth = len(found[1])
            while path and path[-1][3] >= depth:
                path.pop()
            path.append((int(found[2]), found[3], float(found[4]), depth))
            rules[tuple(sorted(step[:3] for step in path))] = None
    return list(rules)


def holds(rule: Rule, prefix: str = "") -> Column:
    """A conjunctive rule as a condition on the statistics."""
    made = F.lit(True)
    for feature, sign, at in rule:
        own = F.col(prefix + FEATURES[feature])
        made = made & ((own <= at) if sign == "<=" else (own > at))
    return made


def probability(model: tuple[float, list[tuple[float, Rule]]], prefix: str = "") -> Column:
    """The compiled ensemble: the logistic of the weights of the rules that hold."""
    total = F.lit(model[0])
    for weight, rule in model[1]:
        total = total + F.when(holds(rule, prefix), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, trees: int = 16, depth: int = 3, penalty: float = 0.0015,
          rows: int = TRAINING_ROWS, seed: int = 3) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept and weighted rules, from labelled documents that aren't held out.

    ``labels`` (doc_id, quality): at most ``rows`` of them, by hash order; null qualities are left
    out. A shallow forest gives the rules, a lasso logistic regression their weights; rules of weight
    0 go. Without both kinds of label the share of good ones is all there is to learn.
    """
    chosen = labels.select("doc_id", F.col("quality").cast("double").alias("label")).where(
        "doc_id is not null and label is not null"
    ).where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    known = measured(docs.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id"))
    # Forests draw by partition and place, and written files come back in any order, so rows are dealt after reading.
    data = materialize(known.join(F.broadcast(chosen), "doc_id"), "training").repartition(8, "doc_id").sortWithinPartitions(
        "doc_id", *FEATURES, "label")
    totals = data.agg(F.count("*").alias("n"), F.sum("label").alias("good")).first()
    if not totals.n or totals.good in (0, totals.n):
        share = ((totals.good or 0) + 1) / (totals.n + 2)
        return float(_logit(share)), []
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, maxBins=64, seed=seed,
        featureSubsetStrategy="0.7", minInstancesPerNode=5,
    ).fit(data.select("label", array_to_vector(F.array(*FEATURES)).alias("x")))
    rules = tree_paths(forest.toDebugString)
    if not rules:
        return float(_logit(totals.good / totals.n)), []
    tested = data.select("label", array_to_vector(
        F.array(*[holds(r).cast("double") for r in rules])).alias("x"))
    fitted = LogisticRegression(
        featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False,
    ).fit(tested)
    return float(fitted.intercept), [(float(w), r) for w, r in zip(fitted.coefficients, rules) if w]


def _logit(share: float) -> float:
    return math.log(share / (1 - share))


def scored(docs: DataFrame, model: tuple[float, list[tuple[float, Rule]]]) -> DataFrame:
    """doc_id, score (0 to 1) and the statistics of every document; null and empty texts too."""
    return measured(docs).withColumn("score", probability(model))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, all columns kept as they are."""
    model = train(docs.select("doc_id", "text"), labels)
    prefix = "_quality_"
    # A condition on the score alone would move below the statistics, and work each out again wherever a
    # rule tests it; one on a row's number can't.
    stats = docs.withColumns({prefix + n: c for n, c in statistics(F.col("text")).items()} | {
        prefix + "row": F.monotonically_increasing_id()})
    good = (probability(model, prefix) >= threshold) & (F.col(prefix + "row") >= 0)
    return stats.where(good).select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op3_quality")
def op3(spark, sf):
    """Quality scores of all documents, from a model of the labels that aren't held out."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf, "labels"))
    return scored(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )

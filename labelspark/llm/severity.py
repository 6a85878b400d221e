"""Toxicity severity: cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import held_out, query, table
from labelspark.session import materialize

#: Bounds of the training data: labelled rows (by hash order of their ids) and features kept.
TRAINING_ROWS, FEATURES = 20_000, 4_096
LETTERS = re.compile(r"[^\W\d_]+")
#: Letters of a word's beginning that form a feature of their own.
STEM = 6


@dataclass(frozen=True)
class OrdinalModel:
    """Shared weights of the features and ordered thresholds between the grades."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]


def features(text: str | None) -> set[str]:
    """Distinct words of a whole text, and the beginnings of longer ones (marked with ``*``)."""
    words = set(LETTERS.findall(text.lower())) if text else set()
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, n_features: int, n_grades: int,
                ridge: float = 5e-5, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of P(grade > k) = sigmoid(w.x - theta_k), by Adam on the whole sample.

    The thresholds stay ordered, as each is the one before plus a positive step.
    """
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([np.array(r, dtype=np.int64) for r in rows]) if len(row) else row
    w = np.zeros(n_features)
    above = np.array([(grades > k).mean() for k in range(n_grades - 1)]).clip(1e-6, 1 - 1e-6)
    theta = np.log(1 / above - 1)
    raw = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    params = np.concatenate([w, raw])
    m, v = np.zeros_like(params), np.zeros_like(params)
    grid = np.arange(len(grades))

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))

    for step in range(1, steps + 1):
        w, raw = params[:n_features], params[n_features:]
        gaps = np.exp(raw[1:])
        theta = np.concatenate([raw[:1], raw[0] + np.cumsum(gaps)])
        z = np.bincount(row, weights=w[col], minlength=len(grades)) if len(row) else np.zeros(len(grades))
        tail = sigmoid(z[:, None] - theta[None, :])  # P(grade > k)
        upper = np.concatenate([np.ones((len(grades), 1)), tail], axis=1)
        lower = np.concatenate([tail, np.zeros((len(grades), 1))], axis=1)
        chance = np.maximum(upper[grid, grades] - lower[grid, grades], 1e-12)
        slope = tail * (1 - tail)
        d_upper = np.concatenate([np.zeros((len(grades), 1)), slope], axis=1)[grid, grades] / chance
        d_lower = np.concatenate([slope, np.zeros((len(grades), 1))], axis=1)[grid, grades] / chance
        dz = -(d_upper - d_lower) / len(grades)
        dtheta = np.bincount(grades, weights=d_upper, minlength=n_grades)[1:] - np.bincount(
            grades, weights=d_lower, minlength=n_grades)[:-1]
        dtheta = dtheta / len(grades)
        draw = np.concatenate([[dtheta.sum()], np.cumsum(dtheta[::-1])[::-1][1:] * gaps])
        dw = (np.bincount(col, weights=dz[row], minlength=n_features) if len(row) else 0) + ridge * w
        grad = np.concatenate([dw, draw])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    raw = params[n_features:]
    return params[:n_features], np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, kept: int = FEATURES) -> OrdinalModel:
    """Fit severity grades 0 to 3 on ``labels`` (doc_id, toxic) that aren't held out.

    The labels say only whether a text is toxic. Grade 0 is a text that isn't; grades 1 to 3 are the
    thirds of the toxic texts by how many of their features speak for toxicity. A feature speaks for
    it, and is kept at all, by the z score of its log odds over the sample, copies of a text counted
    once. Without both labels, nothing is learnt and every score is 0.
    """
    chosen = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id is not null and toxic is not null"
    ).where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(rows)

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"toxic": frame["toxic"], "found": [sorted(features(t)) for t in frame["text"]]})

    sample = materialize(
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy(F.xxhash64("text").alias("copy"))
        .agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).select("text", "toxic")
        .mapInPandas(split, "toxic int, found array<string>"), "training",
    )
    totals = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    bad, clean = totals.bad or 0, totals.n - (totals.bad or 0)
    if not bad or not clean:
        return OrdinalModel({}, (20.0, 21.0, 22.0))
    by_feature = sample.select("toxic", F.explode("found").alias("feature")).groupBy("feature").agg(
        F.sum("toxic").alias("t"), F.count("*").alias("n"))
    t, c = F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5
    odds = F.log(t / (bad + 1 - t)) - F.log(c / (clean + 1 - c))
    strong = by_feature.where("n >= 3").withColumn(
        "z", odds / F.sqrt(1 / t + 1 / c)).where("abs(z) >= 2").orderBy(F.desc(F.abs("z")), "feature").limit(kept)
    vocabulary = [(r.feature, r.z) for r in strong.collect()]
    at = {f: i for i, (f, _) in enumerate(vocabulary)}
    speaks = np.array([z > 3 for _, z in vocabulary])

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"toxic": frame["toxic"], "found": [
                sorted(at[f] for f in row if f in at) for row in frame["found"]]})

    held = sample.mapInPandas(numbered, "toxic int, found array<int>").orderBy("toxic", "found").collect()
    rows_ = [list(r.found) for r in held]
    toxic = np.array([r.toxic for r in held])
    loud = np.array([int(speaks[r].sum()) if r else 0 for r in rows_])
    grades = np.zeros(len(held), dtype=np.int64)
    cuts = np.quantile(loud[toxic == 1], [1 / 3, 2 / 3])
    grades[toxic == 1] = 1 + (loud[toxic == 1] > cuts[0]).astype(int) + (loud[toxic == 1] > cuts[1]).astype(int)
    w, theta = fit_ordinal(rows_, grades, len(vocabulary), 4)
    return OrdinalModel({f: float(w[i]) for f, i in at.items()}, tuple(float(x) for x in theta))


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with p_toxic, severity (expected grade), grade and toxic.

    ``severity`` is the sum over the thresholds of the chance to be above them, ``grade`` the likeliest
    grade, ``toxic`` 1 if a grade above 0 is likelier than not. Null and empty texts have no feature
    and get the grade of a text without any. Repeated rows come back each; other columns go.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def grade(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        theta, known = np.array(own.thresholds), own.weights.keys()
        for frame in frames:
            z = np.array([sum(own.weights[f] for f in sorted(features(t) & known)) for t in frame["text"]], dtype=float)
            tail = 1 / (1 + np.exp(-np.clip(z[:, None] - theta[None, :], -35, 35)))
            edges = np.concatenate([np.ones((len(z), 1)), tail, np.zeros((len(z), 1))], axis=1)
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "p_toxic": tail[:, 0], "severity": tail.sum(axis=1),
                "grade": (edges[:, :-1] - edges[:, 1:]).argmax(axis=1), "toxic": (tail[:, 0] >= 0.5).astype(int),
            })

    # Ids travel as text: pandas has no whole numbers beside nulls.
    made = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(
        grade, "doc_id string, p_toxic double, severity double, grade int, toxic int")
    return made.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


@query("op4_severity")
def op4(spark, sf):
    """Severity of all documents, from a model of the labels that aren't held out."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf, "labels")))

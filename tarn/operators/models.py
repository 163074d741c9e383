"""Models: fits per entity in grouped Python, and cross-fitted Spark ML classifiers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ridge_logit(x: np.ndarray, y: np.ndarray, offset: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 12) -> np.ndarray:
    """Coefficients of a weighted logistic regression with given offsets and an L2 penalty, by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta + offset, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        move = np.linalg.solve(curve, slope)
        beta = beta + move
        if np.abs(move).max() < 1e-10:
            break
    return beta


def entity_logits(df: DataFrame, entity: str, target: str, offset: str, features: list[str], ridge: float = 5.0, least: int = 25) -> DataFrame:
    """(entity, n, beta array<double>): a ridge logit for every entity with at least `least` rows; features get an intercept.

    Rows are first added up by entity and equal features, offsets and targets, so a hot entity is as large as its number of
    different situations. Rows with a null in a used column do not count.
    """
    used = [entity, target, offset, *features]
    cells = df.dropna(subset=used).groupBy(*used).agg(F.count(F.lit(1)).alias("w"))
    kind = df.schema[entity].dataType.simpleString()

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        w = frame["w"].to_numpy(float)
        beta = None
        if w.sum() >= least:
            x = np.column_stack([np.ones(len(frame)), frame[features].to_numpy(float)])
            beta = ridge_logit(x, frame[target].to_numpy(float), frame[offset].to_numpy(float), w, ridge).tolist()
        return pd.DataFrame({"e": [key[0]], "n": [int(w.sum())], "beta": [beta]})

    fits = cells.groupBy(entity).applyInPandas(run, f"e {kind}, n bigint, beta array<double>")
    return fits.filter("beta is not null").withColumnRenamed("e", entity)


def prepared(train: DataFrame, features: list[str]):
    """A fitted preparation that adds `features`: medians for nulls, standardised, both learnt from `train` alone."""
    names = [f"__{f}" for f in features]
    raw = lambda df: df.select("*", *(F.col(f).cast("double").alias(n) for f, n in zip(features, names)))
    stages = [
        Imputer(inputCols=names, outputCols=[f"{n}_i" for n in names], strategy="median"),
        VectorAssembler(inputCols=[f"{n}_i" for n in names], outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="features", withMean=True),
    ]
    fitted = Pipeline(stages=stages).fit(raw(train))
    return lambda df: fitted.transform(raw(df)).drop("__raw", *names, *(f"{n}_i" for n in names))


def classifier(kind: str, label: str, weight: str | None, seed: int = 42):
    """A logistic regression, a random forest (both multi-class) or a boosted tree (two classes)."""
    common = {"labelCol": label, "featuresCol": "features"} | ({"weightCol": weight} if weight else {})
    if kind == "logistic":
        return LogisticRegression(regParam=0.01, **common)
    if kind == "forest":
        return RandomForestClassifier(numTrees=20, maxDepth=6, seed=seed, **common)
    return GBTClassifier(maxIter=10, maxDepth=3, seed=seed, **common)


def cross_fit(df: DataFrame, features: list[str], fold: str, folds: int, label: str, kind: str = "logistic", weight: str | None = None, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """Adds `probability` (array by class): each row scored by a model fitted on the other folds, the mean over seeds; medians and
    scales are of the other folds too. Folds are given, so that related rows can share one. Rows without a label are scored,
    but no model is fitted on them; a fold whose other folds have no labelled row gets null."""
    out = None
    for k in range(folds):
        train, test = df.filter((F.col(fold) != k) & F.col(label).isNotNull()), df.filter(F.col(fold) == k)
        if not train.take(1):  # no model, no score
            none = test.withColumn("probability", F.lit(None).cast("array<double>"))
            out = none if out is None else out.unionByName(none)
            continue
        ready = prepared(train, features)
        train, scored = ready(train), ready(test)
        for i, seed in enumerate(seeds):
            model = classifier(kind, label, weight, seed).fit(train)
            model.setPredictionCol("").setRawPredictionCol(f"__r{i}").setProbabilityCol(f"__p{i}")
            scored = model.transform(scored).drop(f"__r{i}").withColumn(f"__p{i}", vector_to_array(f"__p{i}"))
        mean = F.transform(F.sequence(F.lit(0), F.size("__p0") - 1), lambda j: sum((F.get(f"__p{i}", j) for i in range(len(seeds))), F.lit(0.0)) / len(seeds))
        scored = scored.withColumn("probability", mean).drop("features", *(f"__p{i}" for i in range(len(seeds))))
        out = scored if out is None else out.unionByName(scored)
    return out


def pseudo_positives(scored: DataFrame, score: str, label: str, weight: str, share: float) -> DataFrame:
    """The rows without a label that score above one half, as positives of a low weight."""
    return scored.filter((F.col(score) > 0.5) & F.col(label).isNull()).withColumns({label: F.lit(1.0), weight: F.lit(share)})


def platt(df: DataFrame, score: str, label: str) -> tuple[float, float]:
    """(slope, intercept) of the logit of a label on a score."""
    vector = VectorAssembler(inputCols=[score], outputCol="features").transform(df)
    model = LogisticRegression(labelCol=label).fit(vector)
    return float(model.coefficients[0]), float(model.intercept)


def platt_scaled(score: Column, slope: float, intercept: float) -> Column:
    return 1 / (1 + F.exp(-(score * slope + intercept)))


def clusters(df: DataFrame, features: list[str], k: int, seed: int = 1) -> DataFrame:
    """Adds `cluster` by k-means over the prepared features."""
    ready = prepared(df, features)(df)
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(ready).transform(ready).drop("features")


def nested_cross_fit(df: DataFrame, features: list[str], outer: str, inner: str, folds: int, label: str, kind: str, weight: str | None = None) -> DataFrame:
    """Two stages: a second model adds the first one's score to the features. For each outer fold, the first stage is
    cross-fitted over inner folds of the other outer folds and, for the held-out rows, fitted on all of those."""
    out = None
    first_score = lambda d: d.withColumn("__s", F.coalesce(F.get("probability", F.lit(1)), F.lit(0.5))).drop("probability")
    for k in range(folds):
        train, test = df.filter((F.col(outer) != k) & F.col(label).isNotNull()), df.filter(F.col(outer) == k)
        first = first_score(cross_fit(train, features, inner, folds, label, kind, weight))
        held = first_score(scored_by(train, test, features, label, kind, weight))
        second = scored_by(first, held, [*features, "__s"], label, kind, weight).drop("__s")
        out = second if out is None else out.unionByName(second)
    return out


def scored_by(train: DataFrame, test: DataFrame, features: list[str], label: str, kind: str, weight: str | None = None, seed: int = 42) -> DataFrame:
    """test with the `probability` of one model fitted on train; null if train has no labelled row."""
    if not train.filter(F.col(label).isNotNull()).take(1):
        return test.withColumn("probability", F.lit(None).cast("array<double>"))
    ready = prepared(train, features)
    model = classifier(kind, label, weight, seed).fit(ready(train.filter(F.col(label).isNotNull()))).setPredictionCol("").setRawPredictionCol("__r").setProbabilityCol("__p")
    return model.transform(ready(test)).withColumn("probability", vector_to_array("__p")).drop("__r", "__p", "features")


@F.pandas_udf(DoubleType())
def binomial_surprise(hits: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """-ln P(X >= hits) of a binomial count, by summing exact terms; null where an input is."""
    known = (hits.notna() & n.notna() & p.notna()).to_numpy()
    h, m, q = hits.fillna(0).to_numpy(np.int64), n.fillna(0).to_numpy(np.int64), p.fillna(0.5).to_numpy(float)
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, m.max(initial=0) + 1)))])
    out = np.full(len(h), np.nan)
    for i in np.flatnonzero(known):
        k = np.arange(max(h[i], 0), m[i] + 1)
        terms = log_factorial[m[i]] - log_factorial[k] - log_factorial[m[i] - k] + k * np.log(q[i]) + (m[i] - k) * np.log1p(-q[i])
        top = terms.max(initial=-np.inf)
        out[i] = max(0.0, -(top + np.log(np.exp(terms - top).sum()))) if len(k) else np.inf
    return pd.Series(out).where(known)

"""The tree ensemble on a rule that no linear model finds."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.functions.columns import argmax
from candela.operators import samples

T0 = datetime(2024, 1, 1)


def test_trees_find_what_a_linear_model_does_not(spark):
    r = np.random.default_rng(2)
    n = 900
    a, b = r.normal(size=n), r.normal(size=n)
    y = [int(i >= 1 and a[i] * b[i - 1] > 0) if r.random() > 0.02 else 2 for i in range(n)]  # the sign of a product; a rare class of noise
    df = spark.createDataFrame([("A", T0 + timedelta(minutes=i), float(a[i]), float(b[i]), y[i]) for i in range(n)], "symbol string, bar_ts timestamp_ntz, a double, b double, target int")
    windows = samples.sliding_windows(df, ["a", "b"], "target", 2).persist()
    train, later = windows.filter("sample < 600"), windows.filter("sample >= 600 AND target < 2")

    def right(model):
        return samples.score_windows(later, model).select((argmax(F.col("probs")) == F.col("target")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]

    forest = samples.fit_tree_classifier(train, trees=30, depth=6, balanced=False)
    assert right(forest) > 0.85 and right(samples.fit_trend_classifier(train)) < 0.65
    top = samples.feature_importances(spark, forest, ["a", "b"], 2).orderBy(F.desc("importance")).collect()
    assert {(x["feature"], x["lag"]) for x in top[:2]} == {("a", 0), ("b", 1)} and sum(x["importance"] for x in top) == pytest.approx(1)
    weights = {x["label"]: x["weight"] for x in samples.class_weights(train).collect()}
    counts = {x["target"]: x["count"] for x in train.groupBy("target").count().collect()}
    assert all(weights[k] * counts[k] == pytest.approx(sum(counts.values()) / 3) for k in counts)
    assert samples.fit_tree_classifier(train, trees=3, depth=3).numClasses == 3
    with pytest.raises(ValueError):
        samples.feature_importances(spark, forest, ["a"], 2)

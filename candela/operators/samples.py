"""Sliding-window samples, chronological split, scoring and signals (O-61 .. O-70)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.functions.columns import argmax, confidence
from candela.operators.scan import frame_window, framed, indexed, with_facts


def sliding_windows(df: DataFrame, features: Sequence[str], target: str, length: int = 64) -> DataFrame:
    """symbol, bar_ts (of the last row), window (array of rows of features), target: one sample a full window. Fewer rows than
    one window are an error."""
    require_rows(df, length)
    w = frame_window().rowsBetween(-(length - 1), 0)
    src = df if "_i" in df.columns else indexed(df)
    rows = src.select("symbol", "bar_ts", "_i", F.array(*[F.col(c).cast("double") for c in features]).alias("_row"), F.col(target).alias("target"))
    out = framed(rows, {"window": F.collect_list("_row").over(w)}, before=length - 1, rows=max(1024, 4 * length))
    return out.filter(F.col("_i") >= length - 1).select("symbol", "bar_ts", (F.col("_i") - length + 1).alias("sample"), "window", "target")


def require_rows(df: DataFrame, length: int) -> DataFrame:
    n = df.limit(length).count()
    if n < length:
        raise ValueError(f"{n} rows are fewer than one window of {length}")
    return df


def chrono_split(df: DataFrame, train: float = 0.7, validation: float = 0.15, test: float = 0.15, index: str | None = None, purge: int = 0) -> DataFrame:
    """Adds split (train, validation, test) by position in each series, from a row number (made if none is named). purge
    leaves out so many rows after each boundary."""
    if abs(train + validation + test - 1) > 1e-6:
        raise ValueError("ratios must sum to 1")
    src = df if index else indexed(df, "_split_i")
    i = F.col(index or "_split_i")
    out = with_facts(src, src.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")))
    a, b = F.floor(F.col("_n") * F.lit(train)), F.floor(F.col("_n") * F.lit(train + validation))
    out = out.withColumn("split", F.when(i < a, "train").when(i < b, "validation").otherwise("test"))
    if purge:
        out = out.filter(~((i >= a) & (i < a + purge)) & ~((i >= b) & (i < b + purge)))
    return out.select(*df.columns, "split")


def shuffle_train(df: DataFrame, seed: int = 42) -> DataFrame:
    """Training rows in an order that the seed and the row decide."""
    return df.filter(F.col("split") == "train").orderBy(F.xxhash64(F.lit(seed), "symbol", "bar_ts"))


def dataset_info(samples: DataFrame) -> DataFrame:
    """samples, window_length, features, classes of a table of sliding_windows()."""
    return samples.agg(F.count(F.lit(1)).alias("samples"), F.max(F.size("window")).alias("window_length"), F.max(F.size(F.element_at("window", 1))).alias("features"), F.countDistinct("target").alias("classes"))


def flattened(samples: DataFrame, out: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return samples.withColumn(out, array_to_vector(F.flatten("window")))


def fit_trend_classifier(samples: DataFrame, max_iter: int = 20, reg: float = 0.01):
    """Multinomial logistic regression on flattened windows."""
    from pyspark.ml.classification import LogisticRegression

    data = flattened(samples).select("features", F.col("target").cast("double").alias("label"))
    return LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg).fit(data)


def class_weights(samples: DataFrame) -> DataFrame:
    """label, weight: weights that make every class that occurs count alike and add up to the number of samples."""
    counts = samples.groupBy(F.col("target").cast("double").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("classes")))).select("label", (F.col("all") / (F.col("classes") * F.col("n"))).alias("weight"))


def fit_tree_classifier(samples: DataFrame, trees: int = 40, depth: int = 6, balanced: bool = True, seed: int = 42):
    """Random forest on flattened windows; balanced, each class counts alike however rare it is. Rows without target are left out."""
    from pyspark.ml.classification import RandomForestClassifier

    data = flattened(samples.filter(F.col("target").isNotNull())).select("features", F.col("target").cast("double").alias("label"))
    weights = class_weights(samples.filter(F.col("target").isNotNull())) if balanced else None
    data = data.withColumn("weight", F.lit(1.0)) if weights is None else data.join(F.broadcast(weights), "label")  # a row for each class
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, weightCol="weight", seed=seed).fit(data)


def feature_importances(spark, model, features: Sequence[str], length: int) -> DataFrame:
    """feature, lag (0 is the window's last row), importance: of a tree model's inputs, adding up to 1."""
    values = model.featureImportances.toArray()
    if len(values) != length * len(features):
        raise ValueError(f"the model has {len(values)} inputs, not {length} x {len(features)}")
    rows = [(features[k % len(features)], length - 1 - k // len(features), float(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "feature string, lag int, importance double")


def score_windows(samples: DataFrame, model) -> DataFrame:
    """Adds probs: the fitted model's probabilities by class."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(flattened(samples)).withColumn("probs", vector_to_array("probability"))
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def score_with(samples: DataFrame, predict: Callable, classes: int = 5) -> DataFrame:
    """Adds probs by any model: predict takes an array (n, length, features) and gives (n, classes). Batched by Arrow."""
    schema = T.StructType([*samples.schema.fields, T.StructField("probs", T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator) -> Iterator:
        import numpy as np

        for f in frames:
            if not len(f):
                continue
            x = np.array([np.stack(list(w)) for w in f["window"]], float)
            p = np.asarray(predict(x), float).reshape(len(f), classes)
            yield f.assign(probs=list(p), window=[[list(r) for r in w] for w in f["window"]])

    return samples.mapInPandas(run, schema)


def gate_signal(scored: DataFrame, threshold: float = 0.6, neutral: int = 2) -> DataFrame:
    """Adds signal and confidence from probs: the likeliest class, or neutral if its probability is below the threshold.
    Rows without probs are neutral with confidence 0."""
    p = F.col("probs")
    return scored.withColumns({"confidence": F.coalesce(confidence(p), F.lit(0.0)), "signal": F.coalesce(F.when(confidence(p) < threshold, neutral).otherwise(argmax(p)), F.lit(neutral)).cast("int")})


def signals_for_bars(bars: DataFrame, scored: DataFrame, threshold: float = 0.6) -> DataFrame:
    """symbol, bar_ts, signal, confidence for every bar; bars without a full window are neutral."""
    return gate_signal(bars.select("symbol", "bar_ts").join(scored.select("symbol", "bar_ts", "probs"), ["symbol", "bar_ts"], "left"), threshold).drop("probs")


def signals_to_bars(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """Bars at the signals' times with their signals; a signal without a bar is an error."""
    if missing := signals.join(bars, ["symbol", "bar_ts"], "left_anti").limit(1).count():
        raise ValueError(f"{missing} or more signals have no bar")
    return bars.join(signals, ["symbol", "bar_ts"])


def cross_entropy(df: DataFrame, probs: Column, truth: Column, smoothing: float = 0.1) -> DataFrame:
    """Mean over rows of (1 - s) * -ln p(truth) + s / K * sum of -ln p."""
    logs = F.transform(probs, lambda p: -F.ln(F.greatest(p, F.lit(1e-300))))
    every = F.aggregate(logs, F.lit(0.0), lambda a, x: a + x)
    return df.agg(F.avg((1 - smoothing) * F.element_at(logs, truth.cast("int") + 1) + smoothing / F.size(logs) * every).alias("cross_entropy"))

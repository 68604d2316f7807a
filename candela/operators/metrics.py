"""Classification metrics (O-80 .. O-91). Inputs have y (truth) and p (prediction), or y and probs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.sources.scratch import materialized

CLASSES = (0, 1, 2, 3, 4)


def _or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"))


def confusion_matrix(df: DataFrame, classes: Sequence[int] | None = None) -> DataFrame:
    """y, p, n for all pairs of classes; without a list of classes for the sorted union of those seen."""
    counts = df.groupBy(F.col("y").cast("int").alias("y"), F.col("p").cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    if classes is None:
        seen = counts.select(F.col("y").alias("c")).union(counts.select("p")).distinct()
    else:
        seen = df.sparkSession.createDataFrame([(int(c),) for c in classes], "c int")
    grid = F.broadcast(seen.select(F.col("c").alias("y"))).crossJoin(F.broadcast(seen.select(F.col("c").alias("p"))))  # classes squared
    return grid.join(counts, ["y", "p"], "left").select("y", "p", F.coalesce("n", F.lit(0)).alias("n"))


def normalize_confusion(matrix: DataFrame) -> DataFrame:
    """Adds share of the true class; 0 where it is empty."""
    return matrix.withColumn("share", _or_zero(F.col("n"), F.sum("n").over(Window.partitionBy("y"))))


def per_class(matrix: DataFrame) -> DataFrame:
    """class, precision, recall, f1, support from a confusion matrix; 0 where undefined."""
    rows = matrix.groupBy(F.col("y").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("right"))
    cols = matrix.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("predicted"))
    both = rows.join(cols, "class")
    both = both.withColumns({"precision": _or_zero(F.col("right"), F.col("predicted")), "recall": _or_zero(F.col("right"), F.col("support"))})
    f1 = _or_zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return both.select("class", "precision", "recall", f1.alias("f1"), "support")


def _average(classes: DataFrame, how: str) -> DataFrame:
    m = ["precision", "recall", "f1"]
    if how == "macro":
        return classes.agg(*[F.avg(c).alias(c) for c in m], F.sum("support").alias("support"))
    return classes.agg(*[_or_zero(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in m], F.sum("support").alias("support"))


def macro_scores(matrix: DataFrame) -> DataFrame:
    return _average(per_class(matrix), "macro")


def weighted_scores(matrix: DataFrame) -> DataFrame:
    return _average(per_class(matrix), "weighted")


def classification_report(df: DataFrame, classes: Sequence[int] = CLASSES) -> DataFrame:
    """name, precision, recall, f1, support: a row for each class, then accuracy, macro and weighted averages. The data are counted
    once, into a matrix of the classes; rows of classes that are not named count for accuracy alone."""
    seen = df.groupBy(F.col("y").cast("int").alias("y"), F.col("p").cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    m = ["precision", "recall", "f1"]
    cells = seen.agg(F.collect_list(F.struct("y", "p", "n")).alias("cells"), F.sum(F.when(F.col("y").isNotNull() & F.col("p").isNotNull(), F.col("n"))).alias("total"))  # a row for each pair of classes seen
    count = lambda test: F.aggregate(F.filter("cells", test), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    named = F.array(*[F.lit(int(c)) for c in classes])
    inside = lambda x: F.array_contains(named, x["y"]) & F.array_contains(named, x["p"])

    def one(c: Column) -> Column:
        right = count(lambda x: (x["y"] == c) & (x["p"] == c))
        support, predicted = count(lambda x: (x["y"] == c) & inside(x)), count(lambda x: (x["p"] == c) & inside(x))
        return F.struct(c.cast("string").alias("name"), _or_zero(right, predicted).alias("precision"), _or_zero(right, support).alias("recall"), _or_zero(2 * right, predicted + support).alias("f1"), support.alias("support"))

    by = cells.withColumn("each", F.array(*[one(F.lit(int(c))) for c in classes]))
    every = lambda f: F.aggregate("each", F.lit(0.0), lambda a, x: a + f(x))
    support = F.aggregate("each", F.lit(0).cast("long"), lambda a, x: a + x["support"])
    row = lambda name, values: F.struct(F.lit(name).alias("name"), *[v.alias(c) for c, v in zip(m, values, strict=True)], support.alias("support"))
    right = _or_zero(count(lambda x: x["y"] == x["p"]), F.col("total"))
    means = [
        row("accuracy", [right] * 3), row("macro avg", [every(lambda x, c=c: x[c]) / len(classes) for c in m]),
        row("weighted avg", [_or_zero(every(lambda x, c=c: x[c] * x["support"]), support) for c in m]),
    ]
    return by.select(F.inline(F.concat("each", F.array(*means))))


def per_class_accuracy(matrix: DataFrame) -> DataFrame:
    """class, accuracy: the share predicted right of each true class, 0 if it is empty."""
    return per_class(matrix).select("class", F.col("recall").alias("accuracy"))


# -- ranking metrics: distinct scores are counted first, so what is ordered is at most one row a score. These rows are dealt out by range of
# class and score, as many ranges as RANGE_ROWS asks for; windows run inside (class, range), and one summary row of each range is scanned.

RANGE_ROWS = 1 << 18


def ranged(rows: DataFrame, keys: Sequence[str], score: str, each: int | None = None) -> DataFrame:
    """rows, a written table with one row a key and score, written again in ranges of about `each` rows, from the highest scores of a key on; _b is the range."""
    parts = max(1, math.ceil(rows.count() / (each or RANGE_ROWS)))
    return materialized(rows.repartitionByRange(parts, *keys, F.col(score).desc()).withColumn("_b", F.spark_partition_id()), "ranges")


def carried(parts: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """parts, a row for each key and range, with what the ranges of the key before it hold of each column: the sum or the maximum, as columns says."""
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumns({f"_before_{c}": F.coalesce({"sum": F.sum, "max": F.max}[k](c).over(before), F.lit(0)) for c, k in columns.items()})


def _score_counts(df: DataFrame, classes: Sequence[int]) -> DataFrame:
    """class, score, pos, neg for one-vs-rest."""
    each = df.select(F.col("y").cast("int").alias("y"), F.posexplode("probs").alias("class", "score")).filter(F.col("class").isin([int(c) for c in classes]))
    return each.groupBy("class", "score").agg(F.sum((F.col("y") == F.col("class")).cast("long")).alias("pos"), F.sum((F.col("y") != F.col("class")).cast("long")).alias("neg"))


def roc_curve(df: DataFrame, classes: Sequence[int] = CLASSES, drop_collinear: bool = False) -> DataFrame:
    """class, threshold, fpr, tpr at every distinct score, from (0, 0) with threshold infinity. After that point a rate of no rows is NaN: tpr of a
    class that is absent, fpr of one that all rows have."""
    return _curve(_score_counts(df, classes), ["class"], drop_collinear)


def _curve(counts: DataFrame, keys: list[str], drop_collinear: bool = False) -> DataFrame:
    counts = materialized(counts, "scores")
    start = counts.select(*keys).distinct().select(*keys, F.lit(float("inf")).alias("score"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    points = ranged(materialized(counts.select(*keys, "score", "pos", "neg").unionByName(start), "scores"), keys, "score")
    parts = points.groupBy(*keys, "_b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max_by("pos", "score").alias("_p1"), F.max_by("neg", "score").alias("_n1"))
    before = carried(parts, keys, {"pos": "sum", "neg": "sum"}).drop("pos", "neg", "_p1", "_n1")
    whole = counts.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    out = points.join(before, [*keys, "_b"]).join(F.broadcast(whole), keys)  # one row for each class
    down = Window.partitionBy(*keys, "_b").orderBy(F.col("score").desc())
    so_far = down.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({"tp": F.sum("pos").over(so_far) + F.col("_before_pos"), "fp": F.sum("neg").over(so_far) + F.col("_before_neg")})
    if drop_collinear:
        # What comes next: a row of the range, or the first one of the range after it; before the first row of all comes none.
        by = Window.partitionBy(*keys).orderBy("_b")
        out = out.join(parts.select(*keys, "_b", F.lead("_p1").over(by).alias("_np"), F.lead("_n1").over(by).alias("_nn")), [*keys, "_b"])
        up, right = F.coalesce(F.lead("pos").over(down), F.col("_np")), F.coalesce(F.lead("neg").over(down), F.col("_nn"))
        out = out.withColumn("_keep", F.coalesce((up * F.col("neg")) != (F.col("pos") * right), F.lit(True)) | (F.col("score") == float("inf"))).filter("_keep")
    rate = lambda x, n: F.when(F.col("tp") + F.col("fp") == 0, 0.0).when(F.col(n) == 0, float("nan")).otherwise(F.try_divide(F.col(x), F.col(n).cast("double")))
    return out.select(*keys, F.col("score").alias("threshold"), rate("fp", "_n").alias("fpr"), rate("tp", "_p").alias("tpr"))


def trapezoid_auc(curve: DataFrame, keys: Sequence[str] = ("class",)) -> DataFrame:
    """auc of every curve by the trapezoid rule: null where tpr is undefined, NaN where fpr is. Rates do not fall with the threshold, so those before a
    range are its ranges' highest."""
    keys = list(keys)
    rows = ranged(materialized(curve, "curve"), keys, "threshold")
    parts = rows.groupBy(*keys, "_b").agg(F.max("fpr").alias("fpr"), F.max("tpr").alias("tpr"))
    rows = rows.join(carried(parts, keys, {"fpr": "max", "tpr": "max"}).drop("fpr", "tpr"), [*keys, "_b"])
    w = Window.partitionBy(*keys, "_b").orderBy(F.col("threshold").desc())
    was = lambda c: F.lag(c, 1).over(w)
    fpr, tpr = F.coalesce(was("fpr"), F.col("_before_fpr")), F.coalesce(was("tpr"), F.col("_before_tpr"))
    return rows.withColumn("_a", (F.col("fpr") - fpr) * (F.col("tpr") + tpr) / 2).groupBy(*keys).agg(F.when(~F.max(F.isnan("tpr")), F.sum("_a")).alias("auc"))


def area(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """auc from counts(pos, neg) by score: the area under the curve through all scores, without its points. Null without positives, NaN without negatives."""
    keys = list(keys)
    rows = ranged(materialized(counts, "scores"), keys, "score")
    parts = rows.groupBy(*keys, "_b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    so_far = Window.partitionBy(*keys, "_b").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("_a", F.col("neg") * (F.sum("pos").over(so_far) - F.col("pos") / 2)).groupBy(*keys, "_b").agg(F.sum("_a").alias("_a"))
    each = inside.join(carried(parts, keys, {"pos": "sum"}), [*keys, "_b"])
    auc = F.try_divide(F.sum(F.col("_a") + F.col("neg") * F.col("_before_pos")), F.sum("pos").cast("double") * F.sum("neg"))
    return each.groupBy(*keys).agg(F.when((F.sum("pos") > 0) & (F.sum("neg") == 0), float("nan")).otherwise(auc).alias("auc"))


def _mean_area(aucs: DataFrame, n: int, name: str, absent: str) -> DataFrame:
    """The mean of n areas. If one is undefined: 0 with absent="zero"; with absent="skip" the mean of those that are not null, as SQL has it."""
    mean = F.avg("auc")
    if absent == "zero":
        mean = F.when(F.count(F.when(~F.isnan("auc"), F.col("auc"))) < n, 0.0).otherwise(mean)
    return aucs.agg(mean.alias(name))


def roc_auc_ovr(df: DataFrame, classes: Sequence[int] = CLASSES, absent: str = "zero") -> DataFrame:
    """roc_auc_ovr: mean of the one-vs-rest areas; if a class is absent 0, or with absent="skip" the mean of the others', NaN if there is but one class."""
    return _mean_area(area(_score_counts(df, classes), ["class"]), len(classes), "roc_auc_ovr", absent)


def roc_auc_ovo(df: DataFrame, classes: Sequence[int] = CLASSES, absent: str = "zero") -> DataFrame:
    """roc_auc_ovo: mean over pairs of classes of their two areas; if a class is absent 0, or with absent="skip" NaN, as is the area of a pair
    without rows of its second class."""
    pairs = F.array(*[F.struct(F.lit(int(a)).alias("a"), F.lit(int(b)).alias("b")) for a in classes for b in classes if a != b])
    each = df.select(F.col("y").cast("int").alias("y"), "probs").select("y", "probs", F.inline(pairs)).filter((F.col("y") == F.col("a")) | (F.col("y") == F.col("b")))
    scored = each.select("a", "b", F.element_at("probs", F.col("a") + 1).alias("score"), (F.col("y") == F.col("a")).cast("long").alias("is_a"))
    counts = scored.groupBy("a", "b", "score").agg(F.sum("is_a").alias("pos"), F.sum(1 - F.col("is_a")).alias("neg"))
    return _mean_area(area(counts, ["a", "b"]), len(classes) * (len(classes) - 1), "roc_auc_ovo", absent)

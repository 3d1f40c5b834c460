"""Model quality from counts: every metric is one aggregation over the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeforge.operators.ranking import ranges, running_total


def confusion_matrix(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def _by_class(rows: DataFrame) -> DataFrame:
    """Per class: hits, rows labelled so (support), rows predicted so. A few rows."""
    counts = confusion_matrix(rows)
    sides = counts.select(F.explode(F.array("label", "prediction")).alias("class")).distinct()
    hit = F.col("label") == F.col("prediction")
    actual = counts.groupBy(F.col("label").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("hits")
    )
    called = counts.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("called"))
    return (
        sides.join(actual, "class", "left").join(called, "class", "left").fillna(0, ["support", "hits", "called"])
    )


def balanced_accuracy(rows: DataFrame) -> DataFrame:
    """Mean recall over the classes that occur as labels."""
    recall = F.col("hits") / F.col("support")
    return _by_class(rows).filter(F.col("support") > 0).agg(F.avg(recall).alias("balanced_accuracy"))


def classification_report(rows: DataFrame) -> DataFrame:
    """Precision, recall, f1 and support per class, with macro and weighted means."""
    zero = F.lit(0.0)
    per_class = (
        _by_class(rows)
        .withColumns(
            {
                "precision": F.coalesce(F.try_divide(F.col("hits"), F.col("called")), zero),
                "recall": F.coalesce(F.try_divide(F.col("hits"), F.col("support")), zero),
            }
        )
        .withColumn(
            "f1",
            F.coalesce(
                F.try_divide(
                    2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
                ),
                zero,
            ),
        )
    )
    named = per_class.select(F.col("class").cast("string").alias("name"), "precision", "recall", "f1", "support")
    scores = ("precision", "recall", "f1")
    macro = named.agg(
        F.lit("macro avg").alias("name"), *[F.avg(c).alias(c) for c in scores], F.sum("support").alias("support")
    )
    weighted = named.agg(
        F.lit("weighted avg").alias("name"),
        *[F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in scores],
        F.sum("support").alias("support"),
    )
    return named.unionByName(macro).unionByName(weighted)


def _score_steps(rows: DataFrame) -> DataFrame:
    """Positives and negatives at each score, and how many of each score higher.

    Equal scores are merged first; a heap of copies of one score is a single row here. Slices are ranges of the scores that occur, about
    equal in rows wherever the scores lie; only one slice at a time is ordered in a task.
    """
    steps = rows.groupBy("score").agg(
        F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")
    )
    order = [F.desc("score")]
    return running_total(ranges(steps, order, "score-steps"), [], F.col("range"), order, ["pos", "neg"]).drop("range")


def roc_curve(rows: DataFrame) -> DataFrame:
    totals = rows.agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    pos, neg = totals.select("pos").scalar(), totals.select("neg").scalar()
    return _score_steps(rows).select(
        F.col("score").alias("threshold"),
        ((F.col("neg_before") + F.col("neg")) / neg).alias("fpr"),
        ((F.col("pos_before") + F.col("pos")) / pos).alias("tpr"),
    )


def roc_auc(rows: DataFrame) -> DataFrame:
    """Area under the curve by trapezoids, summed step by step."""
    area = F.sum(F.col("neg") * (F.col("pos_before") + F.col("pos") / 2))
    whole = F.sum("pos") * F.sum("neg")
    return _score_steps(rows).agg(F.try_divide(area, whole.cast("double")).alias("auc"))


def rmse(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    gap = F.col(actual) - F.col(predicted)
    return rows.agg(F.sqrt(F.avg(gap * gap)).alias("rmse"))


"""Segmentation metrics and training histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("label", "pred").agg(F.count("*").alias("n"))


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg((F.col("pred") == F.col("label")).cast("int")).alias("accuracy"))


def _iou(k: int):
    both = F.count_if((F.col("pred") == k) & (F.col("label") == k))
    either = F.count_if((F.col("pred") == k) | (F.col("label") == k))
    return F.try_divide(both, either)


def _mean_iou(classes: int):
    """Mean over the classes that occur; 0 if none does."""
    found = F.array_compact(F.array(*[_iou(k) for k in range(classes)]))
    total = F.aggregate(found, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.try_divide(total, F.size(found)), F.lit(0.0))


def mean_iou(pairs: DataFrame, keys: list[str] | None = None, classes: int = 2) -> DataFrame:
    return pairs.groupBy(*(keys or [])).agg(_mean_iou(classes).alias("mean_iou"))


def epoch_metrics(points: DataFrame) -> DataFrame:
    """(epoch, loss, iou, accuracy) of points (epoch, batch, pred, label, loss).

    Loss and IoU are means over batches, accuracy is over points; a batch with
    a NaN loss counts nowhere.
    """
    batches = points.groupBy("epoch", "batch").agg(
        F.avg("loss").alias("loss"), _mean_iou(2).alias("iou"), F.count_if(F.col("pred") == F.col("label")).alias("right"), F.count("*").alias("n")
    )
    return (
        batches.where(~F.isnan("loss"))
        .groupBy("epoch")
        .agg(F.avg("loss").alias("loss"), F.avg("iou").alias("iou"), (F.sum("right") / F.sum("n")).alias("accuracy"))
    )


def best_epochs(history: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The epochs whose iou is above all earlier ones and above 0.

    A history has one row an epoch, so without ``by`` it is one task's.
    """
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    best = F.coalesce(F.max("iou").over(before), F.lit(0.0))
    return history.withColumn("_best", F.greatest(best, F.lit(0.0))).where(F.col("iou") > F.col("_best")).drop("_best")

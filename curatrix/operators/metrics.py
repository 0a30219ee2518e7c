"""Classification metrics from predictions, and choices from a training history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(predictions: DataFrame, labels: DataFrame, true: str = "true_index", pred: str = "pred_index") -> DataFrame:
    """(true, pred, n) for all pairs of labels (label), 0 where there is none. Labels are a small dimension."""
    cells = predictions.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("c"))
    grid = labels.select(F.col("label").alias("true_label")).crossJoin(labels.select(F.col("label").alias("pred_label")))  # labels squared
    joined = grid.join(cells, (F.col("true_label") == F.col("t")) & (F.col("pred_label") == F.col("p")), "left")
    return joined.select("true_label", "pred_label", F.coalesce("c", F.lit(0)).alias("n"))


def per_class(predictions: DataFrame, labels: DataFrame, true: str = "true_index", pred: str = "pred_index") -> DataFrame:
    """Precision, recall, F1 and support of each label; 0 where a ratio has no denominator. One aggregation over both roles of a label."""
    hit = (F.col(true) == F.col(pred)).cast("long")
    roles = F.explode(F.array(F.struct(F.col(true).alias("label"), F.lit(1).cast("long").alias("s"), F.lit(0).cast("long").alias("d"), hit.alias("h")), F.struct(F.col(pred).alias("label"), F.lit(0).cast("long").alias("s"), F.lit(1).cast("long").alias("d"), F.lit(0).cast("long").alias("h"))))
    sums = predictions.select(roles.alias("r")).groupBy(F.col("r.label").alias("l")).agg(F.sum("r.s").alias("support"), F.sum("r.d").alias("predicted"), F.sum("r.h").alias("hits"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = labels.select("label").join(sums, F.col("label") == F.col("l"), "left").select("label", *[zero(F.col(c)).alias(c) for c in ("support", "predicted", "hits")])
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumn("precision", share(F.col("hits"), F.col("predicted"))).withColumn("recall", share(F.col("hits"), F.col("support")))
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summary(classes: DataFrame) -> DataFrame:
    """One row of a per-class table: accuracy, macro precision, recall and F1, and F1 weighted by support."""
    return classes.agg(
        F.coalesce(F.try_divide(F.sum("hits"), F.sum("support")), F.lit(0.0)).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)).alias("weighted_f1"),
    )


def weighted_mean(df: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def best_epoch(history: DataFrame, metric: str = "val_macro_f1", epoch: str = "epoch", *keys: str) -> DataFrame:
    """The row with the highest metric, the earliest of equals, by the keys."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(metric), epoch)
    return history.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cosine_rate(epoch, base: float, epochs: int, floor: float = 0.0):
    """The learning rate after an epoch under cosine annealing."""
    return F.lit(floor) + (base - floor) * (1 + F.cos(F.lit(3.141592653589793) * epoch / epochs)) / 2

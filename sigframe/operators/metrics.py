"""Metrics over prediction tables ``(dataset, classifier, fold, id, y, yhat)``:
A-8 accuracy and micro precision / recall / F1 (equal for single-label
multiclass — kept as separate columns), A-7 mean over folds, A-9 confusion
counts, A-10 log loss, A-11 per-class metrics, P-16 long metric
table, M-14 classifier ranking per metric.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP = ["dataset", "classifier"]
METRICS = ["accuracy", "precision", "recall", "f1"]


def fold_metrics(pred: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """A-8 per fold: micro metrics from TP / FP / FN, each summed over classes.

    A prediction counts for its predicted class (TP or FP) and for its true
    class (TP or FN); a null prediction is no FP, but an FN of its class."""
    hit = F.coalesce(F.col("y") == F.col("yhat"), F.lit(False)).cast("long")
    sides = F.array(F.struct(F.col("y").cast("double").alias("c"), hit.alias("tp"), (1 - hit).alias("fn"),
                             F.lit(0).cast("long").alias("fp"), F.lit(1).cast("long").alias("n")),
                    F.struct(F.col("yhat").cast("double").alias("c"), F.lit(0).cast("long").alias("tp"),
                             F.lit(0).cast("long").alias("fn"), (1 - hit).alias("fp"), F.lit(0).cast("long").alias("n")))
    classes = pred.select(*group, "fold", F.inline(sides)).groupBy(*group, "fold", "c").agg(
        *[F.sum(x).alias(x) for x in ("tp", "fn", "fp", "n")])
    named = lambda x: F.sum(F.when(F.col("c").isNotNull(), F.col(x)).otherwise(0)).alias(x)
    g = classes.groupBy(*group, "fold").agg(named("tp"), named("fn"), named("fp"), F.sum("n").alias("n"))
    tp = F.col("tp")
    prec = F.when(tp + F.col("fp") > 0, tp / (tp + F.col("fp"))).otherwise(F.lit(0.0))
    rec = F.when(tp + F.col("fn") > 0, tp / (tp + F.col("fn"))).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return g.select(*group, "fold", (tp / F.col("n")).alias("accuracy"), prec.alias("precision"), rec.alias("recall"),
                    f1.alias("f1"))


def cv_scores(pred: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """A-7: mean of each metric over folds."""
    return fold_metrics(pred, group).groupBy(*group).agg(*[F.avg(m).alias(m) for m in METRICS])


def confusion(pred: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """A-9: non-zero confusion cells ``(y, yhat, n)``."""
    return pred.groupBy(*group, "y", "yhat").agg(F.count(F.lit(1)).alias("n"))


def log_loss(pred: DataFrame, group: Sequence[str] = GROUP, eps: float = 1e-15) -> DataFrame:
    """A-10: mean of -ln(max(p_true, eps)) (needs a ``p_true`` column)."""
    return pred.groupBy(*group).agg(F.avg(-F.log(F.greatest(F.col("p_true"), F.lit(eps)))).alias("log_loss"))


def class_metrics(pred: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """A-11: per-class precision / recall / F1 from the confusion cells."""
    cells = confusion(pred, group)
    tp = cells.filter(F.col("y") == F.col("yhat")).groupBy(*group, F.col("y").alias("c")).agg(F.sum("n").alias("tp"))
    pp = cells.groupBy(*group, F.col("yhat").alias("c")).agg(F.sum("n").alias("pp"))
    ap = cells.groupBy(*group, F.col("y").alias("c")).agg(F.sum("n").alias("ap"))
    j = ap.join(pp, [*group, "c"], "full").join(tp, [*group, "c"], "left").fillna(0, ["tp", "pp", "ap"])
    prec = F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(F.lit(0.0))
    rec = F.when(F.col("ap") > 0, F.col("tp") / F.col("ap")).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return j.select(*group, "c", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def metric_long(scores: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """P-16: ``(dataset, classifier, metric, value)``."""
    return scores.unpivot(list(group), METRICS, "metric", "value")


def compare(scores: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """M-14: rank of each classifier per (dataset, metric), best = 1."""
    long = metric_long(scores, group)
    w = Window.partitionBy("dataset", "metric").orderBy(F.col("value").desc())
    return long.withColumn("rank", F.rank().over(w))

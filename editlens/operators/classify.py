"""Classifier and agreement metrics from confusion counts.

Every metric is arithmetic over a small grouped table (classes x classes), which
is produced by a partial+final hash aggregate over the predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classification_report(pred: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Per class precision / recall / F1 / support, plus ``macro avg`` and
    ``accuracy`` rows (zero division -> 0), like ``classification_report``."""
    conf = pred.groupBy(F.col(y).alias("t"), F.col(yhat).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    classes = conf.select(F.col("t").alias("cls")).union(conf.select(F.col("p").alias("cls"))).distinct()
    tp = conf.where(F.col("t") == F.col("p")).select(F.col("t").alias("cls"), F.col("c").alias("tp"))
    sup = conf.groupBy(F.col("t").alias("cls")).agg(F.sum("c").alias("support"))
    predc = conf.groupBy(F.col("p").alias("cls")).agg(F.sum("c").alias("predicted"))
    per = (classes.join(tp, "cls", "left").join(sup, "cls", "left").join(predc, "cls", "left")
           .fillna(0, ["tp", "support", "predicted"]))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.select(F.col("cls").cast("string").alias("cls"), prec.alias("precision"), rec.alias("recall"),
                     "support", "tp")
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                         .otherwise(0.0))
    macro = per.agg(F.lit("macro avg").alias("cls"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.sum("support").alias("support"), F.avg("f1").alias("f1"))
    acc = per.agg(F.lit("accuracy").alias("cls"), (F.sum("tp") / F.sum("support")).alias("precision"),
                  (F.sum("tp") / F.sum("support")).alias("recall"), F.sum("support").alias("support"),
                  (F.sum("tp") / F.sum("support")).alias("f1"))
    cols = ["cls", "precision", "recall", "f1", F.col("support").cast("long").alias("support")]
    return per.select(*cols).unionByName(macro.select(*cols)).unionByName(acc.select(*cols))


def cohen_kappa_matrix(wide: DataFrame, item: str, raters: list[str]) -> DataFrame:
    """A14 + J10: unweighted Cohen's kappa for every ordered rater pair (incl. self).

    Ratings are unpivoted, the per-item pairs come from a self join on the item id
    (each item contributes ``len(raters)**2`` pairs), then
    ``kappa = (po - pe) / (1 - pe)``; null when ``pe = 1``.
    """
    long = wide.unpivot([item], raters, "rater", "v")
    a = long.select(item, F.col("rater").alias("r1"), F.col("v").alias("v1"))
    b = long.select(item, F.col("rater").alias("r2"), F.col("v").alias("v2"))
    pairs = a.join(b, item).groupBy("r1", "r2", "v1", "v2").agg(F.count(F.lit(1)).alias("c"))
    tot = pairs.groupBy("r1", "r2").agg(F.sum("c").alias("n"),
                                        F.sum(F.when(F.col("v1") == F.col("v2"), F.col("c"))).alias("agree"))
    m1 = pairs.groupBy("r1", "r2", F.col("v1").alias("v")).agg(F.sum("c").alias("c1"))
    m2 = pairs.groupBy("r1", "r2", F.col("v2").alias("v")).agg(F.sum("c").alias("c2"))
    pe = (m1.join(m2, ["r1", "r2", "v"]).groupBy("r1", "r2")
          .agg(F.sum(F.col("c1") * F.col("c2")).alias("pe_num")))
    j = tot.join(pe, ["r1", "r2"], "left").fillna(0, ["pe_num", "agree"])
    po = F.col("agree") / F.col("n")
    pe_ = F.col("pe_num") / (F.col("n") * F.col("n"))
    return j.select("r1", "r2", F.when(pe_ < 1, (po - pe_) / (1 - pe_)).alias("kappa"))


def cluster_majority(df: DataFrame, cluster: str, label: str, out: str = "mapped_label") -> DataFrame:
    """Majority label per cluster (ties -> smallest label), joined back."""
    counts = df.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("__c"))
    best = counts.groupBy(cluster).agg(
        F.max_by(F.col(label), F.struct(F.col("__c"), -F.col(label))).alias(out))
    return df.join(F.broadcast(best), cluster, "left")      # one row per cluster


def leaderboard(scores: DataFrame, params: str, fold: str, score: str) -> DataFrame:
    """Mean / population std of the CV score per parameter set, rank (min)."""
    agg = scores.groupBy(params).agg(F.avg(score).alias("mean_test_score"),
                                     F.stddev_pop(score).alias("std_test_score"),
                                     F.count(fold).alias("n_splits"))
    # the leaderboard holds one row per parameter set (a small grid)
    w = Window.orderBy(F.col("mean_test_score").desc())
    return agg.withColumn("rank_test_score", F.rank().over(w))

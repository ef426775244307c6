"""Rank statistics without pairs or global windows.

T1 is a distinct-value table: per (partition, value) the count of each group and,
through ``prefix_before`` (range-split windows), the number of rows with a
smaller value. Mann-Whitney U, Cliff's delta and one-vs-rest AUC are sums over
that table, so no O(n*m) pair is formed and no group is pulled into one task.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import materialize, prefix_before


def value_table(long_df: DataFrame, part_cols: list[str], value: str, group: str,
                groups: tuple = (0, 1), n_buckets: int | None = None) -> DataFrame:
    """(part, value, n0, n1, cnt, lt, lt0, lt1) with ``lt*`` = rows of smaller value."""
    g0, g1 = groups
    t = (long_df.where(F.col(group).isin(g0, g1))
         .groupBy(*part_cols, value)
         .agg(F.count_if(F.col(group) == g0).alias("n0"), F.count_if(F.col(group) == g1).alias("n1")))
    t = materialize(t.withColumn("cnt", F.col("n0") + F.col("n1")))         # boundaries, windows and totals read it
    return prefix_before(t, [(value, True)], ["cnt", "n0", "n1"], part_cols, n_buckets, out=["lt", "lt0", "lt1"])


def mann_whitney_cliffs(table: DataFrame, part_cols: list[str]) -> DataFrame:
    """A15 + A16 per partition from T1: U of group 0, z of the two-sided tie-corrected
    normal approximation with continuity correction, Cliff's delta and magnitude."""
    avg_rank = F.col("lt") + (F.col("cnt") + 1) / 2.0
    agg = table.groupBy(*part_cols).agg(
        F.sum(F.col("n0") * avg_rank).alias("r0"),
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"),
        F.sum(F.col("cnt").cast("double") ** 3 - F.col("cnt")).alias("ties"),
        F.sum(F.col("n0") * F.col("lt1")).alias("gt"),                     # x > y pairs
        F.sum(F.col("n0") * (F.col("n1") + F.col("lt1"))).alias("ge"))     # x >= y pairs
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    n = n0 + n1
    u1 = F.col("r0") - n0 * (n0 + 1) / 2
    u = F.greatest(u1, n0 * n1 - u1)
    sd = F.sqrt(n0 * n1 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (u - n0 * n1 / 2 - 0.5) / sd
    lt = n0 * n1 - F.col("ge")                                              # x < y pairs
    delta = (F.col("gt") - lt) / (n0 * n1)
    ad = F.abs(delta)
    # Cliff's delta magnitude thresholds.
    mag = (F.when(ad < 0.147, "negligible").when(ad < 0.33, "small")
           .when(ad < 0.474, "medium").otherwise("large"))
    return agg.select(*part_cols, u1.alias("u_stat"), z.alias("z"), delta.alias("cliffs_delta"),
                      mag.alias("magnitude"))


def erfc(x: F.Column, terms: int = 80) -> F.Column:
    """Complementary error function of ``x >= 0`` in built-in expressions: the Taylor series of erf below 2 and the
    continued fraction of erfc, cut after ``terms`` steps, from there; about 13 digits where the result is not tiny beside 1."""
    steps = F.sequence(F.lit(terms), F.lit(1), F.lit(-1))
    # erf = 2x / sqrt(pi) * (1/1 - x^2 (1/3 / 1! - x^2 (1/5 / 2! - ...))), as nested ratios of neighbouring terms
    ratio = lambda s, k: 1.0 - x * x * (2 * k - 1) / (k * (2 * k + 1)) * s
    near = 1 - 2 * x / math.sqrt(math.pi) * F.aggregate(steps, F.lit(1.0), lambda s, k: ratio(s, k.cast("double")))
    tail = F.aggregate(steps, F.lit(0.0), lambda t, k: k / 2 / (x + t))
    far = F.exp(-x * x) / (math.sqrt(math.pi) * (x + tail))
    return F.when(x < 2, near).otherwise(far)


def two_sided_p(z_df: DataFrame, z: str = "z", out: str = "p_value") -> DataFrame:
    """p = 2 * sf(z) = erfc(z / sqrt 2), clipped to [0, 1]; null where z is null or not a number."""
    v = F.col(z) / math.sqrt(2)
    p = F.when(v < 0, 2 - erfc(-v)).otherwise(erfc(v))
    return z_df.withColumn(out, F.when(F.col(z).isNotNull() & ~F.isnan(z), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))))


def ovr_auc(pred_long: DataFrame, part_col: str, score: str, positive: str,
            n_buckets: int | None = None) -> DataFrame:
    """One-vs-rest ROC-AUC per class with average ranks over tied scores:
    AUC = (sum over positives of #neg below + half #neg tied) / (n_pos * n_neg)."""
    t = value_table(pred_long.withColumn("__g", F.col(positive).cast("int")),
                    [part_col], score, "__g", (0, 1), n_buckets)
    agg = t.groupBy(part_col).agg(
        F.sum(F.col("n1") * (F.col("lt0") + F.col("n0") / 2.0)).alias("num"),
        F.sum("n1").alias("npos"), F.sum("n0").alias("nneg"))
    return agg.select(part_col, (F.col("num") / (F.col("npos") * F.col("nneg"))).alias("auc"))


def exact_quantiles(long_df: DataFrame, part_cols: list[str], value: str, probs: list[float],
                    n_buckets: int | None = None) -> DataFrame:
    """Numpy-linear quantiles per partition from the distinct-value table (A17, W12):
    position h = (n-1)q is located by prefix counts, never by sorting a group in one task."""
    t = long_df.groupBy(*part_cols, value).agg(F.count(F.lit(1)).alias("cnt"))
    t = prefix_before(t, [(value, True)], "cnt", part_cols, n_buckets, out="lt")
    n = t.groupBy(*part_cols).agg(F.sum("cnt").alias("__n"))
    t = t.join(F.broadcast(n), part_cols) if part_cols else t.crossJoin(F.broadcast(n))
    aggs = []
    for i, q in enumerate(probs):
        h = (F.col("__n") - 1) * F.lit(q)
        lo, hi = F.floor(h), F.least(F.floor(h) + 1, F.col("__n") - 1)
        at = lambda pos: (F.col("lt") <= pos) & (pos < F.col("lt") + F.col("cnt"))
        aggs += [F.max(F.when(at(lo), F.col(value))).alias(f"__lo{i}"),
                 F.max(F.when(at(hi), F.col(value))).alias(f"__hi{i}"),
                 F.first(h - F.floor(h)).alias(f"__fr{i}")]
    a = t.groupBy(*part_cols).agg(*aggs)
    return a.select(*part_cols, *[(F.col(f"__lo{i}") + F.col(f"__fr{i}") * (F.col(f"__hi{i}") - F.col(f"__lo{i}")))
                                  .cast("double").alias(f"q{i}") for i in range(len(probs))])


def box_summary(long_df: DataFrame, part_cols: list[str], value: str,
                n_buckets: int | None = None) -> DataFrame:
    """Quartiles and whiskers (most extreme values within 1.5 IQR) per group."""
    q = exact_quantiles(long_df, part_cols, value, [0.25, 0.5, 0.75], n_buckets) \
        .select(*part_cols, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    j = long_df.join(F.broadcast(q), part_cols)             # one row per group: bounded
    inside = (F.col(value) >= lo_f) & (F.col(value) <= hi_f)
    return j.groupBy(*part_cols, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_lo"),
        F.max(F.when(inside, F.col(value))).alias("whisker_hi"),
        F.count_if(~inside).alias("outliers"), F.count(F.lit(1)).alias("n"))


def mean_std_ci(df: DataFrame, value: str, group_cols: list[str] = ()) -> DataFrame:
    """A9 ``get_gleu_stats``: mean, population std and the 95% normal interval."""
    g = df.groupBy(*group_cols) if group_cols else df.groupBy()
    a = g.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    z = 1.959963984540054
    return a.select(*group_cols, "mean", "std", (F.col("mean") - z * F.col("std")).alias("ci_lo"),
                    (F.col("mean") + z * F.col("std")).alias("ci_hi"))

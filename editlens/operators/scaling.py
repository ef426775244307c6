"""Column scaling (A21 min-max, A22 standard) and feature groups.

Statistics for all columns are computed in one aggregate, which yields a single
row; it is attached with a broadcast cross join, so the data itself is never
pulled to the driver and the statistics stay inside the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Feature groups of the change-complexity model.
SIZE_COLUMNS = ["NMT", "NMS", "NML", "NMC", "NNTRP", "NNSRP", "NTOD", "NSOD"]
STRUCTURE_COLUMNS = ["CC_delta", "delta_dependency"]
CONTENT_COLUMNS = ["sim_cocom", "codeChangeNum", "codeChangeScore", "refactoringTypeNum"]
ALL_COLUMNS = SIZE_COLUMNS + STRUCTURE_COLUMNS + CONTENT_COLUMNS

GROUPS = {"size": SIZE_COLUMNS, "structure": STRUCTURE_COLUMNS,
          "content": CONTENT_COLUMNS, "all": ALL_COLUMNS}


def feature_group(df: DataFrame, group: str, key=("sample_id", "index")) -> DataFrame:
    """Project the key and one named feature group."""
    return df.select(*key, *GROUPS[group])


def minmax_scaled(df: DataFrame, cols: list[str], stats: DataFrame | None = None,
                  prefix: str = "") -> tuple[DataFrame, list[str]]:
    """``(x - min) / (max - min)`` per column, 0 for a constant column.

    Returns the frame with the scaled columns (named ``prefix + col``, replacing
    the raw column when ``prefix`` is empty) and the list of their names.
    """
    if stats is None:
        stats = df.agg(*[F.min(c).alias(f"__mn_{c}") for c in cols],
                       *[F.max(c).alias(f"__mx_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(stats))
    names = []
    for c in cols:
        mn, mx = F.col(f"__mn_{c}"), F.col(f"__mx_{c}")
        scaled = F.when(mx > mn, (F.col(c) - mn) / (mx - mn)).otherwise(F.lit(0.0))
        out = out.withColumn(prefix + c, scaled.cast("double"))
        names.append(prefix + c)
    return out.drop(*[f"__mn_{c}" for c in cols], *[f"__mx_{c}" for c in cols]), names


def scaled_sum(df: DataFrame, cols: list[str], out: str = "score", digits: int = 9) -> DataFrame:
    """W1 score: sum of min-max scaled columns, rounded so ties are engine-stable."""
    scaled, names = minmax_scaled(df, cols, prefix="__s_")
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return scaled.withColumn(out, F.round(total, digits)).drop(*names)


def standard_stats(train: DataFrame, cols: list[str]) -> DataFrame:
    """A22 fit: mean and population std per column (one row)."""
    return train.agg(*[F.avg(c).alias(f"__mu_{c}") for c in cols],
                     *[F.stddev_pop(c).alias(f"__sd_{c}") for c in cols])


def standard_scaled(df: DataFrame, cols: list[str], stats: DataFrame) -> DataFrame:
    """A22 transform: ``(x - mean) / std``; a zero-variance column divides by 1."""
    out = df.crossJoin(F.broadcast(stats))
    for c in cols:
        sd = F.col(f"__sd_{c}")
        out = out.withColumn(c, (F.col(c) - F.col(f"__mu_{c}")) /
                             F.when(sd > 0, sd).otherwise(F.lit(1.0)))
    return out.drop(*[f"__mu_{c}" for c in cols], *[f"__sd_{c}" for c in cols])

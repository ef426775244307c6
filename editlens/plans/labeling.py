"""Complexity labelling by intersecting per-dimension percentiles.

Per feature group (size / structure / content) the score is the sum of the
min-max scaled columns. A pair is *complex* (2) when it is in the top
``ceil(n*p)`` of all three groups, *easy* (0) when in the bottom ``ceil(n*p)`` of
all three (bottom overrides top), else *normal* (1). Each group also gets its own
three-way label at ``dims_percent``.

All labels come from boolean flags computed on the same rows (W3 via
``selection_bounds``); the three-way set intersection (O3) and the label merges
(J7 / J1) are therefore column expressions, not joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import KEY, materialize, selection_bounds, selection_flag, three_way_label
from ..operators.scaling import ALL_COLUMNS, GROUPS, minmax_scaled

DIMS = ("size", "structure", "content")


def dimension_scores(features: DataFrame, digits: int = 9) -> DataFrame:
    """``<dim>_score`` per group; min/max of all 14 columns from one aggregate."""
    scaled, names = minmax_scaled(features, ALL_COLUMNS, prefix="__s_")
    out = scaled
    for dim in DIMS:
        cols = [F.col("__s_" + c) for c in GROUPS[dim]]
        total = cols[0]
        for c in cols[1:]:
            total = total + c
        out = out.withColumn(f"{dim}_score", F.round(total, digits))
    return out.drop(*names)


def complexity_labels(features: DataFrame, percent: float = 0.5, dims_percent: float = 0.2,
                      n_buckets: int | None = None) -> DataFrame:
    """E1 ``intersection_data``: features + label + per-dimension label and score."""
    # the feature table is written to the shared folder, as its statistics and its scores
    # read it, and so is the scored one: the selection scans it several times and the output
    # reads it again; a cut lineage keeps every scan a plain file read instead of
    # re-aggregating the source
    d = materialize(dimension_scores(materialize(features)))
    # narrow (key, dim, score) frame: the three dimensions share one selection pass
    base = d.select(*KEY, *[f"{dim}_score" for dim in DIMS])
    long_df = base.unpivot(KEY, [f"{dim}_score" for dim in DIMS], "dim", "score")
    specs = []
    for dim in DIMS:
        part = f"{dim}_score"
        specs += [(part, f"{dim}_top", percent, True), (part, f"{dim}_bot", percent, False),
                  (part, f"{dim}_dtop", dims_percent, True), (part, f"{dim}_dbot", dims_percent, False)]
    b = selection_bounds(long_df, "dim", "score", specs, KEY, n_buckets)
    flag = {tag: selection_flag(part, b.get(tag), top, KEY) for part, tag, _, top in specs}
    top_all = flag["size_top"] & flag["structure_top"] & flag["content_top"]
    bot_all = flag["size_bot"] & flag["structure_bot"] & flag["content_bot"]
    cols = [*KEY, *ALL_COLUMNS, three_way_label(top_all, bot_all, "label")]
    for dim in DIMS:
        cols += [three_way_label(flag[f"{dim}_dtop"], flag[f"{dim}_dbot"], f"{dim}_label"),
                 F.col(f"{dim}_score")]
    return d.select(*cols)


def labels_table(spark, sf_dir: str, percent: float = 0.5, dims_percent: float = 0.2) -> DataFrame:
    """E1's output for the downstream jobs (E4, E5, E7, A17, M*), from the input as it is now."""
    from ..fixtures import Tables, features
    return complexity_labels(features(Tables(spark, sf_dir).lineitem), percent, dims_percent)

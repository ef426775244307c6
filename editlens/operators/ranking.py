"""Distributed ranking and selection (G-rank, W1-W4, W12, W14, A2).

A window ``rank() OVER (ORDER BY score)`` without ``PARTITION BY`` moves every row
into one task. Everything here avoids that:

* ``prefix_before`` computes, for rows of a frame that is unique on its order
  columns, the weighted number of rows strictly before each row. The frame is
  split into value ranges (buckets from ``approxQuantile``; the driver receives
  only the bucket boundaries, at most ``n_buckets`` numbers), a window runs per
  bucket, and the per-bucket totals (at most ``n_buckets`` rows, a proven bound)
  give the offsets through a broadcast join.
* Ranks are computed on the *distinct* scores with their counts
  (``groupBy(score).count()`` combines map-side), so a score shared by a third of
  all rows is one row there. Joining ranks back to rows sends such hot scores
  through a broadcast of the hot subset (at most ``HOT_SPLIT`` rows by
  construction) and the rest through a shuffle join.
* Top / bottom ``m`` selection needs only the boundary score and, inside the tie
  group at that score, the boundary key: one small row per selection, which is
  all that reaches the driver; the flags are then plain filters on the rows.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import scratch_path

KEY = ["sample_id", "index"]
HOT_SPLIT = 2000          # scores holding more than N / HOT_SPLIT rows are "hot"


def _n_buckets(df: DataFrame, n_buckets: int | None) -> int:
    if n_buckets:
        return n_buckets
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_range_bucket(df: DataFrame, col: str, n_buckets: int | None = None,
                      descending: bool = False, out: str = "__bkt") -> DataFrame:
    """Attach a value-range bucket id (monotone in ``col``) for range-split windows."""
    nb = _n_buckets(df, n_buckets)
    tmp = "__bkt_v"
    d = df.withColumn(tmp, (-F.col(col) if descending else F.col(col)).cast("double"))
    splits: list[float] = []
    if nb > 1:
        qs = d.approxQuantile(tmp, [i / nb for i in range(1, nb)], 1.0 / (4 * nb))
        splits = sorted({q for q in qs if q is not None and not math.isnan(q)})
    if not splits:
        return d.withColumn(out, F.lit(0)).drop(tmp)
    bz = Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol=tmp,
                    outputCol=out + "_d", handleInvalid="keep")
    return bz.transform(d).withColumn(out, F.col(out + "_d").cast("int")).drop(tmp, out + "_d")


def prefix_before(df: DataFrame, order: list[tuple[str, bool]], weight=None,
                  part_cols: list[str] | tuple = (), n_buckets: int | None = None,
                  out="before") -> DataFrame:
    """Weighted count of rows strictly before each row in ``order`` within ``part_cols``.

    ``df`` must be unique on ``part_cols + order`` columns. ``order`` is a list of
    ``(column, ascending)``; buckets are cut on the first order column. ``weight`` /
    ``out`` may be lists to compute several prefix sums in the same pass.
    """
    weights = weight if isinstance(weight, (list, tuple)) else [weight]
    outs = out if isinstance(out, (list, tuple)) else [out]
    first, asc = order[0]
    d = with_range_bucket(df, first, n_buckets, descending=not asc)
    keys = [F.col(c).asc() if a else F.col(c).desc() for c, a in order]
    w_in = (Window.partitionBy(*part_cols, "__bkt").orderBy(*keys)
            .rowsBetween(Window.unboundedPreceding, -1))
    w_off = Window.partitionBy(*part_cols).orderBy("__bkt").rowsBetween(Window.unboundedPreceding, -1)
    for i, wgt in enumerate(weights):
        d = d.withColumn(f"__w{i}", (F.col(wgt) if wgt else F.lit(1)).cast("long"))
        d = d.withColumn(f"__in{i}", F.coalesce(F.sum(f"__w{i}").over(w_in), F.lit(0)))
    tot = d.groupBy(*part_cols, "__bkt").agg(*[F.sum(f"__w{i}").alias(f"__t{i}") for i in range(len(weights))])
    off = tot.select(*part_cols, "__bkt", *[F.coalesce(F.sum(f"__t{i}").over(w_off), F.lit(0)).alias(f"__o{i}")
                                            for i in range(len(weights))])
    # off holds at most n_buckets rows per partition value: bounded broadcast
    d = d.join(F.broadcast(off), [*part_cols, "__bkt"])
    for i, o in enumerate(outs):
        d = d.withColumn(o, (F.col(f"__o{i}") + F.col(f"__in{i}")).cast("long"))
    return d.drop("__bkt", *[f"__{p}{i}" for p in ("w", "in", "o") for i in range(len(weights))])


def score_table(df: DataFrame, score: str, part_cols: list[str] | tuple = (),
                n_buckets: int | None = None) -> DataFrame:
    """Distinct scores with ``cnt``, ``gt`` (#rows with greater score) and ``n``."""
    d = materialize(df.groupBy(*part_cols, score).agg(F.count(F.lit(1)).alias("cnt")))     # boundaries, windows, totals and n read it
    p = prefix_before(d, [(score, False)], "cnt", part_cols, n_buckets, out="gt")
    n = d.groupBy(*part_cols).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n"))
    if part_cols:
        return p.join(F.broadcast(n), list(part_cols))
    return p.crossJoin(F.broadcast(n))


def attach_by_score(df: DataFrame, table: DataFrame, score: str,
                    part_cols: list[str] | tuple = ()) -> DataFrame:
    """Join per-score values back to rows; hot scores take a bounded broadcast path. A row
    without a score keeps its place in the table, with null values."""
    keys = [*part_cols, score]
    unranked = df.where(F.col(score).isNull())
    for f in table.schema.fields:
        if f.name not in keys:
            unranked = unranked.withColumn(f.name, F.lit(None).cast(f.dataType))
    df = df.where(F.col(score).isNotNull())
    hot = table.where(F.col("cnt") * HOT_SPLIT > F.col("n"))      # <= HOT_SPLIT rows
    cold = table.where(F.col("cnt") * HOT_SPLIT <= F.col("n"))
    hot_part = df.join(F.broadcast(hot), keys)
    cold_rows = df.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return hot_part.unionByName(cold_rows.join(cold, keys)).unionByName(unranked)


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder a frame that the next steps read several times,
    so each read is a scan of the columns it needs rather than a re-derivation of its plan. Columns of
    small numbers take far less room than a checkpoint's rows; what Parquet can't hold is checkpointed."""
    kinds = " ".join(kind for _, kind in df.dtypes)
    if "void" in kinds or "interval" in kinds or len({c.lower() for c in df.columns}) < len(df.columns):
        return df.checkpoint()
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rank_min(df: DataFrame, score: str, ascending: bool = False, out: str = "rank",
             part_cols: list[str] | tuple = (), n_buckets: int | None = None) -> DataFrame:
    """W1 rank(method='min'): 1 + number of rows with a strictly better score.
    The input is read four times (scores, hot, cold, anti) and is materialized once."""
    df = materialize(df)
    t = score_table(df.where(F.col(score).isNotNull()), score, part_cols, n_buckets)
    if ascending:
        t = t.withColumn("gt", F.col("n") - F.col("gt") - F.col("cnt"))
    t = materialize(t.select(*part_cols, score, "cnt", "n", (F.col("gt") + 1).cast("int").alias(out)))     # hot, cold and anti
    return attach_by_score(df, t, score, part_cols).drop("cnt", "n")


def selection_bounds(long_df: DataFrame, part_col: str, score: str,
                     specs: list[tuple[str, str, float, bool]], key=KEY,
                     n_buckets: int | None = None) -> dict[str, dict]:
    """W3 boundaries of top/bottom ``ceil(n*p)`` selections, for many specs at once.

    ``long_df`` holds (part_col, *key, score); ``specs`` are ``(part, tag, p, top)``.
    Order: score desc (top) / asc (bottom), ties broken by key ascending -- the same
    rows as ``row_number() over (partition by part order by score, key) <= ceil(n*p)``.

    Returns per tag ``b_score`` (boundary score), ``need`` (rows taken from the tie
    group at ``b_score``), ``cnt`` (its size) and ``kt`` (boundary key inside the tie
    group, or None when the group is taken whole). Only these bounded values reach
    the driver: one row per spec.
    """
    spark = long_df.sparkSession
    t = score_table(long_df.select(part_col, score), score, [part_col], n_buckets)
    spec_df = spark.createDataFrame(
        [(part, tag, float(p), bool(top)) for part, tag, p, top in specs],
        f"__sp {long_df.schema[part_col].dataType.simpleString()}, tag string, p double, top boolean")
    m = F.ceil(F.col("n") * F.col("p"))
    before = F.when(F.col("top"), F.col("gt")).otherwise(F.col("n") - F.col("gt") - F.col("cnt"))
    b = (t.join(F.broadcast(spec_df), F.col(part_col) == F.col("__sp"))   # <= len(specs) rows
         .where((before < m) & (before + F.col("cnt") >= m))
         .select("tag", F.col(part_col).alias("__sp"), F.col(score).alias("b_score"),
                 (m - before).cast("long").alias("need"), "cnt"))
    bounds = {r["tag"]: {"b_score": r["b_score"], "need": r["need"], "cnt": r["cnt"],
                         "part": r["__sp"], "kt": None}
              for r in b.collect()}                      # <= len(specs) rows
    partial = [(v["part"], tag, v["b_score"], v["need"] - 1) for tag, v in bounds.items()
               if v["need"] < v["cnt"]]
    if partial:
        tie_df = spark.createDataFrame(
            partial, f"__sp {long_df.schema[part_col].dataType.simpleString()}, tag string, "
                     f"__b double, __at long")
        ties = (long_df.join(F.broadcast(tie_df),
                             (F.col(part_col) == F.col("__sp")) & (F.col(score) == F.col("__b")))
                .select("tag", *key, "__at"))
        pos = prefix_before(ties, [(k, True) for k in key], None, ["tag"], n_buckets, out="__pos")
        for r in pos.where(F.col("__pos") == F.col("__at")).select("tag", *key).collect():
            bounds[r["tag"]]["kt"] = tuple(r[k] for k in key)
    return bounds


def _key_leq(key: list[str], kt: tuple):
    """Lexicographic ``key <= kt`` as a Column."""
    expr = None
    for i in reversed(range(len(key))):
        c, b = F.col(key[i]), F.lit(kt[i])
        expr = (c <= b) if expr is None else ((c < b) | ((c == b) & expr))
    return expr


def selection_flag(score: str, bound: dict | None, top: bool, key=KEY) -> F.Column:
    """Boolean Column for one selection computed by ``selection_bounds``."""
    if bound is None:                                     # empty input: nothing selected
        return F.lit(False)
    bs = F.lit(bound["b_score"])
    better = (F.col(score) > bs) if top else (F.col(score) < bs)
    tie = F.col(score) == bs
    if bound["kt"] is not None:
        tie = tie & _key_leq(key, bound["kt"])
    return F.coalesce(better | tie, F.lit(False))


def top_bottom_flags(df: DataFrame, score: str, specs: list[tuple[str, float, bool]],
                     key=KEY, n_buckets: int | None = None) -> DataFrame:
    """One boolean column per ``(tag, p, top)`` spec on a single score column."""
    df = materialize(df)
    long_df = df.select(F.lit(0).alias("__part"), *key, score)
    b = selection_bounds(long_df, "__part", score, [(0, t, p, top) for t, p, top in specs],
                         key, n_buckets)
    return df.select("*", *[selection_flag(score, b.get(t), top, key).alias(t) for t, _, top in specs])


def three_way_label(top: F.Column, bottom: F.Column, name: str = "label") -> F.Column:
    """Default 1, top -> 2, bottom -> 0 (bottom overrides top)."""
    return F.when(bottom, 0).when(top, 2).otherwise(1).cast("int").alias(name)


def rank_quantile_threshold(df: DataFrame, score: str, p: float, top: bool = True,
                            n_buckets: int | None = None) -> DataFrame:
    """W12 threshold: numpy-linear quantile of the min-rank column, one row ``thr``.

    The sorted ranks are the score groups in descending order, each group of
    ``cnt`` rows carrying rank ``gt + 1``; position ``h = (n-1)q`` is located in
    the distinct-score table without materialising the rank column.
    """
    q = p if top else 1.0 - p
    t = score_table(df.select(score).where(F.col(score).isNotNull()), score, (), n_buckets)
    h = (F.col("n") - 1) * F.lit(q)
    lo = F.floor(h)
    hi = F.least(lo + 1, F.col("n") - 1)
    at = lambda pos: (F.col("gt") <= pos) & (pos < F.col("gt") + F.col("cnt"))
    agg = t.agg(
        F.first("n").alias("n"),
        F.max(F.when(at(lo), F.col("gt") + 1)).alias("x_lo"),
        F.max(F.when(at(hi), F.col("gt") + 1)).alias("x_hi"),
    )
    hh = (F.col("n") - 1) * F.lit(q)
    return agg.select(
        (F.col("x_lo") + (hh - F.floor(hh)) * (F.col("x_hi") - F.col("x_lo"))).cast("double").alias("thr"))


def label_by_rank_quantile(df: DataFrame, score: str, p: float, top: bool = True,
                           n_buckets: int | None = None) -> DataFrame:
    """Rank (min, desc) plus ``label`` = 1 when rank <= q_p (top) or >= q_{1-p}."""
    df = materialize(df)
    ranked = rank_min(df, score, ascending=False, out="rank", n_buckets=n_buckets)
    thr = rank_quantile_threshold(df, score, p, top, n_buckets)
    cond = (F.col("rank") <= F.col("thr")) if top else (F.col("rank") >= F.col("thr"))
    return (ranked.crossJoin(F.broadcast(thr))
            .withColumn("label", F.when(cond, 1).otherwise(0)).drop("thr"))


def weighted_dims_label(df: DataFrame, p: float, n_buckets: int | None = None) -> DataFrame:
    """score = size + 2*structure - content; label 1 for rank <= ceil(n p),
    0 for rank > n - ceil(n p), else null."""
    from ..plans.labeling import dimension_scores      # one statistics pass for 3 groups
    d = dimension_scores(df).select("sample_id", "index", "size_score", "structure_score", "content_score")
    d = d.withColumn("score", F.round(F.col("size_score") + 2 * F.col("structure_score")
                                      - F.col("content_score"), 9))
    r = rank_min(d, "score", ascending=False, n_buckets=n_buckets)
    n = r.agg(F.count(F.lit(1)).alias("__n"))
    m = F.ceil(F.col("__n") * F.lit(p))
    return (r.crossJoin(F.broadcast(n))
            .withColumn("label", F.when(F.col("rank") <= m, 1)
                        .when(F.col("rank") > F.col("__n") - m, 0).cast("int"))
            .drop("__n"))


def hash_order(key: list[str], seed: int = 42) -> F.Column:
    """Deterministic pseudo-random order: md5('seed|k1|k2...')."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def stratified_sample(df: DataFrame, label: str, n: int, key=KEY, seed: int = 42) -> DataFrame:
    """A2: ``n`` rows per class, deterministic hash order.

    ``row_number() <= n`` lets Catalyst insert a partial WindowGroupLimit before
    the shuffle, so each map task forwards at most ``n`` rows per class.
    """
    w = Window.partitionBy(label).orderBy(hash_order(key, seed), *key)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def sample_shortfall(df: DataFrame, label: str, n: int) -> DataFrame:
    """A2 error side: classes with fewer than ``n`` rows (the reference raises)."""
    return (df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
            .where(F.col("rows") < n))


def stratified_folds(df: DataFrame, label: str, k: int = 10, key=KEY, seed: int = 42,
                     n_buckets: int | None = None) -> DataFrame:
    """fold = (position within class in hash order) mod k.

    The position comes from ``prefix_before`` per class (range-split), not from a
    per-class window, because each class can hold a third of all rows.
    """
    d = df.withColumn("__h", hash_order(key, seed))
    d = d.withColumn("__hv", F.conv(F.substring("__h", 1, 12), 16, 10).cast("long"))
    p = prefix_before(d, [("__hv", True), ("__h", True), *[(c, True) for c in key]],
                      None, [label], n_buckets, out="__pos")
    return p.withColumn("fold", (F.col("__pos") % k).cast("int")).drop("__h", "__hv", "__pos")

"""Mixing sources to target weights by hash-threshold histograms.

Each source has a target number of words. A source whose target is ``q`` times its size plus a
rest takes every document ``q`` times and once more those documents whose hash lies under a
threshold. The threshold comes from a histogram: words are summed by source and hash bucket (a
map-side sum, so a hot source is no hot task), the bucket in which the running sum crosses the
budget is the boundary, and only the documents of that bucket are summed again by the next bits
of the hash, until the boundary holds one hash value. The mix is then a plain filter; no document
is sorted or moved. The thresholds of more passes nest: a smaller target's mix is part of a larger one's.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; rows
with equal ``doc_id`` (null ids among them) have equal hashes; where they lie at the threshold, the hash of their texts
decides by histograms of its own, so only rows equal in both are taken alike; an empty table gives no rows; empty
documents follow the same thresholds. Extra columns pass through, result names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, written

RESULTS = ("size", "source_size", "target", "copies", "taken")
#: Bits of the hash that one histogram resolves, and histograms at most (5 * 12 = all 60 bits).
BITS, LEVELS = 12, 5


def doc_hash(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id (or text) as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=(5.0, 2.0, 1.0), max_passes: float = 3.0) -> DataFrame:
    """(source, source_size) -> + weight, target. One row per source.

    Every target is ``min(max_passes * size, level * weight)`` with the one level at which the
    targets sum to the sum of sizes: sources are ordered by the level at which they fill up.
    The windows run over one row per source, not over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), k.cast("int") + 1)
    t = sizes.withColumn("weight", w).withColumn("full_at", max_passes * F.col("source_size") / F.col("weight"))
    fill = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumns({
        "total": F.sum("source_size").over(all_).cast("double"),
        "used": F.coalesce(F.sum(max_passes * F.col("source_size")).over(before), F.lit(0.0)),
        "rest_w": F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)),
    })
    # the level if this source and all later ones are not full; the true level is the first that holds
    t = t.withColumn("level", (F.col("total") - F.col("used")) / F.col("rest_w"))
    t = t.withColumn("nth", F.row_number().over(fill))
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("nth", "level"))).over(all_)["level"])
    cap = max_passes * F.col("source_size")
    return t.select("source", "source_size", "weight",
                    F.when(F.col("level").isNull(), cap).otherwise(
                        F.least(cap, F.col("level") * F.col("weight"))).alias("target"))


def thresholds(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, passes, cut, sub_cut): documents with hash < ``cut``, or hash = ``cut`` and sub < ``sub_cut``, are
    taken once more than ``passes``.

    ``slim`` has (source, hash, size) and may have sub, the hash within equal hashes; ``plan`` has (source, source_size, target).
    """
    if "sub" not in slim.columns:
        slim = slim.withColumn("sub", F.lit(0).cast("long"))
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                           .otherwise(0).cast("long"))
    state = plan.select("source", "passes",
                        (F.col("target") - F.col("passes") * F.col("source_size")).alias("budget"),
                        F.lit(0).cast("long").alias("low"))
    rows, done = slim, None
    for level in range(2 * LEVELS):             # the hash first, then the texts' hash within one value of it
        by = "hash" if level < LEVELS else "sub"
        width = 1 << (BITS * (LEVELS - 1 - level % LEVELS))
        hist = rows.groupBy("source", F.floor(F.col(by) / F.lit(width)).cast("long").alias("bucket")).agg(
            F.sum("size").cast("double").alias("s"), *(f(c).alias(n + c) for f, n in ((F.min, "lo_"), (F.max, "hi_")) for c in ("hash", "sub")))
        hist = hist.select("source", "bucket", "s", *(F.struct(F.col(n + "_hash").alias("hash"), F.col(n + "_sub").alias("sub")).alias(n)
                                                      for n in ("lo", "hi")))
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("s").over(run))
        # the first bucket that does not fit whole
        crossing = (hist.alias("h").join(state.alias("p"),
                                         F.col("h.source").eqNullSafe(F.col("p.source")))
                    .where(F.col("upto") > F.col("budget"))
                    .groupBy("p.source", "p.passes", "p.budget")
                    .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("s")).alias("below"), "s", "lo", "hi")).alias("b")))
        crossing = written(crossing.select(
            "source", "passes", (F.col("budget") - F.col("b.below")).alias("budget"), F.col("b.bucket").alias("bucket"),
            F.col("b.s").alias("s"), F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi")), "mix-cut")
        one = F.col("lo") == F.col("hi")
        if level == 2 * LEVELS - 1:
            one = F.lit(True)
        # one hash value: taken if that brings the sum nearer to the budget
        taken = F.col("s") - F.col("budget") <= F.col("budget")
        in_sub = F.col("lo.sub") + F.when(taken, 1).otherwise(0)
        ended = crossing.where(one).select(
            "source", "passes", *((F.when(taken, F.col("lo.hash") + 1).otherwise(F.col("lo.hash")).alias("cut"), F.lit(0).cast("long").alias("sub_cut"))
                                  if by == "hash" else (F.col("lo.hash").alias("cut"), in_sub.alias("sub_cut"))))
        done = ended if done is None else done.unionByName(ended)
        state = crossing.where(~one)
        if level == 2 * LEVELS - 1 or state.isEmpty():
            break
        rows = (rows.alias("r").join(state.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source"))
                                     & (F.floor(F.col(f"r.{by}") / F.lit(width)).cast("long") == F.col("c.bucket")))
                .select("r.source", "r.hash", "r.sub", "r.size"))
        rows = written(rows, "mix-boundary")
        state = state.select("source", "passes", "budget")
    # sources whose rest is 0 or holds every document never cross
    top = F.lit(1 << (BITS * LEVELS))
    first = plan.select("source", "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"))
    cut = F.coalesce(F.col("d.cut"), F.when(F.col("p.rest") > 0, top).otherwise(F.lit(0)))
    return (first.alias("p").join(done.alias("d"), F.col("p.source").eqNullSafe(F.col("d.source")), "left")
            .select("p.source", "p.passes", cut.cast("long").alias("cut"),
                    F.coalesce(F.col("d.sub_cut"), F.lit(0)).cast("long").alias("sub_cut")))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights=(5.0, 2.0, 1.0), max_passes: float = 3.0) -> DataFrame:
    """All columns of ``df`` plus ``RESULTS``: ``copies`` is how often the mix takes the row."""
    keep = [c for c in df.columns if c not in RESULTS]
    sized = df.select(*keep).withColumns({"size": n_words(F.col(text)), "__hash": doc_hash(F.col(doc_id)),
                                          "__sub": doc_hash(F.col(text))})
    slim = written(sized.select(F.col(source).alias("source"), F.col("__hash").alias("hash"), F.col("__sub").alias("sub"), "size"),
                   "mix-sizes")
    plan = written(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_passes),
                   "mix-targets")
    cuts = thresholds(slim, plan)
    # one row per source, written: Spark broadcasts it if its size allows, else splits the hot source
    per_source = written(plan.alias("a").join(cuts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
                         .select(F.col("a.source").alias("__source"), "source_size", "target", *[F.col(c).alias(f"__{c}") for c in ("passes", "cut", "sub_cut")]), "mix-plan")
    out = sized.join(per_source, F.col(source).eqNullSafe(F.col("__source")))
    copies = F.col("__passes") + F.when(
        (F.col("__hash") < F.col("__cut")) | ((F.col("__hash") == F.col("__cut")) & (F.col("__sub") < F.col("__sub_cut"))), 1).otherwise(0)
    # a source of 0 words has nothing to repeat: its documents stay once
    copies = F.when(F.col("source_size") == 0, F.lit(1)).otherwise(copies).cast("long")
    copies = F.least(copies, F.lit(int(max_passes)).cast("long"))
    return out.select(*keep, "size", "source_size", "target", copies.alias("copies"),
                      (copies * F.col("size")).alias("taken"))

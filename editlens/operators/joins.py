"""Keyed joins the jobs perform (J1-J7, J11) and set / bag operations.

Deduplication by "last line wins" / "first match" uses ``max_by`` / ``min_by``
aggregates: a hash aggregate with map-side partial combine, so a key repeated a
million times is reduced on every mapper before the shuffle (a ``row_number``
window would sort a hot key inside one task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["sample_id", "index"]


def left_merge(left: DataFrame, right: DataFrame, key=KEY) -> DataFrame:
    """``merge(on=key, how='left')``."""
    return left.join(right, list(key), "left")


def dedup_by(df: DataFrame, key: list[str], order_col: str, keep: str = "last") -> DataFrame:
    """One row per key: the row with the largest (``last``) or smallest (``first``)
    ``order_col``. ``order_col`` must be unique within a key."""
    cols = [c for c in df.columns if c not in key]
    pick = F.max_by if keep == "last" else F.min_by
    packed = pick(F.struct(*cols), F.col(order_col)).alias("__r")
    return df.groupBy(*key).agg(packed).select(*key, "__r.*")


def _all_found(left: DataFrame, right: DataFrame, key) -> DataFrame:
    """Left join in which a left row without a match is an error."""
    message = F.concat(F.lit("no match for key "), F.to_json(F.struct(*key)))
    hit = F.coalesce(F.col("__hit"), F.raise_error(message).cast("boolean"))
    return left.join(right.withColumn("__hit", F.lit(True)), list(key), "left").where(hit).drop("__hit")


def strict_lookup(left: DataFrame, right: DataFrame, line_col: str, key=KEY) -> DataFrame:
    """Lookup of every left row in ``right``; duplicate right keys: the last line
    wins. A missing key raises."""
    return _all_found(left, dedup_by(right, list(key), line_col, "last"), key)


def first_match(left: DataFrame, right: DataFrame, line_col: str, key=KEY) -> DataFrame:
    """First matching right row per key (``values[0]``). A missing key raises."""
    return _all_found(left, dedup_by(right, list(key), line_col, "first"), key)


def inner_with_skips(left: DataFrame, right: DataFrame, key=KEY) -> tuple[DataFrame, DataFrame]:
    """Inner lookup plus the side table of skipped (unmatched) left keys."""
    return left.join(right, list(key), "inner"), left.select(*key).join(right.select(*key), list(key), "left_anti")


def priority_label(df: DataFrame, samples: list[DataFrame], key=KEY, out: str = "cluster_label") -> DataFrame:
    """Keep rows present in any sample; label = position of the first sample
    containing the row (0, 1, 2, ...)."""
    tagged = None
    for i, s in enumerate(samples):
        t = s.select(*key).withColumn(out, F.lit(i))
        tagged = t if tagged is None else tagged.unionByName(t)
    best = tagged.groupBy(*key).agg(F.min(out).alias(out))
    return df.join(best, list(key), "inner")


def anti_resume(inputs: DataFrame, done: DataFrame, key=KEY) -> DataFrame:
    """Inputs whose key is not yet in the output."""
    return inputs.join(done.select(*key).distinct(), list(key), "left_anti")


def semi_flag(df: DataFrame, ids: DataFrame, value, otherwise: str, out: str, key=KEY) -> DataFrame:
    """``out = value`` if the key is in ``ids`` else column ``otherwise``."""
    m = ids.select(*key).distinct().withColumn("__hit", F.lit(True))
    return (df.join(m, list(key), "left")
            .withColumn(out, F.when(F.col("__hit"), F.lit(value)).otherwise(F.col(otherwise)))
            .drop("__hit"))


def key_intersection(*frames: DataFrame, key=KEY) -> DataFrame:
    """O3: keys present in every frame (``intersect`` = distinct semantics)."""
    out = frames[0].select(*key)
    for f in frames[1:]:
        out = out.intersect(f.select(*key))
    return out


def multi_ref_ngram_counts(refs_long: DataFrame, key: list[str], gram: str, ref_id: str) -> DataFrame:
    """Per (key, gram) the max count over references and the bag-sum."""
    per_ref = refs_long.groupBy(*key, gram, ref_id).agg(F.count(F.lit(1)).alias("__c"))
    return per_ref.groupBy(*key, gram).agg(F.max("__c").cast("long").alias("max_count"),
                                           F.sum("__c").cast("long").alias("sum_count"))

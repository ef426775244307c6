"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is a ``min`` aggregate by node (combined before the shuffle, so a hub is no hot task)
and one join back to the links. The aggregate is written first, so the join reads two plain shuffles
and Spark can split a skewed side. Nothing reaches the driver but a checksum of the links per
round; every round is checkpointed to the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _checksum(df: DataFrame):
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-low")
    return both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    # links point from the larger to the smaller node
    low = written(e.groupBy("u").agg(F.min("v").alias("m")), "star-low")
    j = e.join(low, "u")
    down = j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.union(low.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (u, v) of comparable ids -> (u, v): every linked node but the smallest of its
    component, with that smallest node. Self links and repeated links are ignored."""
    e = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct().checkpoint()
    last, n = None, _checksum(e)
    while n != last and n[0]:
        last = n
        e = _large_star(e).distinct().checkpoint()
        e = _small_star(e).distinct().checkpoint()
        n = _checksum(e)
    return e


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of 0..n-1 over the links a-b (one task's share of the links)."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root

"""Distributed ranking / statistics helpers against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from editlens.operators import classify as C
from editlens.operators import ranking as R
from editlens.operators import stats as S


@pytest.fixture(scope="module")
def scored(spark):
    rnd = random.Random(3)
    rows = []
    for sid in range(300):
        for idx in range(rnd.randint(1, 3)):
            # a hot score shared by about a third of the rows, plus ties elsewhere
            score = 0.5 if rnd.random() < 0.33 else round(rnd.random(), 2)
            rows.append((sid, idx, score))
    return rows, spark.createDataFrame(rows, "sample_id long, `index` long, s double")


def test_prefix_before_matches_bruteforce(spark, scored):
    rows, df = scored
    d = df.groupBy("s").agg(F.count(F.lit(1)).alias("cnt"))
    got = {r["s"]: r["gt"] for r in R.prefix_before(d, [("s", False)], "cnt", n_buckets=5, out="gt").collect()}
    for s in got:
        assert got[s] == sum(1 for r in rows if r[2] > s)


def test_rank_min_matches_bruteforce(spark, scored):
    rows, df = scored
    got = {(r["sample_id"], r["index"]): r["rank"] for r in R.rank_min(df, "s", n_buckets=4).collect()}
    assert len(got) == len(rows)
    for sid, idx, s in rows:
        assert got[(sid, idx)] == 1 + sum(1 for r in rows if r[2] > s)


@pytest.mark.parametrize("p", [0.2, 0.5, 0.9])
def test_top_bottom_flags_match_row_number(spark, scored, p):
    rows, df = scored
    got = {(r["sample_id"], r["index"]): (r["top"], r["bot"]) for r in
           R.top_bottom_flags(df, "s", [("top", p, True), ("bot", p, False)], n_buckets=4).collect()}
    m = math.ceil(len(rows) * p)
    top = set((a, b) for a, b, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1]))[:m])
    bot = set((a, b) for a, b, _ in sorted(rows, key=lambda r: (r[2], r[0], r[1]))[:m])
    assert {k for k, v in got.items() if v[0]} == top
    assert {k for k, v in got.items() if v[1]} == bot


def test_exact_quantiles_numpy_linear(spark, scored):
    import numpy as np
    rows, df = scored
    q = S.exact_quantiles(df, [], "s", [0.1, 0.25, 0.5, 0.9], n_buckets=3).collect()[0]
    vals = np.array([r[2] for r in rows])
    for i, p in enumerate([0.1, 0.25, 0.5, 0.9]):
        assert math.isclose(q[f"q{i}"], float(np.quantile(vals, p)), abs_tol=1e-12)


def _avg_ranks(values):
    order = sorted(values)
    first = {}
    for i, v in enumerate(order):
        first.setdefault(v, i + 1)
    counts = {v: order.count(v) for v in set(order)}
    return {v: first[v] + (counts[v] - 1) / 2 for v in counts}


def test_mann_whitney_and_cliffs_delta(spark):
    rnd = random.Random(5)
    x = [rnd.randint(0, 6) for _ in range(40)]
    y = [rnd.randint(2, 9) for _ in range(55)]
    df = spark.createDataFrame([("f", float(v), 0) for v in x] + [("f", float(v), 2) for v in y],
                               "feature string, value double, label int")
    t = S.value_table(df, ["feature"], "value", "label", (0, 2), n_buckets=3)
    r = S.mann_whitney_cliffs(t, ["feature"]).collect()[0]
    ar = _avg_ranks(x + y)
    u1 = sum(ar[v] for v in x) - len(x) * (len(x) + 1) / 2
    assert math.isclose(r["u_stat"], u1)
    delta = (sum(1 for a in x for b in y if a > b) - sum(1 for a in x for b in y if a < b)) / (len(x) * len(y))
    assert math.isclose(r["cliffs_delta"], delta)
    # symmetry: delta(x, y) = -delta(y, x)
    df2 = df.withColumn("label", F.when(F.col("label") == 0, 2).otherwise(0))
    r2 = S.mann_whitney_cliffs(S.value_table(df2, ["feature"], "value", "label", (0, 2)), ["feature"]).collect()[0]
    assert math.isclose(r2["cliffs_delta"], -delta)


def test_auc_bruteforce_and_negation(spark):
    rnd = random.Random(11)
    rows = [(0, round(rnd.random(), 1), rnd.random() < 0.4) for _ in range(200)]
    df = spark.createDataFrame(rows, "cls int, score double, pos boolean")
    auc = S.ovr_auc(df, "cls", "score", "pos", n_buckets=3).collect()[0]["auc"]
    pos = [s for _, s, p in rows if p]
    neg = [s for _, s, p in rows if not p]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert math.isclose(auc, want)
    neg_auc = S.ovr_auc(df.withColumn("score", -F.col("score")), "cls", "score", "pos").collect()[0]["auc"]
    assert math.isclose(neg_auc, 1 - want)


def test_kappa_self_is_one(spark):
    df = spark.createDataFrame([(i, i % 3, (i * 7) % 3) for i in range(60)], "item long, a int, b int")
    k = {(r["r1"], r["r2"]): r["kappa"] for r in C.cohen_kappa_matrix(df, "item", ["a", "b"]).collect()}
    assert math.isclose(k[("a", "a")], 1.0) and math.isclose(k[("b", "b")], 1.0)
    assert math.isclose(k[("a", "b")], k[("b", "a")])


def test_stratified_folds_balanced(spark):
    df = spark.createDataFrame([(i, 0, i % 3) for i in range(300)], "sample_id long, `index` long, y int")
    f = R.stratified_folds(df, "y", 10, n_buckets=4).groupBy("y", "fold").count().collect()
    assert all(r["count"] == 10 for r in f) and len(f) == 30

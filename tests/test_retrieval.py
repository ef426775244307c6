"""The doubling widening schedule and the single-round shortcut give the same
survivors (W8), and the blocked top-k does not depend on the block counts."""

from pyspark.sql import functions as F

from editlens.operators import retrieval as RT
from editlens.plans.catalog import retrieval as CR
from editlens.plans.retrieval import rank_candidates

from .conftest import SF001


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_doubling_equals_single_round(spark, monkeypatch):
    _, _, corpus, queries, payload = CR._inputs(spark, SF001)
    assert RT.widening_schedule(200) == [20, 40, 80, 160, 320]
    doubled = _rows(rank_candidates(corpus, queries, payload))
    monkeypatch.setattr(RT, "widening_schedule", lambda n: [n])
    assert _rows(rank_candidates(corpus, queries, payload)) == doubled


def test_block_size_alone_decides():
    assert RT.n_blocks(10 ** 9) == 50_000 and RT.n_blocks(10 ** 9, RT.QUERY_BLOCK_ROWS) == 10 ** 6 and RT.n_blocks(0) == 1


def test_block_counts_do_not_change_topk(spark):
    _, _, corpus, queries, _ = CR._inputs(spark, SF001)
    a = RT.block_topk(corpus, queries, 15, "level", corpus_blocks=1, query_blocks=1)
    b = RT.block_topk(corpus, queries, 15, "level", corpus_blocks=7, query_blocks=3)
    cols = ["qid", "side", "rank", "cand_id", "score"]
    assert _rows(a.select(*cols)) == _rows(b.select(*cols))
    assert a.groupBy("qid", "side").agg(F.max("rank").alias("m")).where(F.col("m") > 15).count() == 0


def test_topk_ties_match_full_sort():
    import numpy as np
    rng = np.random.default_rng(1)
    for _ in range(100):
        n, rows, k = int(rng.integers(1, 40)), int(rng.integers(1, 5)), int(rng.integers(1, 45))
        scores = rng.integers(0, 5, (rows, n)).astype(float)          # many ties
        cids = rng.permutation(1000)[:n].astype(np.int64)
        row, col = RT._topk(scores, cids, k)
        for r in range(rows):
            assert list(col[row == r]) == list(np.lexsort((cids, -scores[r]))[:k])


def test_interval_survivors_match_per_round(spark):
    import random
    rnd = random.Random(9)
    rows = []
    for qid in range(6):
        for cand in range(40):
            rows.append((qid, qid * 100 + cand, float(rnd.randint(0, 9)), rnd.randint(1, 8),
                         rnd.randint(0, 7), f"t{rnd.randint(0, 4)}"))
    pairs = spark.createDataFrame(rows, "qid long, cand_id long, score double, entry int, sample_id long, text string")
    info = spark.createDataFrame([(q, rnd.randint(1, 5), 8, True) for q in range(6)],
                                 "qid long, K int, last_round int, final boolean")
    # per-round explode (the direct definition)
    rounds = info.select("qid", F.explode(F.sequence(F.lit(1), F.col("last_round"))).alias("round"))
    surv = RT.survivors(pairs, rounds)
    want_round = RT.pick_round(surv, info.select("qid", "K"), info.select("qid", "last_round", "final"))
    want = surv.join(want_round.select("qid", "round"), ["qid", "round"])
    # interval form
    winners = RT.alive_winners(pairs)
    got_round = RT.pick_round_by_counts(RT.survivor_counts(winners), info)
    got = RT.survivors_at(winners, got_round.select("qid", "round"))
    cols = ["qid", "round", "text", "cand_id", "sample_id", "score"]
    assert _rows(want_round.select("qid", "round", "satisfied")) == _rows(got_round.select("qid", "round", "satisfied"))
    assert _rows(want.select(*cols)) == _rows(got.select(*cols))

"""Errors that must fire, nulls that must stay, inputs that change, long inputs."""

import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from editlens.functions import distance
from editlens.operators import joins, ranking

from .conftest import ROOT, SF001


def test_missing_key_raises(spark):
    left = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "sample_id long, index long, x string")
    right = spark.createDataFrame([(1, 0, 5, "u"), (1, 0, 7, "v")], "sample_id long, index long, line long, y string")
    for f, want in ((joins.strict_lookup, "v"), (joins.first_match, "u")):
        assert [r.y for r in f(left.where("sample_id = 1"), right, "line").collect()] == [want]
        with pytest.raises(Exception, match="no match for key"):
            f(left, right, "line").collect()


def test_null_scores_keep_their_rows(spark):
    df = spark.createDataFrame([(1, 3.0), (2, None), (3, 5.0), (4, 3.0)], "sample_id long, s double")
    got = {r.sample_id: r["rank"] for r in ranking.rank_min(df, "s").collect()}
    assert got == {1: 2, 2: None, 3: 1, 4: 2}


def test_word_distance_beyond_the_surrogates(spark):
    n = 36_000
    df = spark.range(1).select(F.expr(f"transform(sequence(1, {n}), i -> concat('t', i))").alias("a"),
                               F.expr(f"transform(sequence(1, {n}), i -> if(i = {n}, 'x', concat('t', i)))").alias("b"))
    tail = df.select(F.expr(f"slice(a, {n - 40}, 41)").alias("a"), F.expr(f"slice(b, {n - 40}, 41)").alias("b"), F.expr("array_distinct(concat(a, b))").alias("v"))
    assert tail.select(F.expr(distance.word_edit_distance("a", "b", "v"))).first()[0] == 1


def test_lcs_against_table():
    import pandas as pd
    rng = random.Random(1)
    for _ in range(200):
        x, y = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if p == q else max(t[i][j + 1], t[i + 1][j])
        assert distance._lcs_batch(pd.Series([x]), pd.Series([y]))[0] == t[-1][-1]


def test_labels_follow_the_input(spark, tmp_path):
    import __spark_entry__ as E
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    path = f"{tmp_path}/lineitem.parquet"
    li.where("l_orderkey % 2 = 0").write.parquet(path)
    q = E.queries()["e1_complexity_labels"]
    first = q(spark, str(tmp_path)).count()
    li.where("l_orderkey % 2 <> 0").write.mode("append").parquet(path)
    assert q(spark, str(tmp_path)).count() > first


def test_workers_find_the_package_from_any_folder(tmp_path):
    code = ("import sys; sys.path.insert(0, %r)\nimport __spark_entry__ as E\nfrom pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '4').getOrCreate()\n"
            "print('rows', len(E.queries()['j9_block_topk'](s, %r).collect()))" % (ROOT, SF001))
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows " in out.stdout, out.stderr[-2000:]


def test_checkpoint_folder_is_asked_for_off_local(monkeypatch):
    from editlens import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())

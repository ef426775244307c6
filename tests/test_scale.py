"""Steps that must stay narrow or small however large their input is, and the results they must keep."""

import random
from collections import Counter

from editlens import fixtures
from editlens.fixtures import FEATURE_SQL, features
from editlens.functions import ngrams as N
from editlens.operators.evaluation import eval_report, eval_rows
from editlens.operators.ranking import materialize
from editlens.operators.stats import value_table
from editlens.plans.labeling import complexity_labels


def _nodes(plan, name):
    found = [plan] if plan.nodeName() == name else []
    kids = plan.children()
    return found + [x for i in range(kids.size()) for x in _nodes(kids.apply(i), name)]


def test_gram_tables_count_like_counters():
    rnd = random.Random(3)
    for _ in range(50):
        sides = [[[rnd.choice("abc") for _ in range(rnd.randint(0, 9))] for _ in range(rnd.randint(0, 2))] for _ in range(3)]
        for n, got in enumerate(N.gram_tables(sides), 1):
            want = [Counter(tuple(x[i:i + n]) for x in side for i in range(len(x) - n + 1)) for side in sides]
            keys = set().union(*want)
            assert Counter(map(tuple, got.T.tolist())) == Counter(tuple(w[k] for w in want) for k in keys)


def test_rows_beside_a_udf_are_narrow(spark):
    df = spark.createDataFrame([(1, 0, 0, ["a", "b"], ["a"], "a x", "a b"), (2, 0, 1, None, None, None, None)],
                               "sample_id long, index long, level int, r array<string>, s array<string>, p string, t string")
    rows = eval_rows(df, "r", "s", "p", "t")
    nodes = _nodes(eval_report(rows)._jdf.queryExecution().optimizedPlan(), "ArrowEvalPython")
    assert nodes
    for node in nodes:
        out = node.children().apply(0).output()
        kinds = [out.apply(i).dataType().simpleString() for i in range(out.size())]
        assert not [k for k in kinds if "struct" in k or k.count("array") > 1], kinds
    got = {r["sample_id"]: r for r in rows.collect()}
    assert got[1]["gleu"]["m1"] == 1 and got[1]["bleu"]["correct1"] == 1 and got[2]["gleu"]["m1"] == 0


def _lines(spark, n=400):
    rnd = random.Random(5)
    pick = lambda *v: rnd.choice([None, *v])                # noqa: E731
    rows = [(pick(1, 2, 3, 4, 5, 6), pick(1, 2, 3), pick(*range(900, 1100)), pick(*range(12)), pick(1.0, 2.0, 50.0), pick(0.0, 0.05), pick(0.01, 0.08))
            for _ in range(n)]
    return spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, "
                                       "l_discount double, l_tax double")


def test_features_are_those_of_their_sql_behind_one_shuffle(spark):
    li = _lines(spark)
    got = features(li)
    want = spark.sql(f"select l_orderkey as sample_id, cast(l_linenumber as bigint) as index, {FEATURE_SQL} from {{li}} "
                     "group by l_orderkey, l_linenumber", li=li)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1, plan


def test_partitions_of_features_follow_the_lines(spark, monkeypatch):
    """No task's tables hold more lines as the table grows; before, their number was that of the shuffle partitions."""
    monkeypatch.setattr(fixtures, "LINES", 20, raising=False)
    monkeypatch.setattr(fixtures, "FEW_LINES", 5, raising=False)
    for n, parts in ((30, 6), (100, 8), (400, 20)):
        got = features(_lines(spark, n))
        assert got.rdd.getNumPartitions() == parts
        assert got.count() == got.select("sample_id", "index").distinct().count()


def test_labels_make_features_once(spark):
    """Statistics and scores read the features that were written; before, they were aggregated for either."""
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    f = features(_lines(spark, 300))
    complexity_labels(f.mapInArrow(note, f.schema)).collect()
    assert seen.value == f.count()


def test_value_table_is_derived_once(spark):
    """Boundaries, windows and totals read the distinct values that were written."""
    df = spark.createDataFrame([("f", float(i % 7), 2 * (i % 2)) for i in range(60)], "feature string, value double, label int")
    t = value_table(df, ["feature"], "value", "label", (0, 2), n_buckets=3)
    assert not _nodes(t._jdf.queryExecution().optimizedPlan(), "LogicalRDD")      # of the source; what is left scans files
    assert t.agg({"cnt": "sum"}).first()[0] == 60


def test_tables_read_again_are_columns_on_disk(spark):
    df = spark.createDataFrame([(1, 0.5, None), (2, None, [0.25])], "sample_id long, score double, p array<double>")
    kept = materialize(df)
    assert len(_nodes(kept._jdf.queryExecution().optimizedPlan(), "LogicalRelation")) == 1      # a file scan: it reads the columns asked for
    assert kept.dtypes == df.dtypes and sorted(kept.collect()) == sorted(df.collect())
    odd = df.selectExpr("sample_id", "null as nothing")
    assert sorted(materialize(odd).collect()) == sorted(odd.collect())

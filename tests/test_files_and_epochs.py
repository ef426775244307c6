"""Named files, indented JSON, runs by epoch, p-values in expressions and complexity by function."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from editlens.operators import editseq as X
from editlens.operators import stats as S
from editlens.sources import io, named_files
from editlens.streaming import epochs


# named files --------------------------------------------------------------------------------------------------

def test_named_files(spark, tmp_path):
    from editlens.session import ship_package
    ship_package(spark)
    rows = [("a/src", f"{i}.java", f"text {i}\nöß", i) for i in range(30)] + [("", "top.java", None, 0), ("a/src", "3.java", "later", 99)]
    df = spark.createDataFrame(rows, "folder string, name string, content string, i int").repartition(4)
    once, again = named_files.last_of_name(df, ["i"])
    path = str(tmp_path / "out")
    named_files.write_named_files(once, path)
    assert [(r.name, r.n) for r in again.collect()] == [("3.java", 2)]
    assert sorted(os.listdir(f"{path}/a/src")) == sorted(f"{i}.java" for i in range(30)) and sorted(os.listdir(path)) == ["_SUCCESS", "a", "top.java"]
    assert open(f"{path}/a/src/3.java").read() == "later" and open(f"{path}/top.java").read() == ""
    back = {(r.folder, r.name): r.content for r in named_files.read_named_files(spark, path).collect()}
    assert back[("a/src", "5.java")] == "text 5\nöß" and back[("a/src", "3.java")] == "later"
    named_files.write_named_files(once, path)               # a second run leaves the same files
    assert sorted(os.listdir(f"{path}/a/src")) == sorted(f"{i}.java" for i in range(30))
    named_files.write_named_files(df.limit(0), str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == ["_SUCCESS"]


def test_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([("d", f"{i}.txt", "x") for i in range(20)] + [("d", "", "no name")], named_files.SCHEMA).coalesce(1)
    with pytest.raises(Exception, match="not a file name"):
        named_files.write_named_files(df, str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out" / "_SUCCESS")
    writer = named_files.NamedFilesWriter(str(tmp_path / "w"))
    message = writer.write(iter([{"folder": "d", "name": "x", "content": "y"}]))
    assert os.path.exists(tmp_path / "w/d/x")
    writer.abort([message, None])
    assert not os.path.exists(tmp_path / "w/d/x")


def test_driver_lists_no_files(spark, tmp_path):
    """The plan of a read holds a table of names (was: every file, with its state, in the driver)."""
    rows = [(f"d{i % 3}/x", f"{i}.txt", f"{i}\n" * (i % 4)) for i in range(300)] + [(None, "top", "é")]
    path = str(tmp_path / "out")
    named_files.write_named_files(spark.createDataFrame(rows, named_files.SCHEMA).repartition(3), path)
    for odd in ("_hidden", ".hidden", "d0/_x.txt", "_folder/x"):
        os.makedirs(os.path.dirname(f"{path}/{odd}"), exist_ok=True)
        open(f"{path}/{odd}", "w").close()
    back = named_files.read_named_files(spark, path)
    assert len(back.inputFiles()) < 10
    assert sorted(tuple(r) for r in back.collect()) == sorted((f or "", n, c) for f, n, c in rows)
    with pytest.MonkeyPatch.context() as m:                 # contents in several batches, files in several tasks
        m.setattr(named_files, "BATCH", 5)
        m.setattr(named_files, "FEW_FILES", 50)
        assert sorted(tuple(r) for r in named_files.read_named_files(spark, "file:" + path).collect()) == sorted((f or "", n, c) for f, n, c in rows)


# indented JSON ------------------------------------------------------------------------------------------------

def test_pretty_json_is_pythons(spark):
    rows = [(1, "plain", ["a", "b"], True, (2, [])), (2, 'q"\\/\n\t\x01\x7fé\U0001F600', [], None, (None, [1])), (None, None, None, False, None), (3, "", [None, ""], True, (1, [2, 3]))]
    df = spark.createDataFrame(rows, "id long, text string, toks array<string>, ok boolean, s struct<a: int, b: array<int>>")
    got = [r.value for r in io.pretty_json_text(df).collect()]
    for value, row in zip(got, df.collect()):
        assert value == json.dumps(row.asDict(recursive=True), indent=4)
    two = io.pretty_json_text(df.select("id", F.create_map(F.lit("k"), F.lit(1)).alias("m")), indent=2).first().value
    assert two == json.dumps({"id": 1, "m": {"k": 1}}, indent=2)


# epochs -------------------------------------------------------------------------------------------------------

SCHEMA = "a long, b string, v int"


def _batch(spark, lo, hi):
    return spark.range(lo, hi).select(F.col("id").alias("a"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id"))).alias("b"), F.lit(lo).alias("v"))


def _keys(df):
    return sorted(((r.a, r.b) for r in df.collect()), key=repr)


def test_batches_read_only_epochs_that_may_hold_their_keys(spark, tmp_path):
    path, key = f"file:{tmp_path}/run", ["a", "b"]
    assert epochs.read_rows(spark, path, SCHEMA).count() == 0
    logs = [epochs.run_batch(_batch(spark, 1000 * e, 1000 * e + 1000), e, path, key) for e in range(4)]
    assert [r["epochs"] for r in logs] == [0, 1, 2, 3] and logs[3]["epochs_read"] <= 1          # false positives are rare
    log = epochs.run_batch(_batch(spark, 900, 1100), 4, path, key)              # keys of epochs 0 and 1 only
    assert 2 <= log["epochs_read"] <= 3 and log["files_read"] > 0
    assert epochs.read_rows(spark, path, SCHEMA).count() == 4000
    log = epochs.run_batch(_batch(spark, 3900, 4100).unionByName(_batch(spark, 3900, 4100)), 5, path, key)
    rows = epochs.read_rows(spark, path, SCHEMA)
    assert rows.count() == 4100 and _keys(rows) == _keys(_batch(spark, 0, 4100))


def test_repeated_batch_leaves_the_same_rows(spark, tmp_path):
    path, key = f"file:{tmp_path}/run", ["a", "b"]
    epochs.write_epoch(_batch(spark, 0, 50), path, key, epochs.BEFORE)

    def fail(d):
        raise RuntimeError("killed")
    epochs.run_batch(_batch(spark, 40, 90), 0, path, key)
    with pytest.raises(RuntimeError):
        epochs.run_batch(_batch(spark, 80, 120), 1, path, key, fail)
    # killed after the rows, before the filter of the epoch
    _batch(spark, 80, 100).write.mode("overwrite").parquet(f"{path}/rows/epoch=1")
    for _ in range(2):
        epochs.run_batch(_batch(spark, 80, 120), 1, path, key)
        rows = epochs.read_rows(spark, path, SCHEMA)
        assert rows.count() == 120 and _keys(rows) == _keys(_batch(spark, 0, 120))
    epochs.run_batch(_batch(spark, 0, 0), 2, path, key)
    assert epochs.read_rows(spark, path, SCHEMA).count() == 120


# p-values -----------------------------------------------------------------------------------------------------

def test_two_sided_p(spark):
    zs = [0.0, 1e-9, 0.3, -0.7, 1.0, 1.96, 2.8, 2.83, 3.5, 8.0, 30.0, 60.0, None, float("nan")]
    got = [r.p_value for r in S.two_sided_p(spark.createDataFrame([(z,) for z in zs], "z double")).collect()]
    for z, p in zip(zs, got):
        if z is None or math.isnan(z):
            assert p is None
        else:
            want = min(1.0, math.erfc(z / math.sqrt(2)))
            assert p == pytest.approx(want, rel=1e-9, abs=1e-300)


# complexity ---------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("text, want", [
    (None, 0), ("", 0), ("if (a) { b(); }", 0), ("int x = 1;", 0),
    ("void f() { }", 1), ("class A { int f(int a) { if (a > 1 && a < 3) { return 1; } return a ? 1 : 2; } int g() { while (x) {} } }", 4),
    ('void f() { s = "if (a) { while"; c = \'}\'; c = \'\\\'\'; // for (;;) {\n /* catch ( { && */ for (;;) { } }', 2),
    ("void f() { switch (x) { case 1: case 2: break; } try { } catch (E e) { } } void g() { if (a) {} }", 4),
    ("void f() { if (a) { if (b) {", 3), ("if (x) { } int f(int a) { if (a || b) {} }", 3), ('"unclosed void f() { if (a) { } }', 2),
])
def test_function_complexity(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.function_complexity(F.col("t")).alias("c")).first().c == want
    both = df.select(X.function_complexity_delta(F.col("t"), F.lit("void f() { if (a) { } }")).alias("d")).first().d
    assert both == (abs(want - 2) if want else 0)


def test_long_text_has_no_deep_recursion(spark):
    text = "void f() { " + 's = "' + "x" * 200_000 + '"; /* ' + "y" * 200_000 + " */ " + "if (a) { } " * 2000 + "}"
    assert spark.createDataFrame([(text,)], "t string").select(X.function_complexity(F.col("t")).alias("c")).first().c == 2001

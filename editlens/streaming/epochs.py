"""ST1 by epoch: a resumable run whose batches read only the output that may hold their keys.

Every batch writes its rows to a folder of its own, ``rows/epoch=<id>``, and the Bloom filter of its keys beside it,
``keys/epoch=<id>``: bitmaps of ``BUCKET`` bits, as many as the batch's keys ask for, with ``HASHES`` bits a key. The next
batch looks its keys up in the filters and reads only the epochs that may hold one of them before it drops the keys
already done. A batch that is repeated writes the same folder again, so being killed at any point
leaves the same rows; what it read is logged.

Null key parts are values like any other; repeated keys of a batch are done once (the smallest row by its hash); a batch
without rows leaves empty folders. Filters have no false negatives; false positives cost a read, never a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

#: Bits of a bitmap (fixed by Spark's bitmap functions), bits a key is given, and bits set for it.
BUCKET, BITS, HASHES = 32_768, 12, 4
#: Epoch of rows that were there before the first batch.
BEFORE = -1


def _read(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table at ``path``; no rows where nothing has been written yet."""
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    try:
        return spark.read.schema(kind).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kind)


def _places(key: list[str], size) -> F.Column:
    """(bucket, bit) of each hash of the key among ``size`` buckets."""
    # a null part is skipped by the hash, so whether it is null is hashed with it
    whole = F.struct(*[F.col(c) for c in key], *[F.col(c).isNull() for c in key])
    at = [F.pmod(F.xxhash64(F.lit(i), whole), size * BUCKET) for i in range(HASHES)]
    return F.array(*[F.struct(F.floor(a / BUCKET).alias("bucket"), F.pmod(a, F.lit(BUCKET)).alias("bit")) for a in at])


def write_epoch(rows: DataFrame, path: str, key: list[str], epoch: int) -> None:
    """Write the rows and the filter of one epoch, replacing what a lost run of it has left."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
    made = spark.read.schema(rows.schema).parquet(f"{path}/rows/epoch={epoch}")
    size = max(1, math.ceil(made.count() * BITS / BUCKET))
    bits = made.select(F.explode(_places(key, F.lit(size))).alias("p")).select("p.*")
    maps = bits.groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))
    maps.select("bucket", F.lit(size).alias("size"), "bitmap").write.mode("overwrite").parquet(f"{path}/keys/epoch={epoch}")


def epochs_that_may_hold(keys: DataFrame, path: str, key: list[str], epoch: int) -> DataFrame:
    """(epoch, keys): the epochs other than ``epoch`` whose filters let some key pass, and how many."""
    filters = _read(keys.sparkSession, f"{path}/keys", "bucket long, size int, bitmap binary, epoch long").where(F.col("epoch") != epoch)
    sizes = filters.select("epoch", "size").distinct()              # a row an epoch
    asked = keys.select(*key).distinct().withColumn("__k", F.monotonically_increasing_id()).join(F.broadcast(sizes))
    bits = asked.select("epoch", "__k", F.explode(_places(key, F.col("size"))).alias("p")).select("epoch", "__k", "p.*")
    byte = F.conv(F.hex(F.substring("bitmap", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.expr("getbit(__byte, cast(bit % 8 as int))") == 1
    hits = bits.join(filters.select("epoch", "bucket", "bitmap"), ["epoch", "bucket"]).withColumn("__byte", byte).where(on)
    whole = hits.groupBy("epoch", "__k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == HASHES)
    return whole.groupBy("epoch").agg(F.count(F.lit(1)).alias("keys"))


def run_batch(batch: DataFrame, epoch: int, path: str, key: list[str], transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> dict:
    """Append the rows of ``batch`` whose keys no other epoch has. Returns what was read: epochs, files and rows."""
    spark = batch.sparkSession
    first = F.min_by(F.struct(*batch.columns), F.xxhash64(*batch.columns))
    once = batch.groupBy(*key).agg(first.alias("__r")).select("__r.*").checkpoint()
    found = sorted(r["epoch"] for r in epochs_that_may_hold(once, path, key, epoch).collect())      # a row an epoch
    new, files = once, 0
    if found:
        done = spark.read.parquet(f"{path}/rows").where(F.col("epoch").isin(found)).select(*key)
        files = len(set(spark.read.parquet(*[f"{path}/rows/epoch={e}" for e in found]).inputFiles()))
        same = None
        left, right = once.alias("l"), done.distinct().alias("r")
        for c in key:
            same = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) if same is None else same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        new = left.join(right, same, "left_anti")
    write_epoch(transform(new), path, key, epoch)
    held = _read(spark, f"{path}/keys", "bucket long, size int, bitmap binary, epoch long").where(F.col("epoch") != epoch)
    return {"epoch": epoch, "epochs": held.select("epoch").distinct().count(), "epochs_read": len(found), "files_read": files}


def run_available(spark: SparkSession, input_dir: str, path: str, checkpoint_dir: str, schema: str, key: list[str],
                  transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> list[dict]:
    """Process all input files not yet seen, an epoch a batch; returns the reading log of the batches."""
    log: list[dict] = []

    def batch(df: DataFrame, epoch: int) -> None:
        log.append(run_batch(df, epoch, path, key, transform))

    q = (spark.readStream.schema(schema).parquet(input_dir)
         .writeStream.foreachBatch(batch)
         .option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return log


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of the run, without the epoch."""
    return _read(spark, f"{path}/rows", schema).drop("epoch")

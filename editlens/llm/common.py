"""Helpers shared by the operators: shared scratch folder, written intermediate tables, word splitting."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

#: Word separators of every contract: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder name under the session's shared checkpoint folder. Every operator asks for one before
    its Python code runs, so this is also where the package is sent to the executors."""
    ship_package(spark)
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/editlens-llm/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, and
    the file size tells Spark whether a later join may broadcast it."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the words of ``text`` (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)

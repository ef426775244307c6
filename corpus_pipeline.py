"""Corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``. All stages but the last return the columns of ``documents``.
Stages change texts (failing lines, repeated passages), drop rows (rejected documents, near copies, documents
that the mix leaves out) and repeat rows (sources taken more than once); ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editlens.llm import line_dedup, mixing, packing, quality, simhash
from editlens.llm.common import written
from editlens.session import ensure_checkpoint_dir, read_table


def _columns(df: DataFrame, like: DataFrame, text: str = "text") -> DataFrame:
    out = {"text": F.col(text)} | ({"n_chars": F.length(text).cast(like.schema["n_chars"].dataType)} if "n_chars" in like.columns else {})
    return df.select(*[out[c].alias(c) if c in out else F.col(c) for c in like.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines."""
    return _columns(quality.apply_rules(docs).where("kept"), docs, "clean_text")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without repeated chunks and other runs of two lines or more that stand in an earlier place."""
    return _columns(line_dedup.remove_repeated_chunks(docs), docs, "dedup_text")


def dedup_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that with the smallest id, null ids last (of equal ids, the smallest text hash; of
    rows equal in both, one)."""
    key = ["__none", "__id", "__hash"]
    keyed = docs.withColumns({"__none": F.col("doc_id").isNull(), "__id": F.col("doc_id"),
                              "__hash": F.coalesce(F.sha2("text", 256), F.lit(""))})
    found = simhash.near_duplicates(keyed.select(F.struct(*key).alias("__key"), "text"), "__key")
    stay = written(found.where(F.col("__key").eqNullSafe(F.col("component_id"))).select("__key.*").distinct(), "stay")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in key]
    first = keyed.alias("d").join(stay.hint("merge").alias("s"), same[0] & same[1] & same[2], "left_semi")
    return first.dropDuplicates(key).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mixing.mix(docs)
    return mixed.withColumn("__n", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", dedup_lines), ("SimHash near-dedup", dedup_simhash),
          ("mixing", mix_sources), ("packing", pack_sequences)]

#: SQL can't tokenize (stage 5) nor hash with XXH64 (stage 3); tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, "stage")
    return docs

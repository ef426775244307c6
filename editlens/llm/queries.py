"""Registered queries of the training-data operators, and their DuckDB oracles where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, read_table, ship_package
from . import (bpe, embedding_dedup, filter_audit, line_dedup, mixing, packing, quality, simhash, spelling, suffix_dedup, token_store,
               toxicity, warc)
from .oracles import EMBEDDING, FILTER_AUDIT, LINE_DEDUP, MIXING, QUALITY, SPELLING, WARC

QUERIES, ORACLE = {}, {}


def query(name: str, table: str, oracle: str | None = None):
    def deco(fn):
        def job(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            return fn(read_table(spark, sf_dir, table), lambda t: read_table(spark, sf_dir, t))
        QUERIES[name] = job
        if oracle:
            ORACLE[name] = oracle
        return fn
    return deco


@query("op1_line_dedup", "documents", LINE_DEDUP)
def op1(docs, _):
    return line_dedup.remove_repeated_chunks(docs).select(
        "doc_id", "n_lines", "n_removed_lines", "n_removed_chunks",
        F.sha2("dedup_text", 256).alias("kept_sha256"))


@query("op1_line_passages", "documents")
def op1_passages(docs, _):
    return line_dedup.remove_repeated_passages(docs).select(
        "doc_id", "n_lines", "n_removed_lines", "n_removed_passages",
        F.sha2("dedup_text", 256).alias("kept_sha256"))


@query("op2_packing", "documents")
def op2(docs, _):
    return packing.pack(docs.select("doc_id", "text"))


@query("op3_toxicity", "documents")
def op3(docs, table):
    docs = docs.select("doc_id", "text")
    return toxicity.score(docs, toxicity.learn(docs, table("labels").select("doc_id", "toxic")))


@query("op4_simhash", "documents")
def op4(docs, _):
    return simhash.near_duplicates(docs.select("doc_id", "text"))


@query("op5_suffix_dedup", "documents")
def op5(docs, _):
    # the remaining text as a further column, so that a reader sees what was removed
    kept = suffix_dedup.remove_repeats(docs.select("doc_id", "text"), with_text=True)
    return kept.withColumn("kept_text", F.make_valid_utf8(F.col("kept_text").cast("string")))


@query("op6_embedding_dedup", "embeddings", EMBEDDING)
def op6(vectors, _):
    return embedding_dedup.near_duplicates(vectors.select("vec_id", "embedding"))


@query("op7_warc", "pages", WARC)
def op7(pages, _):
    return warc.round_trip(pages)


@query("op8_quality_rules", "documents", QUALITY)
def op8(docs, _):
    return quality.apply_rules(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_failed_lines", "lost_chars")


@query("op9_token_store", "documents")
def op9(docs, _):
    return token_store.round_trip(docs)


@query("op10_mixing", "documents", MIXING)
def op10(docs, _):
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op11_spelling_variants", "documents", SPELLING)
def op11(docs, _):
    return spelling.group_variants(spelling.vocabulary(docs, misspell=31))


@query("op12_bpe", "documents")
def op12(docs, _):
    ship_package(docs.sparkSession)
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "text")))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op13_filter_audit", "documents", FILTER_AUDIT)
def op13(docs, table):
    ship_package(docs.sparkSession)
    return filter_audit.audit_texts(docs, table("labels"))

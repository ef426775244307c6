"""Domain views derived from the shared test tables.

The reference ships no data, so every job here reads the TPC-H-like tables
under ``sf_dir`` and derives the edit-pair shaped inputs from them (see
FIXTURES.md). Each builder is a pure DataFrame transformation, so the views
grow with the tables and every downstream job runs over the whole input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import read_table

KEY = ["sample_id", "index"]


class Tables:
    """Lazy accessor for the base parquet tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)


def samples(conversations: DataFrame) -> DataFrame:
    """fx_samples: source / reference / hypothesis token lists per edit pair.

    The reference tokens are the whole conversation text (FIXTURES.md caps them at
    24 tokens; here no text is cut). ``hyp_toks`` equals the reference when
    ``pmod(conv_id, 4) = 0`` so that exact matches occur; otherwise every 7th token
    is replaced; ``src_toks`` drops every 5th token.
    """
    base = conversations.select(
        "conv_id", "turn", "role",
        F.expr("split(regexp_replace(text, '[^A-Za-z0-9.,]+', ' '), ' ')").alias("ref_toks"),
    )
    return base.select(
        F.col("conv_id").alias("sample_id"),
        F.col("turn").alias("index"),
        "role",
        F.expr("pmod(conv_id, 3)").alias("level"),
        "ref_toks",
        F.expr("filter(ref_toks, (x, i) -> (i + 1) % 5 <> 0)").alias("src_toks"),
        F.expr("if(pmod(conv_id, 4) = 0, ref_toks, "
               "transform(ref_toks, (x, i) -> if((i + 1) % 7 = 0, 'x', x)))").alias("hyp_toks"),
    )


def edit_seq(samples_df: DataFrame) -> DataFrame:
    """fx_edit_seq: long-form edit sequence (k, pos, src, dst, op) with ``<con>`` glue."""
    exploded = samples_df.select(
        *KEY, F.size("ref_toks").alias("n"), F.posexplode("ref_toks").alias("p0", "t"))
    p = F.col("p0") + 1
    con = (p % 11 == 0)
    src = (F.when(con, "<con>").when(p % 5 == 0, F.col("t")).when(p % 7 == 0, F.col("t"))
           .when(p % 6 == 0, "").otherwise(F.col("t")))
    dst = (F.when(con, "<con>").when(p % 5 == 0, "").when(p % 7 == 0, "x").otherwise(F.col("t")))
    op = (F.when(con, "equal").when(p % 5 == 0, "delete").when(p % 7 == 0, "replace")
          .when(p % 6 == 0, "insert").otherwise("equal"))
    return (exploded.where(~(con & (p == F.col("n"))))
            .select(*KEY, p.cast("bigint").alias("pos"), src.alias("src"), dst.alias("dst"), op.alias("op")))


FEATURE_SQL = """
  cast(count(*) as double) as NMT, cast(sum(l_quantity) as double) as NMS,
  cast(max(l_quantity) as double) as NML, cast(count(distinct l_partkey) as double) as NMC,
  cast(min(l_quantity) as double) as NNTRP, cast(count(distinct l_suppkey) as double) as NNSRP,
  cast(max(l_partkey) % 7 as double) as NTOD, cast(max(l_suppkey) % 5 as double) as NSOD,
  cast(round(max(l_discount) * 100) as double) as CC_delta,
  cast(round(max(l_tax) * 100) as double) as delta_dependency,
  round((max(l_partkey) % 1000) / 1000.0e0, 5) as sim_cocom,
  cast(max(l_partkey) % 13 as double) as codeChangeNum,
  cast(max(l_suppkey) % 17 as double) as codeChangeScore,
  cast(max(l_partkey) % 3 as double) as refactoringTypeNum
"""


#: Mean number of lines of a partition: at most and, while there are shuffle partitions left, at least.
LINES, FEW_LINES = 500_000, 10_000


def _by_key(lines: DataFrame) -> DataFrame:
    """Rows shuffled by key to as many partitions as their number asks for; a table of one partition's rows is left to AQE."""
    rows = lines.count()                    # from the files' footers
    if rows <= LINES:
        return lines.repartition(*KEY)
    spread = min(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // FEW_LINES)
    return lines.repartition(max(spread, -(-rows // LINES)), *KEY)


def features(lineitem: DataFrame) -> DataFrame:
    """fx_features (``FEATURE_SQL``): 14 change features per key.

    Keys hardly repeat, so rows are shuffled once, as the seven columns read; all aggregation runs behind that shuffle. The two
    distinct counts come from two rows a line, one for its part and one for its supplier: first one row a key, kind
    and value, then one a key. Both tables hold nearly every line, so the number of partitions follows the number of
    lines: a task's tables stay in memory however many lines there are.
    """
    line = _by_key(lineitem.select(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").cast("bigint").alias("index"),
                                   "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"))
    part = F.col("is_part")
    by_value = (line.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("is_part"))
                .groupBy(*KEY, "is_part", F.when(part, F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("v"))
                .agg(F.count(F.when(part, 1)).alias("n"), F.sum(F.when(part, F.col("l_quantity"))).alias("q"),
                     F.max("l_quantity").alias("q_max"), F.min("l_quantity").alias("q_min"),
                     F.max("l_discount").alias("discount"), F.max("l_tax").alias("tax")))
    parts, supps = F.when(part, F.col("v")), F.when(~part, F.col("v"))
    d = by_value.groupBy(*KEY).agg(
        F.sum("n").alias("n"), F.sum("q").alias("q"), F.max("q_max").alias("q_max"), F.min("q_min").alias("q_min"),
        F.max("discount").alias("discount"), F.max("tax").alias("tax"), F.count(parts).alias("n_part"), F.count(supps).alias("n_supp"),
        F.max(parts).alias("part"), F.max(supps).alias("supp"))
    exprs = {"NMT": "n", "NMS": "q", "NML": "q_max", "NMC": "n_part", "NNTRP": "q_min", "NNSRP": "n_supp", "NTOD": "part % 7",
             "NSOD": "supp % 5", "CC_delta": "round(discount * 100)", "delta_dependency": "round(tax * 100)",
             "sim_cocom": "round((part % 1000) / 1000.0e0, 5)", "codeChangeNum": "part % 13", "codeChangeScore": "supp % 17",
             "refactoringTypeNum": "part % 3"}
    return d.select(*KEY, *[F.expr(f"cast({e} as double)").alias(name) for name, e in exprs.items()])


def predictions(features_df: DataFrame) -> DataFrame:
    """fx_predictions: truth, predicted class and 3 class probabilities."""
    y = F.col("refactoringTypeNum").cast("int")
    d = features_df.select(*KEY, y.alias("y"))
    d = d.withColumn("yhat", F.when((F.col("sample_id") + F.col("index")) % 5 == 0,
                                    (F.col("y") + 1) % 3).otherwise(F.col("y")))
    w = [F.lit(1.0) + F.when(F.col("yhat") == c, 3).otherwise(0) + (F.col("sample_id") * 7 + off) % 5
         for c, off in ((0, 0), (1, 3), (2, 6))]
    tot = w[0] + w[1] + w[2]
    return d.select(*KEY, "y", "yhat", *[(w[c] / tot).alias(f"p{c}") for c in range(3)])


def vectors(embeddings: DataFrame) -> DataFrame:
    """fx_vectors: dual (old/new) vectors per corpus item, level and query flag."""
    return embeddings.select(
        "vec_id",
        F.expr("vec_id div 3").alias("sample_id"),
        (F.col("vec_id") % 3).alias("index"),
        (F.col("label") % 3).alias("level"),
        (F.col("vec_id") % 25 == 0).alias("is_query"),
        F.expr("transform(slice(embedding, 1, 32), x -> cast(x as double))").alias("old_vec"),
        F.expr("transform(slice(embedding, 33, 32), x -> cast(x as double))").alias("new_vec"),
    )


def changes(events: DataFrame) -> DataFrame:
    """fx_changes: change-type triples (type, significance, 'prefix : content')."""
    return events.select(
        F.col("user_id").alias("sample_id"),
        F.dayofmonth("ts").cast("bigint").alias("index"),
        "event_id",
        F.col("event_type").alias("change_type"),
        F.expr("case when event_id % 4 = 0 then 'NONE' when event_id % 4 = 1 then 'LOW' else 'HIGH' end")
        .alias("significance"),
        F.concat(F.lit("K"), (F.col("event_id") % 5).cast("string"), F.lit(" : "), F.col("props")).alias("content"),
    )


def raters(labels: DataFrame) -> DataFrame:
    """fx_raters: one gold label and three raters per item."""
    return labels.select(
        F.col("doc_id").alias("item_id"),
        F.expr("case when doc_id % 6 = 0 then 0 when toxic = 1 then 2 else quality end").alias("label"),
        F.expr("case when toxic = 1 then 2 else quality end").alias("a"),
        F.expr("case when doc_id % 5 = 0 then 1 - quality when toxic = 1 then 2 else quality end").alias("b"),
        F.expr("case when doc_id % 7 = 0 then 2 else quality end").alias("c"),
    )

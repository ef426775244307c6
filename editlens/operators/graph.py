"""Def-use graph table operators (G1-G5), re-aimed from the AST walkers.

Input: a token table ``(key, idx, line, token)`` and an edge table
``(key, var, idx, rel, from_vars, from_idxs)``; the parser that produces them is
not part of this library. All steps are joins / grouped aggregates on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["sample_id", "index"]


def last_definition_edges(tokens: DataFrame, key=KEY) -> DataFrame:
    """``comesFrom`` edge from each occurrence of a variable to its previous
    occurrence in token order (no parent for the first one)."""
    w = Window.partitionBy(*key, "token").orderBy("idx")
    prev = F.lag("idx").over(w)
    d = tokens.select(*key, F.col("token").alias("var"), "idx", prev.alias("__p"))
    return d.select(*key, "var", "idx", F.lit("comesFrom").alias("rel"),
                    F.when(F.col("__p").isNull(), F.array().cast("array<string>"))
                    .otherwise(F.array("var")).alias("from_vars"),
                    F.when(F.col("__p").isNull(), F.array().cast("array<bigint>"))
                    .otherwise(F.array(F.col("__p").cast("bigint"))).alias("from_idxs"))


def connected_edges(edges: DataFrame, key=KEY) -> DataFrame:
    """G1: keep edges whose node has a parent or is a parent of another node."""
    has_parent = edges.where(F.size("from_idxs") > 0).select(*key, "idx")
    parents = edges.select(*key, F.explode("from_idxs").alias("idx"))
    nodes = has_parent.unionByName(parents).distinct()
    return edges.join(nodes, [*key, "idx"], "left_semi")


def merge_duplicate_edges(edges: DataFrame, key=KEY) -> DataFrame:
    """One edge per (var, idx, rel) with the sorted union of parents."""
    return edges.groupBy(*key, "var", "idx", "rel").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("from_vars")))).alias("from_vars"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("from_idxs")))).alias("from_idxs"))


def merge_branch_states(states: DataFrame, key=KEY) -> DataFrame:
    """Per variable the sorted set of last-definition positions over branches."""
    return states.groupBy(*key, "var").agg(F.array_sort(F.collect_set("idx")).alias("defs"))


def subcode_input(tokens: DataFrame, edges: DataFrame, key=KEY) -> DataFrame:
    """``"[CLS]" + lines touched by the kept nodes (line order) + "[SEP]" + vars``.

    The variable list is rendered like the reference (list repr with commas turned
    into spaces and quotes removed): ``[a  b  c]``."""
    lines = (tokens.groupBy(*key, "line")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "token"))),
                                           lambda x: x["token"]), " ").alias("text")))
    node_lines = (edges.select(*key, "idx").join(tokens.select(*key, "idx", "line"), [*key, "idx"])
                  .select(*key, "line").distinct())
    code = (lines.join(node_lines, [*key, "line"], "left_semi")
            .groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))),
                                                        lambda x: x["text"]), "\n").alias("code")))
    vars_ = (edges.groupBy(*key)
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "var"))),
                              lambda x: F.replace(x["var"], F.lit(","), F.lit(" "))).alias("vars")))
    keys = tokens.select(*key).distinct()
    j = keys.join(code, key, "left").join(vars_, key, "left")
    var_str = F.concat(F.lit("["), F.array_join(F.coalesce("vars", F.array().cast("array<string>")), "  "),
                       F.lit("]"))
    return j.select(*key, F.concat(F.lit("[CLS]"), F.coalesce("code", F.lit("")), F.lit("[SEP]"),
                                   F.replace(var_str, F.lit("'"), F.lit(""))).alias("input"))

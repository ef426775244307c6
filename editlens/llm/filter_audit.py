"""Audit of how filters interact: what each would remove in every order of application.

Spark counts documents by part and failure mask (one bit a filter). The at most 2^k masks of a part make a decision diagram:
a level for each filter, a low edge where a document passes and a high edge where it fails, equal subdiagrams
shared, empty ones suppressed, and at each node the counts of documents below it. From one order of filters to the next
two adjacent levels are swapped, which touches only the nodes above and at these levels; plain changes lead through all
orders that way. The path of low edges from the root is what an order keeps, the high edges leaving it are what each
step removes.

Defined cases: null texts are empty and null parts are the empty string; a filter whose verdict is null passes; rows with a null id
never fail the filter of repeated texts and make no other row fail it, nor do rows of one id among each other; repeated label
rows of an id count once, by their largest values; texts of any length are read whole; the result has its own columns only, so extra columns of any name are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that need the text alone."""
    ws, t = words(text), F.coalesce(text, F.lit(""))
    return {"A": F.size(ws) < 50,
            "B": 100 * F.size(F.array_distinct(ws)) < 65 * F.size(ws),
            "C": 100 * F.regexp_count(t, F.lit("[A-Z]")) > 5 * F.length(t),
            "D": t.rlike(r"[#$%&*|]")}


def failure_cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], doc_id: str = "doc_id", text: str = "text",
                  part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failure mask. Bit i of the mask is the i-th of ``filters``; the
    bit after the last says that a smaller id has the same text. Texts meet by their SHA-256, only hashes are
    shuffled, and copies are counted before the shuffle, so a crowd of copies is no hot task."""
    bit = [F.coalesce(f, F.lit(False)).cast("int") * (1 << i) for i, f in enumerate(filters.values())]
    mask = sum(bit[1:], bit[0]) if bit else F.lit(0)
    slim = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"),
                       F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("sha"))
    known = labels.groupBy(F.col(doc_id).alias("id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    rows = slim.groupBy("id", "part", "mask", "sha").agg(F.count(F.lit(1)).alias("n")).join(known, "id", "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # of each kind of copies: all, those without an id, and the smallest id with its rows
    kinds = rows.groupBy("sha", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"))
    lowest = kinds.groupBy("sha").agg(F.min("first.id").alias("lowest"))
    own = F.col("no_id") + F.when(F.col("first.id") == F.col("lowest"), F.col("first.n")).otherwise(0)
    repeated = 1 << len(filters)
    split = F.explode(F.array(F.struct(F.col("mask"), own.alias("n")),
                              F.struct((F.col("mask") + repeated).alias("mask"), (F.col("n") - own).alias("n"))))
    cells = kinds.join(lowest, "sha").select("part", "good", "toxic", split.alias("c")).select("part", "good", "toxic", "c.*").where("n > 0")
    return cells.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c) for c in ("good", "toxic")])


class Diagram:
    """Shared, zero-suppressed decision diagrams with counts. Node 0 is empty; the others are terminals (counts alone) or have
    (variable, low, high)."""

    def __init__(self):
        self.node = [(None, 0, 0)]
        self.counts = [(0, 0, 0)]
        self.number: dict[tuple, int] = {}

    def _add(self, key: tuple, node: tuple, counts: tuple) -> int:
        if key not in self.number:
            self.number[key] = len(self.node)
            self.node.append(node)
            self.counts.append(counts)
        return self.number[key]

    def terminal(self, counts: tuple[int, int, int]) -> int:
        return self._add(("end", counts), (None, 0, 0), counts) if any(counts) else 0

    def make(self, variable: int, low: int, high: int) -> int:
        if low == high == 0:
            return 0
        total = tuple(a + b for a, b in zip(self.counts[low], self.counts[high]))
        return self._add((variable, low, high), (variable, low, high), total)

    def build(self, cells: dict[int, tuple[int, int, int]], n: int, level: int = 0) -> int:
        """Diagram of counts by mask, variables in ascending order."""
        if not cells:
            return 0
        if level == n:
            return self.terminal(cells[next(iter(cells))])
        side = [{m: c for m, c in cells.items() if m >> level & 1 == s} for s in (0, 1)]
        return self.make(level, self.build(side[0], n, level + 1), self.build(side[1], n, level + 1))

    def swap(self, root: int, level: int, order: list[int]) -> int:
        """The same counts with the variables at ``level`` and below it exchanged."""
        x, y = order[level:level + 2]
        done: dict[int, int] = {0: 0}

        def of(node: int, depth: int) -> int:
            if node not in done:
                v, low, high = self.node[node]
                if depth < level:
                    done[node] = self.make(v, of(low, depth + 1), of(high, depth + 1))
                else:
                    (_, a, b), (_, c, d) = self.node[low], self.node[high]
                    done[node] = self.make(y, self.make(x, a, c), self.make(x, b, d))
            return done[node]
        return of(root, 0)

    def path(self, root: int, n: int) -> list[tuple[tuple, tuple, int]]:
        """At each level of the all-pass path: the counts that go on, those that leave, and how many of these pass all later levels."""
        out = []
        for _ in range(n):
            _, low, high = self.node[root]
            alone = high
            while self.node[alone][0] is not None:
                alone = self.node[alone][1]
            out.append((self.counts[low], self.counts[high], self.counts[alone][0]))
            root = low
        return out


def plain_changes(n: int) -> Iterator[int]:
    """Places of the adjacent exchanges that lead through all orders of ``n`` things."""
    if n < 2:
        return
    inner = plain_changes(n - 1)
    while True:
        yield from range(n - 2, -1, -1)             # the last thing moves to the front
        if (k := next(inner, None)) is None:
            return
        yield k + 1
        yield from range(n - 1)                     # and back to the end
        if (k := next(inner, None)) is None:
            return
        yield k


def all_orders(cells: dict[int, tuple[int, int, int]], letters: str) -> list[tuple]:
    """(order, step, *COUNTS) for every order of the filters."""
    n = len(letters)
    diagram = Diagram()
    root, order = diagram.build(cells, n), list(range(n))
    paths = {}
    changes = plain_changes(n)
    while True:
        paths[tuple(order)] = diagram.path(root, n)
        if (k := next(changes, None)) is None:
            break
        root = diagram.swap(root, k, order)
        order[k], order[k + 1] = order[k + 1], order[k]
    fails = {p[0]: path[0][1][0] for p, path in paths.items()}          # what a filter removes as the first
    shapley = dict.fromkeys(range(n), 0)
    for p, path in paths.items():
        for v, (_, gone, _) in zip(p, path):
            shapley[v] += gone[0]
    return [("".join(letters[v] for v in p), step, on[0], gone[0], fails[v] - gone[0], alone, gone[1], gone[2], shapley[v])
            for p, path in paths.items() for step, (v, (on, gone, alone)) in enumerate(zip(p, path), 1)]


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """``cells`` (part, mask, n, good, toxic) -> a row for each part, order of the filters and step. One task holds
    the at most 2^k rows of a part at a time."""
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cell = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(rows["mask"], rows["n"], rows["good"], rows["toxic"])}
        out = pd.DataFrame(all_orders(cell, letters), columns=["filter_order", "step", *COUNTS])
        out.insert(0, "part", rows["part"].iloc[0])
        return out
    return cells.groupBy("part").applyInPandas(run, schema)


def audit_texts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Audit of the five text filters; the last, E, is that of repeated texts."""
    filters = text_filters(F.col(text))
    return audit(failure_cells(docs, labels, filters, doc_id, text, part), "".join(filters) + "E")

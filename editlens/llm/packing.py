"""Sequence packing as a cutting-stock problem solved by column generation.

A document (its ids and an end id) is cut into full sequences and one rest. Rests are the items: their
lengths form a histogram of a few hundred classes (``class_widths``: one id wide for short rests, at most 1/64 of the
length for others), all that the driver ever sees. A linear program over patterns (how many items of each class
one sequence takes) minimises the number of sequences, whose room is counted in ids; a knapsack dynamic
program prices new patterns until none improves. Patterns are rounded down; what remains is packed first-fit decreasing over the histogram. Items
are ranked within their class by salted groups (no class, however hot, is one task) and the rank says
which sequence and slot an item takes, by a join with the plan (at most a few rows for each class).

Defined cases: null and empty texts are the end id alone; repeated rows are packed as often as they occur
(rows with equal id and place are told apart by their order); an empty table gives no rows; extra columns
pass through to every piece, result names are replaced. A sequence is padded to ``max_len`` unless its length
is a power of two.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .tokens import documents, public_path

#: Rests of up to so many ids have classes of their own; above, a class is 1/64 of its length wide.
FINE = 128
#: The linear program ends this near to its optimum.
GAP = 1e-3
#: Bytes of the encoder's cache in a worker: less than op9's, as the pipeline's executors hold other stages' memory.
CACHE_BYTES = 48 << 20
RESULTS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
#: Rows that one ranking group holds at least on average (the square root of its class if that is more).
GROUP = 500


def pieces(df: DataFrame, text: str, max_len: int, path: str, end_id: int) -> DataFrame:
    """All columns of ``df`` but the text, for each piece of a document: start, length, ids_crc32, doc_tokens."""
    cols = [c for c in df.columns if c != text and c not in RESULTS]
    extra = [T.StructField(c, T.LongType()) for c in RESULTS[:4]]
    schema = T.StructType([df.schema[c] for c in cols] + extra)

    def run(batches):
        for batch in batches:
            for part, ids, off in documents(batch, text, path, end_id, CACHE_BYTES):
                row, start, length, crc = [], [], [], []
                for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                    for lo in range(a, b, max_len):
                        hi = min(b, lo + max_len)
                        row.append(i)
                        start.append(lo - a)
                        length.append(hi - lo)
                        crc.append(zlib.crc32(ids[lo:hi].tobytes()))
                take = pa.array(row, pa.int64())
                n = np.diff(off)[row] if row else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).take(take) for c in cols] + [pa.array(x, pa.int64()) for x in (start, length, crc, n)],
                    names=[*cols, *RESULTS[:4]])
    return df.select(*cols, text).mapInArrow(run, schema)


def class_widths(max_len: int) -> np.ndarray:
    """Length of the longest item of each class, ascending; the last class ends at ``max_len``."""
    out, n = [], 0
    while n < max_len:
        n = min(max_len, n + (1 if n < FINE else 1 << (n.bit_length() - 7)))
        out.append(n)
    return np.array(out)


def _knapsack(price: np.ndarray, widths: np.ndarray, room: int) -> tuple[float, list[np.ndarray]]:
    """Worth of the best pattern of items of the given widths, and for each class the best pattern that holds
    it, if that improves on the plan."""
    classes = np.flatnonzero(price > 1e-9)
    worth, width = price[classes], widths[classes]
    fits = np.searchsorted(width, np.arange(room + 1), side="right").tolist()
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        k = fits[c]
        if k:
            v = best[c - width[:k]] + worth[:k]
            i = v.argmax()
            if v[i] > best[c]:
                best[c], last[c] = v[i], classes[i]
    found = []
    for k in classes[worth + best[room - width] > 1 + GAP].tolist():
        pattern, c = np.zeros(len(widths), np.int64), int(room - widths[k])
        pattern[k] = 1
        while c > 0:
            if last[c] >= 0:
                pattern[last[c]] += 1
                c -= int(widths[last[c]])
            else:
                c -= 1
        found.append(pattern)
    return float(best[room]), found


def first_fit(left: np.ndarray, widths: np.ndarray, room: int) -> list[tuple[int, np.ndarray]]:
    """First-fit decreasing over a histogram, whole runs of equal sequences at a time."""
    plan, left = [], left.copy()
    while left.any():
        p, free = np.zeros(len(widths), np.int64), room
        for c in np.flatnonzero(left)[::-1]:
            k = min(int(left[c]), free // int(widths[c]))
            if k:
                p[c] += k
                free -= k * int(widths[c])
        use = p > 0
        times = int((left[use] // p[use]).min())
        plan.append((times, p))
        left = left - times * p
    return plan


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` in this thread: waking a pool of threads costs more than these small products."""
    return np.einsum("ij,j->i", a, b)


def _inverse(a: np.ndarray) -> np.ndarray:
    """Inverse by Gauss-Jordan steps with row exchange, in this thread: LAPACK's pool of threads can wait for
    ever in a process that has started a Spark session."""
    n = len(a)
    both = np.concatenate([a, np.eye(n)], axis=1)
    for i in range(n):
        p = i + int(np.abs(both[i:, i]).argmax())
        both[[i, p]] = both[[p, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0
        both -= np.multiply.outer(factor, both[i])
    return both[:, n:]


def solve(demand: np.ndarray, widths: np.ndarray, room: int, max_rounds: int = 200) -> list[tuple[int, np.ndarray]]:
    """(times, pattern) pairs that cover ``demand``, the items of each class, in sequences of ``room`` ids.

    A revised simplex holds the inverse of the basis. It enters the best pattern of the pool while one improves, then
    the knapsack adds new ones, until even the best of all patterns is within ``GAP``."""
    left = demand.astype(np.int64).copy()
    greedy, plan = first_fit(left, widths, room), []
    active = np.flatnonzero(demand)
    if len(active):
        m = len(active)
        basis = np.zeros((m, len(widths)), np.int64)
        basis[np.arange(m), active] = room // widths[active]
        inv = np.diag(1.0 / basis[np.arange(m), active])    # columns of the basis matrix are patterns
        # demands apart by a trace: no ties, so the simplex can't go round in circles
        need = demand[active] * (1 + 1e-6 * np.random.default_rng(0).random(m))
        x = _times(inv, need)
        pool, total = np.array([p for _, p in greedy], float), np.inf
        for _ in range(max_rounds):
            columns = pool[:, active]
            for turn in range(4 * m + 100):
                value = _times(columns, inv.sum(axis=0))
                k = int(value.argmax())
                if value[k] <= 1 + GAP / 2:
                    break
                d = _times(inv, columns[k])
                ok = d > 1e-9
                ratio = np.full(m, np.inf)
                ratio[ok] = np.maximum(x[ok], 0) / d[ok]
                r = int(ratio.argmin())
                x = x - ratio[r] * d
                x[r] = ratio[r]
                row = inv[r] / d[r]
                inv -= np.multiply.outer(d, row)
                inv[r] = row
                basis[r] = pool[k]
                if turn % 200 == 199:                        # renew the inverse: no drift of rounding
                    inv = _inverse(basis[:, active].T.astype(float))
                    x = _times(inv, need)
            if x.sum() > total * (1 - 1e-5):                # a round that gained nothing
                break
            total = x.sum()
            price = np.zeros(len(widths))
            price[active] = inv.sum(axis=0)
            best, found = _knapsack(price, widths, room)
            if best <= 1 + GAP or not found:                # the optimum is at least sum(x) / best
                break
            pool = np.concatenate([basis, np.array(found)]).astype(float)
        for r in np.argsort(-x):
            p = basis[r]
            use = p > 0
            times = min(int(np.floor(x[r] + 1e-9)), int((left[use] // p[use]).min()))
            if times > 0:
                plan.append((times, p.copy()))
                left = left - times * p
    plan += first_fit(left, widths, room)
    return min(plan, greedy, key=lambda p: sum(t for t, _ in p))


def plan_rows(plan: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class number, first rank, end rank, items per sequence, first sequence, first slot) of each pattern and class."""
    rows, used, seq = [], {}, 0
    for times, p in plan:
        slot = 0
        for c in np.flatnonzero(p)[::-1].tolist():
            k, lo = int(p[c]), used.get(c, 0)
            rows.append((c, lo, lo + times * k, k, seq, slot))
            used[c] = lo + times * k
            slot += k
        seq += times
    return rows


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_len: int = 4096,
         path: str | None = None, end_id: int = 2) -> DataFrame:
    """Pieces of every document with their sequence and place in it."""
    spark = df.sparkSession
    cols = [c for c in df.columns if c != text and c not in RESULTS]
    widths = class_widths(max_len)
    cut = written(pieces(df, text, max_len, path or public_path(), end_id), "pack-pieces")
    demand = np.zeros(len(widths), np.int64)
    for r in cut.groupBy("length").count().collect():       # at most a row for each of 1..max_len
        demand[np.searchsorted(widths, r["length"])] += r["count"]
    salts = spark.createDataFrame([(c, max(1, int(n / max(GROUP, n ** 0.5)))) for c, n in enumerate(demand.tolist())],
                                  "__sc int, __n_salts long")
    rows = plan_rows(solve(demand, widths, max_len))
    plan = spark.createDataFrame(rows or [(-1, 0, 0, 1, 0, 0)],
                                 "__pc int, __lo long, __hi long, __per long, __seq long, __first long")
    # salts and plan have at most a few rows for each class, whatever the input
    by_length = F.broadcast(spark.createDataFrame([(n, int(np.searchsorted(widths, n))) for n in range(1, max_len + 1)],
                                                  "__n long, __class int").join(salts, F.col("__class") == F.col("__sc")))
    order = [F.col(doc_id), "start", "ids_crc32"]
    keyed = cut.join(by_length, F.col("length") == F.col("__n")).withColumn(
        "__salt", F.pmod(F.xxhash64(*order), F.col("__n_salts")))
    in_group = Window.partitionBy("__class", "__salt").orderBy(*order)
    before = Window.partitionBy("__class").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (keyed.groupBy("__class", "__salt").agg(F.count(F.lit(1)).alias("__in"))
               .withColumn("__before", F.coalesce(F.sum("__in").over(before), F.lit(0))).drop("__in"))
    ranked = (keyed.withColumn("__rank", F.row_number().over(in_group) - 1)
              .join(offsets, ["__class", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__before")))
    placed = ranked.join(F.broadcast(plan), (F.col("__class") == F.col("__pc")) & (F.col("__rank") >= F.col("__lo"))
                         & (F.col("__rank") < F.col("__hi")))
    nth = F.col("__rank") - F.col("__lo")
    placed = placed.withColumns({"sequence_id": (F.col("__seq") + F.floor(nth / F.col("__per"))).cast("long"),
                                 "__slot": F.col("__first") + nth % F.col("__per")})
    filled = Window.partitionBy("sequence_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*cols, *RESULTS[:4], "sequence_id",
                         F.coalesce(F.sum("length").over(filled), F.lit(0)).alias("offset"))

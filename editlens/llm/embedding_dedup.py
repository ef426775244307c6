"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= ``min_cos`` are at most ``sqrt(2 - 2 min_cos)`` apart. They are rotated (one random
orthogonal matrix for each dimension, from a fixed seed) so that no block of coordinates is special, and cut into
low-dimensional blocks. Of a close pair, at least one block is within its share of the squared distance, the share
being proportional to the block's dimensions. So each block is joined by itself on that range, and whatever any
block finds is verified exactly on the full vectors in double precision.

The range join of a block lays a grid over its first ``GRID_DIMS`` coordinates (cells ``CELL`` radii wide) and
sends a vector to its own cell and, where it lies within the radius of the upper side, to the next one: a pair
meets in the cell that holds the larger coordinate in each dimension, and is looked at there only. Cells
with more than ``CELL_ROWS`` vectors are cut into chunks by hash: into ``CHUNKS`` at most, and beyond that only as many as chunks of ``HELD_ROWS``
need, since a vector is sent to every task of its cell that compares it. A task holds one chunk; half of the other
chunks stream past it in batches, so that any two chunks meet in one task. Vectors are sent once, by the shuffle that deals them, and
are not stored beside it (cells are counted beforehand, without vectors). Within a task, vectors are dealt to leaves of ``LEAF`` by medians of all the block's
coordinates, and a leaf is compared only with vectors whose distance to its box is within the radius (the radius is nearly
a coordinate's spread, so cells alone part few pairs). A pair that several blocks find counts in the first of them.

Equal vectors are one class, counted before the shuffle; a task returns, for each class, its number of links and one
link to its local root, never pairs.

Defined cases: vectors that are null, empty, zero, or hold a null or a non-finite component link with nothing and are kept;
vectors of different length never link; rows that repeat an id are vectors of their own; null ids count as links of
others, and have no component but that of the ids they link with (null if none); extra columns pass through, result
names are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components, local_roots

RESULTS = ("n_links", "component_id", "kept")
BLOCK_DIMS, GRID_DIMS, CELL, CELL_ROWS, SEED = 8, 3, 2.0, 8192, 7
#: Chunks of a cell that are cut to share work, and vectors of a chunk at most (on average).
CHUNKS, HELD_ROWS = 4, 1 << 16
#: Vectors that a leaf is compared with at a time, and rows of a result's batch.
SLICE, OUT_ROWS = 1 << 14, 1 << 16
#: Candidates that are verified at a time.
AT_ONCE = 1 << 17
#: Vectors of a leaf.
LEAF = 64


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int) -> list[slice]:
    n = max(1, round(dim / BLOCK_DIMS))
    cut = [dim * i // n for i in range(n + 1)]
    return [slice(a, b) for a, b in zip(cut, cut[1:])]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square overflows."""
    big = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return big / np.sqrt((big * big).sum(axis=1, keepdims=True))


def _radii(dim: int, min_cos: float) -> tuple[list[slice], np.ndarray]:
    parts = blocks(dim)
    limit = max(0.0, 2 - 2 * min_cos) * (1 + 1e-9) + 1e-12          # rounding never loses a pair
    return parts, np.array([limit * (p.stop - p.start) / dim for p in parts])


def rotated_alike(x: np.ndarray) -> np.ndarray:
    """``x @ rotation``, summed in one fixed order: the same bits for a vector in whatever task."""
    r, out = rotation(x.shape[1]), np.zeros_like(x)
    for k in range(x.shape[1]):
        out += x[:, k:k + 1] * r[k]
    return out


def _cells(vec: np.ndarray, min_cos: float):
    """(block, rows that go to a cell, their cells, bits of ``guest``): the same for a vector in whatever task and pass."""
    x = rotated_alike(unit(vec.astype(np.float64)))
    parts, share = _radii(vec.shape[1], min_cos)
    for b, p in enumerate(parts):
        g, r = x[:, p][:, :GRID_DIMS], np.sqrt(share[b])
        width = max(CELL * r, 1e-6)
        own = np.floor(g / width).astype(np.int64)
        up = np.floor((g + r * (1 + 1e-9) + 1e-12) / width).astype(np.int64)
        for step in product((0, 1), repeat=g.shape[1]):
            goes = ((own + step) <= up).all(axis=1)
            if goes.any():
                yield b, goes, (own + step)[goes], sum(s << d for d, s in enumerate(step))


def _names(cells: np.ndarray) -> np.ndarray:
    return np.array([",".join(map(str, c)) for c in cells.tolist()], dtype=object)


def count(min_cos: float):
    """mapInPandas body: vectors by block and cell, of a batch."""
    def run(batches):
        for pdf in batches:
            for dim, rows in pdf.groupby(pdf["vec"].map(len)):
                for b, _, cells, _ in _cells(np.stack(rows["vec"].to_numpy()), min_cos):
                    some, n = np.unique(cells, axis=0, return_counts=True)
                    yield pd.DataFrame({"dim": dim, "block": b, "cell": _names(some), "n": n})
    return run


def deal(min_cos: float):
    """mapInPandas body: a row for each block and cell that a vector goes to; bit d of ``guest`` says
    that the cell is not the vector's own in grid dimension d."""
    def run(batches):
        for pdf in batches:
            for dim, rows in pdf.groupby(pdf["vec"].map(len)):
                vec = np.stack(rows["vec"].to_numpy())
                raw = np.array([v.tobytes() for v in vec.astype(f"<f{vec.itemsize}")], dtype=object)
                for b, goes, cells, guest in _cells(vec, min_cos):
                    yield pd.DataFrame({
                        "dim": dim, "block": b, "cell": _names(cells), "guest": guest, "width": vec.itemsize,
                        "cls": rows["cls"].to_numpy()[goes], "n": rows["n"].to_numpy()[goes], "vec": raw[goes]})
    return run


DEALT = "dim int, block int, cell string, guest int, width int, cls long, n long, vec binary"


def by_leaves(x: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(order of the rows leaf by leaf, ends of the leaves): halves at the median of the widest coordinate."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        sub = x[rows]
        at = sub[:, (sub.max(axis=0) - sub.min(axis=0)).argmax()].argpartition(len(rows) // 2)
        todo += [rows[at[:len(rows) // 2]], rows[at[len(rows) // 2:]]]
    return np.concatenate(out), np.cumsum([len(r) for r in out]).tolist()


class Held:
    """The chunk that a task holds: links within it, and with the chunks that pass by."""

    def __init__(self, dim: int, block: int, min_cos: float):
        self.dim, self.block, self.min_cos = dim, block, min_cos
        self.parts, self.share = _radii(dim, min_cos)
        self.turn = rotation(dim)[:, self.parts[block]]
        self.taken, self.raw = [], None

    def open(self, rows: pd.DataFrame) -> tuple:
        """(unit vectors, the block's coordinates, class, weight, guest bits) leaf by leaf, and the ends of the leaves."""
        raw = unit(np.frombuffer(b"".join(rows["vec"]), f"<f{rows['width'].iloc[0]}").reshape(len(rows), self.dim).astype(np.float64))
        return raw, raw @ self.turn, *(rows[c].to_numpy() for c in ("cls", "n", "guest"))

    def take(self, rows: pd.DataFrame) -> None:
        self.taken.append(self.open(rows))

    def settle(self) -> None:
        """Once the chunk is whole: its leaves, and the links within it."""
        if self.raw is not None:
            return
        made = [np.concatenate(x) for x in zip(*self.taken)]
        self.taken = []
        by = made[2].argsort(kind="stable")
        order, self.ends = by_leaves(made[1][by])
        self.raw, self.sub, self.cls, self.weight, self.guest = (x[by[order]] for x in made)
        n = len(self.raw)
        self.links, self.root, la, lb = np.zeros(n, np.int64), np.arange(n), [], []
        for i, j in self._near(self.sub, self.raw, self.guest, within=True):
            self.links += (np.bincount(i, self.weight[j], n) + np.bincount(j, self.weight[i], n)).astype(np.int64)
            la.append(i)
            lb.append(j)
            if sum(map(len, la)) > AT_ONCE:
                self._join(la, lb)
                la, lb = [], []
        self._join(la, lb)

    def _join(self, la: list, lb: list, more: int = 0) -> np.ndarray:
        """Roots of the held rows and ``more`` others with these links; those of the held rows are kept."""
        n = len(self.root)
        root = local_roots(n + more, np.concatenate([np.arange(n), *la]), np.concatenate([self.root, *lb]))
        self.root = root[:n]
        return root[n:]

    def _near(self, sub, raw, guest, within: bool = False):
        """(held row, other row) of the close pairs that count in this block and cell, some at a time."""
        most = self.share[self.block] + 1e-9
        sq, own = (sub * sub).sum(axis=1), (self.sub * self.sub).sum(axis=1)
        for lo, hi in zip([0, *self.ends], self.ends):
            leaf = self.sub[lo:hi]
            low, high = leaf.min(axis=0), leaf.max(axis=0)
            for s in range(lo if within else 0, len(sub), SLICE):
                rest = sub[s:s + SLICE]
                gap = np.maximum(np.maximum(low - rest, rest - high), 0)
                may = np.flatnonzero(np.einsum("ij,ij->i", gap, gap) <= most)
                ii, jj = np.nonzero(own[lo:hi, None] + sq[s + may] - 2 * (leaf @ rest[may].T) <= most)
                ii, jj = ii + lo, may[jj] + s
                if within:
                    later = jj > ii
                    ii, jj = ii[later], jj[later]
                for t in range(0, len(ii), AT_ONCE):
                    i, j = self._sure(ii[t:t + AT_ONCE], jj[t:t + AT_ONCE], raw, guest)
                    if len(i):
                        yield i, j

    def _sure(self, i, j, raw, guest):
        ok = (self.guest[i] & guest[j]) == 0                # this cell holds the larger coordinate in each dimension
        i, j = i[ok], j[ok]
        ok = (self.raw[i] * raw[j]).sum(axis=1) >= self.min_cos
        i, j = i[ok], j[ok]
        if not len(i):
            return i, j
        (mine, at), (others, to) = (np.unique(k, return_inverse=True) for k in (i, j))
        d = (rotated_alike(self.raw[mine])[at] - rotated_alike(raw[others])[to]) ** 2
        within = np.stack([d[:, q].sum(axis=1) <= self.share[k] for k, q in enumerate(self.parts[:self.block + 1])], axis=1)
        ok = within[:, self.block] & ~within[:, :self.block].any(axis=1)       # the first block in its share counts the pair
        return i[ok], j[ok]

    def meet(self, rows: pd.DataFrame) -> tuple | None:
        """(class, links, class of a held row that it is linked with) of rows that pass by."""
        self.settle()
        raw, sub, cls, weight, guest = self.open(rows)
        n, m, la, lb = len(self.raw), len(raw), [], []
        links = np.zeros(m, np.int64)
        for i, j in self._near(sub, raw, guest):
            self.links += np.bincount(i, weight[j], n).astype(np.int64)
            links += np.bincount(j, self.weight[i], m).astype(np.int64)
            la.append(i)
            lb.append(j + n)
        if not la:
            return None
        root, some = self._join(la, lb, m), links > 0
        return cls[some], links[some], self.cls[root[some]]

    def end(self) -> tuple:
        self.settle()
        some = self.links > 0
        return self.cls[some], self.links[some], self.cls[self.root[some]]


def join_cells(min_cos: float):
    """mapInPandas body over rows sorted by (dim, block, cell, a, passing): links between the rows of chunk ``a``, and of these with
    the rows that pass."""
    def run(batches):
        key, held, out = None, None, []

        def rows():
            made = [np.concatenate(x) for x in zip(*out)]
            out.clear()
            return pd.DataFrame(dict(zip(("cls", "links", "root"), made)))
        for pdf in batches:
            marks = [pdf[c].to_numpy() for c in ("dim", "block", "cell", "a", "passing")]
            cuts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(pdf)]):
                if lo == hi:
                    continue
                *now, passing = (m[lo] for m in marks)
                if now != key:
                    if held is not None:
                        out.append(held.end())
                    key, held = now, Held(int(now[0]), int(now[1]), min_cos)
                if not passing:
                    held.take(pdf[lo:hi])
                elif held is not None and (held.taken or held.raw is not None):
                    if (found := held.meet(pdf[lo:hi])) is not None:
                        out.append(found)
                else:
                    held = None                             # the hash has left this chunk empty
            if sum(len(x[0]) for x in out) > OUT_ROWS:
                yield rows()
        if held is not None:
            out.append(held.end())
        if out:
            yield rows()
    return run


def tasks_of(chunk: str, chunks: str) -> Column:
    """The chunks that hold while ``chunk`` passes, and itself: the half of the others that stand before it in the round of chunks; of two
    opposite ones the later passes the earlier."""
    c, n = F.col(chunk), F.col(chunks)
    return F.filter(F.sequence(F.lit(0), n - 1), lambda a: (2 * F.pmod(c - a, n) < n) | (2 * (c - a) == n))


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", min_cos: float = 0.95) -> DataFrame:
    """All columns of ``df`` but the embedding, plus ``RESULTS``."""
    keep = [c for c in df.columns if c not in RESULTS and c != embedding]
    v = F.col(embedding)
    zero = ~F.exists(v, lambda c: c != 0)
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    fine = F.coalesce((F.size(v) > 0) & ~odd & ~zero, F.lit(False))
    base = df.select(*keep, v).withColumn("__vec", F.when(fine, v))
    classes = (base.where(F.col("__vec").isNotNull()).groupBy("__vec")
               .agg(F.min(vec_id).alias("first"), F.count(F.lit(1)).alias("n"))
               .select(F.col("__vec").alias("vec"), "first", "n"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "embed-classes")
    spread = classes.select("cls", "n", "vec").repartition(F.col("cls"))
    # cells: a bounded number for each block, whatever the input (unit vectors, fixed width)
    cells = written(classes.select("vec").mapInPandas(count(min_cos), "dim int, block int, cell string, n long")
                    .groupBy("dim", "block", "cell").agg(F.sum("n").alias("n")).where("n > 1")   # cells of one vector have no pair
                    .select("dim", "block", "cell", F.greatest(F.ceil(F.col("n") / HELD_ROWS), F.least(F.ceil(F.col("n") / CELL_ROWS), F.lit(CHUNKS)))
                            .cast("int").alias("chunks")), "embed-cells")
    own = F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")
    rows = (spread.mapInPandas(deal(min_cos), DEALT).join(cells, ["dim", "block", "cell"]).withColumn("chunk", own)
            .withColumn("a", F.explode(tasks_of("chunk", "chunks"))).withColumn("passing", F.col("a") != F.col("chunk")))
    key = ["dim", "block", "cell", "a"]
    found = written(rows.select(*key, "passing", "guest", "width", "cls", "n", "vec").repartition(*key).sortWithinPartitions(*key, "passing")
                    .mapInPandas(join_cells(min_cos), "cls long, links long, root long"), "embed-links")
    comp = connected_components(found.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    rooted = written(classes.join(links, "cls", "left").join(comp, F.col("cls") == F.col("u"), "left")
                     .select("vec", "first", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("v", "cls").alias("root")),
                     "embed-rooted")
    low = written(rooted.groupBy("root").agg(F.min("first").alias("low")), "embed-low")
    result = written(rooted.join(low, "root").select(
        F.col("vec").alias("__v"), (F.col("links") + F.col("n") - 1).cast("long").alias("n_links"), F.col("low").alias("component_id")),
        "embed-result")
    own = F.col(vec_id)
    return (base.join(result, F.col("__vec") == F.col("__v"), "left")
            .select(*keep, F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                    F.when(F.col("__v").isNull(), own).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(own == F.col("component_id"), F.col("component_id").isNull())))


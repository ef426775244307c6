"""SimHash near-dedup with BK-trees.

A fingerprint is the bitwise majority over the XXH64 (seed 42) of a text's word shingles.
Fingerprints at most ``radius`` bits apart are linked and linked documents form components.

Search: equal fingerprints are one node (counted before any shuffle). Nodes are dealt to shards:
of ``radius + 1`` bit blocks, two nodes within the radius agree on at least one, so a shard is a
block with its value. A shard that would hold more than ``MAX_SHARD`` nodes is cut again by the
same rule over the bits that its nodes do not share yet, until every shard fits: nothing is left
out and no shard grows with the data. Each shard's nodes make one BK-tree (children keyed by the
integer distance to their parent); a node is searched, before it is inserted, along the edges
within the radius only. A shard returns one link per linked node, to the smallest of its local
component, never all pairs. Shards are shipped to their searching tasks by the shuffle: a broadcast
of all trees would have to pass through the driver and has no size bound.

Defined cases: null or word-free texts have fingerprint 0 and link like any other; repeated rows are
further documents with the same fingerprint; null ids keep their row (component by the other ids, null if
there is none); extra columns pass through, result names are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, local_roots
from .common import written

RESULTS = ("fingerprint", "component_id")
MAX_SHARD = 1024
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, k: int = 3) -> int:
    ws = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends, at = [], -1
    for w in ws:
        at += len(w) + 1
        ends.append(at)
    k = min(k, len(ws))
    starts = [0, *[e + 1 for e in ends]]
    digest = xxhash.xxh64_intdigest
    n, ones = len(ws) - k + 1, np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):                     # blocks: memory stays bounded for any length
        hi = min(n, lo + (1 << 16))
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[lo:hi], ends[lo + k - 1:hi + k - 1])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", k: int = 3) -> DataFrame:
    """All columns of ``df`` but the text, plus ``__fp`` (the 64 bits as a long)."""
    cols = [c for c in df.columns if c != text]
    schema = df.select(*cols, F.lit(0).cast("long").alias("__fp")).schema

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, k) for t in b.column(text).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in cols] + [pa.array(fp)], names=[*cols, "__fp"])
    return df.mapInArrow(run, schema)


def split_bits(bits: list[int], parts: int) -> list[list[int]]:
    """``bits`` as ``parts`` runs of nearly equal length."""
    cut = [len(bits) * i // parts for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cut, cut[1:])]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def shards(nodes: DataFrame, radius: int, max_shard: int = MAX_SHARD) -> DataFrame:
    """``nodes`` (fp) -> (shard, fp): every pair within the radius meets in at least one shard."""
    free = {0: list(range(64))}                 # path number -> bits that its shards do not share yet
    todo, out, n = nodes.select("fp", F.lit(0).alias("path"), F.lit(0).cast("long").alias("shard")), None, 1
    while True:
        options, nxt = [], {}
        for p, bits in free.items():
            for part in split_bits(bits, radius + 1):
                nxt[n] = [b for b in bits if b not in part]
                options.append((p, n, _mask(part)))
                n += 1
        table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.lit(m).alias("m")) for p, q, m in options])
        dealt_ = (todo.select("fp", "path", "shard", F.explode(F.filter(table, lambda o: o["p"] == F.col("path"))).alias("o"))
                  .select("fp", F.col("o.q").alias("path"),
                          F.xxhash64("shard", "o.q", F.col("fp").bitwiseAND(F.col("o.m"))).alias("shard")))
        last = min(len(b) for b in nxt.values()) <= radius
        hot = written(dealt_.groupBy("shard", "path").count().where(F.col("count") > max_shard).select("shard", "path"),
                      "simhash-hot")
        if last or hot.isEmpty():
            part, todo = dealt_, None
        else:
            part = dealt_.join(hot, ["shard", "path"], "left_anti")
            todo = written(dealt_.join(hot, ["shard", "path"], "left_semi").select("fp", "path", "shard"), "simhash-again")
            free = {q: nxt[q] for q in [r.path for r in hot.select("path").distinct().collect()]}
        part = part.select("shard", "fp")
        out = part if out is None else out.union(part)
        if todo is None:
            return out


def tree_links(fps: list[int], radius: int) -> tuple[list[int], list[int]]:
    """Pairs of places in ``fps`` (distinct) within the radius, by search then insert in one BK-tree."""
    a, b = [], []
    root: list = [fps[0], 0, {}]
    for i in range(1, len(fps)):
        f = fps[i]
        stack = [root]
        while stack:                            # search: only edges within the radius of the distance
            value, j, children = stack.pop()
            d = (f ^ value).bit_count()
            if d <= radius:
                a.append(i)
                b.append(j)
            if children:
                if len(children) <= 2 * radius:
                    stack += [c for e, c in children.items() if -radius <= e - d <= radius]
                else:
                    stack += [children[e] for e in range(d - radius, d + radius + 1) if e in children]
        node = root
        while True:                             # insert: walk down the edge of the exact distance
            d = (f ^ node[0]).bit_count()
            if d not in node[2]:
                node[2][d] = [f, i, {}]
                break
            node = node[2][d]
    return a, b


def shard_links(radius: int):
    """mapInArrow body over rows sorted by shard: one link per linked node, to its local root."""
    def of(fps: np.ndarray):
        a, b = tree_links(fps.view(np.uint64).tolist(), radius)
        if not a:
            return None
        fps_sorted = np.argsort(fps)            # roots are the smallest fingerprints as longs
        rank = np.empty(len(fps), np.int64)
        rank[fps_sorted] = np.arange(len(fps))
        root = local_roots(len(fps), rank[a], rank[b])
        s = fps[fps_sorted]
        linked = root != np.arange(len(fps))
        return s[linked], s[root[linked]]

    def run(batches):
        held_s, held_f = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in _ended(batches):
            if batch is not None:
                held_s = np.concatenate([held_s, batch.column("shard").to_numpy()])
                held_f = np.concatenate([held_f, batch.column("fp").to_numpy()])
            if not len(held_s):
                continue
            cut = np.flatnonzero(np.diff(held_s)) + 1
            ends = [0, *cut.tolist()] + ([len(held_s)] if batch is None else [])
            us, vs = [], []
            for lo, hi in zip(ends, ends[1:]):
                if hi - lo > 1 and (found := of(np.unique(held_f[lo:hi]))) is not None:
                    us.append(found[0])
                    vs.append(found[1])
            held_s, held_f = held_s[ends[-1]:], held_f[ends[-1]:]
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])
    return run


def _ended(batches):
    yield from batches
    yield None


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, radius: int = 3) -> DataFrame:
    """All columns of ``df`` but the text, plus ``fingerprint`` (16 hex digits) and ``component_id``."""
    keep = [c for c in df.columns if c not in RESULTS and c != text]
    marked = written(fingerprints(df.select(*keep, text), text, k), "simhash-fp")
    nodes = written(marked.groupBy(F.col("__fp").alias("fp")).agg(F.min(doc_id).alias("first")), "simhash-nodes")
    dealt = shards(nodes.select("fp"), radius)
    links = (dealt.repartition("shard").sortWithinPartitions("shard")
             .mapInArrow(shard_links(radius), "u long, v long"))
    comp = connected_components(links)
    # the smallest id of a component, from one row per fingerprint
    rooted = written(nodes.join(comp, nodes.fp == comp.u, "left")
                     .select("fp", "first", F.coalesce("v", "fp").alias("root")), "simhash-root")
    low = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-low")
    named = written(rooted.join(low, "root").select(F.col("fp").alias("__node"), "component_id"), "simhash-named")
    return (marked.join(named, F.col("__fp") == F.col("__node"))
            .select(*keep, F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id"))

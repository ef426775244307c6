"""Suffix-array dedup: remove every byte covered by a ``width``-byte string that also starts anywhere else.

Finding where equal strings can be. Each window of ``width`` bytes is named by the smallest hash of its ``GRAM``-byte
grams, a function of its content alone, so equal windows have equal names. Neighbouring windows share a name: a run
of them is one row, and only rows go through shuffles. Runs are counted by name and by the hash of their bytes
(a map-side count: a passage in a third of all documents is no hot task). Windows of runs whose bytes occur twice are
repeated as they are. Where one name has runs of different bytes, or a run holds its smallest gram twice, one run of each
content goes to a shard (chosen by name), and the shard's suffixes are sorted by external induced sorting with
common prefixes: a window whose prefix with its neighbour reaches ``width`` is repeated. A name whose runs hold more than
``name_bytes`` is split before any shard is made, as a gram that stands in many different surroundings gives a name that
grows with the documents: the windows of its runs are named again by the smallest gram under another hash, counted and
cut as before, ``SPLITS`` times; the windows of names that are still too large (long passages a little shorter than ``width``)
are counted one by one by 128 bits of hash, as runs are. Tables that grow with
the documents are joined by shuffles at every size, never by a broadcast; a bitmap of ``FILTER_BITS`` bits over the documents that
such a join needs (a fixed size, so it may be broadcast) keeps the texts of most others out of the shuffle.

Defined cases: null and empty texts have no bytes; matches never cross documents; rows that repeat an id and a text
repeat each other; a null id is a document like others; extra columns pass through, result names are replaced; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_path, written
from .induced import repeated

RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
GRAM, SHARD_BYTES, SLICE = 32, 3 << 20, 2 << 20
#: Bytes of different runs that one name may bring to a shard, and how often larger names are split.
NAME_BYTES, SPLITS = 1 << 20, 4
#: Bits of the filter of documents (8 MB), and of one of its bitmaps (fixed by Spark's bitmap functions).
FILTER_BITS, MAP_BITS = 1 << 26, 1 << 15


def raw_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets)."""
    a = pc.fill_null(col.cast(pa.large_binary()), b"")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[off[0]:off[-1]]
    return data, off - off[0]


def _parts(batch: pa.RecordBatch, text: str):
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def gram_hashes(data: np.ndarray, gram: int, seed: int = 0) -> np.ndarray:
    """A hash of the ``gram`` bytes (a power of two) from each place on; each seed orders grams in another way."""
    h, s = data.astype(np.uint64) + np.uint64(1), 1
    while s < gram:
        h = h[:-s] * np.uint64(0x9E3779B97F4A7C15 + 2 * s) + (h[s:] ^ (h[s:] >> np.uint64(31)))
        s *= 2
    if seed:
        h = (h ^ (h >> np.uint64(32)) ^ np.uint64(seed * 0xD6E8FEB86659FD93 % (1 << 64))) * np.uint64(0x94D049BB133111EB + 2 * seed)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs(data: np.ndarray, off: np.ndarray, width: int, seed: int = 0):
    """(name, first window, windows, whether the smallest gram occurs twice) of each run."""
    gram = GRAM
    while gram > width:
        gram //= 2
    none = np.empty(0, np.int64)
    if len(data) < width:
        return none.view(np.uint64), none, none, none.astype(bool)
    h = gram_hashes(data, gram, seed)
    span = width - gram + 1
    m, s = h, 1
    while 2 * s <= span:
        m, s = np.minimum(m[:-s], m[s:]), 2 * s
    if span > s:
        m = np.minimum(m[:len(m) - (span - s)], m[span - s:])
    p = np.arange(len(m))
    end = np.repeat(off[1:], np.diff(off))[:len(m)]
    fits = p + width <= end
    first = fits.copy()
    first[1:] &= (m[1:] != m[:-1]) | ~fits[:-1]
    last = fits.copy()
    last[:-1] &= first[1:] | ~fits[1:]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    name = m[lo]
    twice = np.fromiter((np.count_nonzero(h[a:b + span] == k) > 1 for a, b, k in zip(lo, hi, name)), bool, len(lo))
    return name, lo, hi - lo + 1, twice


def _run_schema(df: DataFrame) -> T.StructType:
    return T.StructType([df.schema["id"], df.schema["th"]] + [
        T.StructField(c, t) for c, t in (("name", T.LongType()), ("s1", T.LongType()), ("s2", T.LongType()),
                                         ("start", T.LongType()), ("n", T.LongType()), ("twice", T.BooleanType()))])


def _digests(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """128 bits of hash of each ``data[lo:hi]``, as two longs."""
    whole, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(digest(whole[a:b]) for a, b in zip(lo.tolist(), hi.tolist())), "<i8").reshape(-1, 2)


def find_runs(df: DataFrame, width: int) -> DataFrame:
    """(id, th, text) -> a row for each run."""
    schema = _run_schema(df)

    def run(batches):
        for batch in batches:
            for part in _parts(batch, "text"):
                data, off = raw_bytes(part.column("text"))
                name, lo, n, twice = runs(data, off, width)
                both = _digests(data, lo, lo + n - 1 + width)
                doc = np.searchsorted(off, lo, side="right") - 1
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(take), part.column("th").take(take), pa.array(name.view(np.int64)),
                     pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(lo - off[doc]), pa.array(n), pa.array(twice)],
                    names=schema.names)
    return df.mapInArrow(run, schema)


def cut_runs(df: DataFrame, width: int) -> DataFrame:
    """(id, th, text, runs) -> the bytes of each run."""
    schema = T.StructType([df.schema["id"], df.schema["th"]] + [
        T.StructField(c, t) for c, t in (("name", T.LongType()), ("s1", T.LongType()), ("s2", T.LongType()),
                                         ("start", T.LongType()), ("body", T.BinaryType()))])

    def run(batches):
        for batch in batches:
            for part in _parts(batch, "text"):
                data, off = raw_bytes(part.column("text"))
                lists = part.column("runs")
                doc = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                r = lists.flatten()
                at = off[doc] + r.field("start").to_numpy()
                bodies = [data[a:b].tobytes() for a, b in zip(at.tolist(), (at + r.field("n").to_numpy() - 1 + width).tolist())]
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(take), part.column("th").take(take), *(r.field(c) for c in ("name", "s1", "s2", "start")),
                     pa.array(bodies, pa.binary())], names=schema.names)
    return df.mapInArrow(run, schema)


def split_runs(df: DataFrame, width: int, seed: int) -> DataFrame:
    """Bytes of runs -> a row for each run of windows that share the old name and one under another hash."""
    schema = _run_schema(df)

    def run(batches):
        for batch in batches:
            for part in _parts(batch, "body"):
                data, off = raw_bytes(part.column("body"))
                name, lo, n, twice = runs(data, off, width, seed)
                both = _digests(data, lo, lo + n - 1 + width)
                at = np.searchsorted(off, lo, side="right") - 1
                old = part.column("name").to_numpy().view(np.uint64)[at]
                name = (name ^ (name >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) ^ old
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(take), part.column("th").take(take), pa.array(name.view(np.int64)), pa.array(both[:, 0]),
                     pa.array(both[:, 1]), pa.array(lo - off[at] + part.column("start").to_numpy()[at]), pa.array(n), pa.array(twice)],
                    names=schema.names)
    return df.mapInArrow(run, schema)


def single_windows(df: DataFrame, width: int) -> DataFrame:
    """Bytes of runs -> a row for each window."""
    schema = T.StructType([df.schema["id"], df.schema["th"]] + [T.StructField(c, T.LongType()) for c in ("s1", "s2", "a", "b")])

    def run(batches):
        for batch in batches:
            for part in _parts(batch, "body"):
                data, off = raw_bytes(part.column("body"))
                n = np.diff(off) - width + 1
                at = np.repeat(np.arange(len(n)), n)
                inner = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                lo = off[at] + inner
                both, a, take = _digests(data, lo, lo + width), part.column("start").to_numpy()[at] + inner, pa.array(at)
                yield pa.RecordBatch.from_arrays([part.column("id").take(take), part.column("th").take(take), pa.array(both[:, 0]),
                                                  pa.array(both[:, 1]), pa.array(a), pa.array(a + width)], names=schema.names)
    return df.mapInArrow(run, schema)


def merge(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Byte spans that windows starting at ``starts`` (ascending) cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > width) + 1
    return [(int(g[0]), int(g[-1]) + width) for g in np.split(starts, cut)]


def sort_shards(df: DataFrame, width: int, folder: str, memory: int) -> DataFrame:
    """One shard a partition: spans of the windows of each run that occur again in the shard."""
    schema = T.StructType([df.schema["id"], df.schema["th"], T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches):
        seen, heads, bodies = set(), [], []
        for batch in batches:
            heads_, body = batch.select(["id", "th", "name", "s1", "s2", "start"]).to_pylist(), batch.column("body")
            for i, r in enumerate(heads_):
                k = (r["name"], r["s1"], r["s2"])
                if k not in seen:               # a document that stands twice in the table brings its runs twice
                    seen.add(k)
                    heads.append(r)
                    bodies.append(body[i].as_py())
        if not bodies:
            return
        out = [(r["id"], r["th"], a + r["start"], b + r["start"])
               for r, starts in zip(heads, repeated(bodies, width, folder, memory)) for a, b in merge(starts, width)]
        cols = list(zip(*out)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field(n).type if n in ("id", "th") else pa.int64())
                                          for c, n in zip(cols, schema.names)], names=schema.names)
    return df.mapInArrow(run, schema)


def cut_out(df: DataFrame, text: str, width: int, with_text: bool) -> DataFrame:
    """Apply the spans: the results, and the kept text if wanted."""
    cols = [c for c in df.columns if c not in (text, "__spans")]
    extra = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
             T.StructField("kept_sha256", T.StringType())] + [T.StructField("kept_text", T.BinaryType())] * with_text
    schema = T.StructType([df.schema[c] for c in cols] + extra)

    def run(batches):
        for part in (p for batch in batches for p in _parts(batch, text)):
            rows = []
            for i in range(part.num_rows):
                raw = (part.column(text)[i].as_py() or "").encode()
                spans = part.column("__spans")[i].as_py() or []
                kept, at, removed, n = [], 0, 0, 0
                for s in sorted((s["a"], s["b"]) for s in spans):
                    if n and s[0] <= at:
                        removed += max(0, s[1] - at)
                        at = max(at, s[1])
                    else:
                        kept.append(raw[at:s[0]])
                        n, removed, at = n + 1, removed + s[1] - s[0], s[1]
                kept = b"".join([*kept, raw[at:]])
                rows.append((len(raw), removed, n, hashlib.sha256(kept).hexdigest(), kept)[:len(extra)])
            done = list(zip(*rows)) if rows else [[]] * len(extra)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(c) for c in cols] + [pa.array(c, k) for c, k in zip(done, kinds)], names=schema.names)
    return df.mapInArrow(run, schema)


def may_stand_in(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` with ``__may``: false only where (id, th) is not among ``keys``."""
    def placed(df):
        at = F.pmod(F.xxhash64("id", "th"), F.lit(FILTER_BITS))
        return df.withColumns({"__map": F.floor(at / MAP_BITS), "__bit": at % MAP_BITS})
    maps = written(placed(keys.select("id", "th")).groupBy("__map").agg(F.expr("bitmap_construct_agg(__bit)").alias("__bits")), "suffix-filter")
    byte = F.conv(F.hex(F.substring("__bits", (F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = placed(docs).join(F.broadcast(maps), "__map", "left").withColumn("__byte", byte)      # FILTER_BITS at most
    on = F.coalesce(F.expr("getbit(__byte, cast(__bit % 8 as int))"), F.lit(0)) == 1
    return marked.withColumn("__may", on).drop("__map", "__bit", "__bits", "__byte")


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 400,
                   with_text: bool = False, memory: int = 1 << 22, name_bytes: int = NAME_BYTES) -> DataFrame:
    """All columns of ``df`` but the text, plus ``RESULTS`` (and the remaining bytes as ``kept_text``)."""
    spark = df.sparkSession
    cols = [c for c in df.columns if c not in RESULTS and c != text and c != "kept_text"]
    docs = df.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    content = ["name", "s1", "s2"]

    def with_bytes(rows):
        per_doc = written(rows.groupBy("id", "th").agg(F.collect_list(F.struct(*content, "start", "n")).alias("runs")), "suffix-docs")
        at = may_stand_in(docs, per_doc).where("__may").alias("d").join(per_doc.hint("merge").alias("r"),
                                  F.col("d.id").eqNullSafe(F.col("r.id")) & (F.col("d.th") == F.col("r.th")))
        return cut_runs(at.select("d.id", "d.th", "d.text", "r.runs"), width)

    found, sort, whole = written(find_runs(docs, width), "suffix-runs"), None, None
    for split in range(SPLITS + 1):
        bodies = written(found.groupBy(*content).agg(
            F.count(F.lit(1)).alias("c"), F.max("twice").alias("twice"),
            F.min(F.struct("id", "th", "start", "n")).alias("one")), "suffix-bodies")
        names = written(bodies.groupBy("name").agg(F.count(F.lit(1)).alias("k"), F.max("twice").alias("any"),
                                                   F.sum(F.col("one.n") + width - 1).alias("bytes"))
                        .where("k > 1 or any").select("name", "bytes"), "suffix-names")
        of = lambda some: written(bodies.join(some.select("name").hint("merge"), "name", "left_semi")
                                  .select("one.id", "one.th", *content, "one.start", "one.n"), "suffix-sort")
        fit = of(names.where(F.col("bytes") <= name_bytes))
        sort = fit if sort is None else sort.union(fit)
        # runs whose bytes occur more than once: all their windows
        twice = written(bodies.where("c > 1").select(*content), "suffix-twice")
        again = found.join(twice.hint("merge"), content).select(
            "id", "th", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + width).alias("b"))
        whole = again if whole is None else whole.union(again)
        large = names.where(F.col("bytes") > name_bytes)
        if large.isEmpty():
            break
        hot = with_bytes(of(large))
        if split < SPLITS:
            found = written(split_runs(hot, width, split + 1), "suffix-split")
        else:
            each = written(single_windows(hot, width), "suffix-windows")
            twice = written(each.groupBy("s1", "s2").count().where("count > 1").select("s1", "s2"), "suffix-twice")
            whole = whole.union(each.join(twice.hint("merge"), ["s1", "s2"]).select("id", "th", "a", "b"))
    n_bytes = sort.agg(F.sum(F.col("n") + width - 1)).first()[0] or 0
    shards = with_bytes(sort).repartition(max(1, -(-int(n_bytes) // SHARD_BYTES)), "name")
    some = sort_shards(shards, width, _local(shared_path(spark, "suffix-queues")), memory)
    spans = written(whole.union(some).groupBy("id", "th").agg(F.collect_set(F.struct("a", "b")).alias("__spans")), "suffix-spans")
    rest = may_stand_in(df.select(*[F.col(c).alias(f"__x_{c}") for c in cols], F.col(text).alias("__text"), F.col(doc_id).alias("id"),
                                  F.xxhash64(F.col(text)).alias("th")), spans)
    named = [*[F.col(f"__x_{c}").alias(c) for c in cols], F.col("__text").alias(text)]
    found = (rest.where("__may").alias("x").join(spans.hint("merge").alias("s"), F.col("x.id").eqNullSafe(F.col("s.id")) & (F.col("x.th") == F.col("s.th")), "left")
             .select(*named, "__spans"))
    whole = rest.where(~F.col("__may")).select(*named, F.lit(None).cast(spans.schema["__spans"].dataType).alias("__spans"))
    marked = found.union(whole)
    return cut_out(marked, text, width, with_text)


def _local(uri: str) -> str | None:
    """Path of the shared folder if tasks can map files there; else queues stay in memory."""
    if uri.startswith("/"):
        return uri
    return "/" + uri[5:].lstrip("/") if uri.startswith("file:/") else None

"""Token ids in files of directly addressable codes.

A file holds the ids of a range of documents in ascending id order, level by level. Level 0 is the
low ``CHUNK`` bits of every id; a continuation bitmap says which ids go on, and level 1 holds
the next bits of just those, and so on. A rank directory (ones before each block of the bitmap) turns
a place in one level into its place in the next, so any id is read by one look into each level and
nothing else is decoded. Layout, little-endian:

    "DACI" version:u32 n_docs:u64 n_tokens:u64 n_levels:u32 sections:u32
    section table: (offset:u64, bytes:u64) each: document offsets (u64), then for each level its chunks (u8),
    bitmap (u8, bit i of byte i // 8) and rank directory (u64 for each RANK_BITS bits); the last level has no bitmap.

Defined cases: null and empty texts are the end id alone; null ids order before all others; rows that repeat an id are
documents of their own, equal ids in order of their text; an empty table makes no file and gives no rows;
extra columns of the input are not stored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, written
from .files import new_file, read_file
from .tokens import documents, public_path

CHUNK, RANK_BITS = 8, 512
#: A task starts a new file when its open one has so many ids.
FILE_IDS = 1 << 23
HEAD = struct.Struct("<4sIQQII")


def levels(ids: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """(chunks, bitmap, rank directory) of each level."""
    out = []
    while True:
        more = ids >> CHUNK
        goes_on = more > 0
        low = (ids & 0xFF).astype(np.uint8).tobytes()
        if not goes_on.any():
            out.append((low, b"", b""))
            return out
        bitmap = np.packbits(goes_on, bitorder="little")
        pad = -len(goes_on) % RANK_BITS
        ones = np.concatenate([goes_on, np.zeros(pad, bool)]).reshape(-1, RANK_BITS).sum(axis=1)
        rank = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        out.append((low, bitmap.tobytes(), rank.tobytes()))
        ids = more[goes_on]


def write_ids(out, ids: np.ndarray, offsets: np.ndarray) -> int:
    """One file of the ids of documents ``offsets[i]:offsets[i + 1]``. Returns its bytes."""
    coded = levels(ids)
    sections = [offsets.astype("<u8").tobytes()] + [x for level in coded for x in level]
    at = HEAD.size + 16 * len(sections)
    out.write(HEAD.pack(b"DACI", 1, len(offsets) - 1, len(ids), len(coded), len(sections)))
    for s in sections:
        out.write(struct.pack("<QQ", at, len(s)))
        at += len(s)
    for s in sections:
        out.write(s)
    return at


class TokenFile:
    """Random access to a file written by ``write_ids``; reads only the bytes it needs."""

    def __init__(self, f):
        self.f = f
        magic, version, self.n_docs, self.n_tokens, self.n_levels, n = HEAD.unpack(self._at(0, HEAD.size))
        if magic != b"DACI" or version != 1:
            raise ValueError("not a token file")
        table = np.frombuffer(self._at(HEAD.size, 16 * n), "<u8").reshape(-1, 2).tolist()
        self.docs, self.level = table[0], [table[1 + 3 * i:4 + 3 * i] for i in range(self.n_levels)]

    def _at(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def _part(self, section, lo: int, hi: int) -> np.ndarray:
        return np.frombuffer(self._at(section[0] + lo, min(hi, section[1]) - lo), np.uint8)

    def _rank(self, level, i: int) -> int:
        """Ones of the level's bitmap before bit ``i``."""
        block = i // RANK_BITS
        before = int(np.frombuffer(self._at(level[2][0] + 8 * block, 8), "<u8")[0])
        lo = block * RANK_BITS
        bits = np.unpackbits(self._part(level[1], lo // 8, -(-i // 8)), bitorder="little")
        return before + int(bits[:i - lo].sum())

    def offsets(self) -> np.ndarray:
        return np.frombuffer(self._at(*self.docs), "<u8").astype(np.int64)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids at places ``lo`` to ``hi`` (end excluded)."""
        out = np.zeros(hi - lo, np.uint32)
        where = np.arange(hi - lo)
        for k, level in enumerate(self.level):
            if not len(where):
                break
            out[where] |= self._part(level[0], lo, hi).astype(np.uint32) << (CHUNK * k)
            if k + 1 == self.n_levels:
                break
            first = lo // 8
            bits = np.unpackbits(self._part(level[1], first, -(-hi // 8)), bitorder="little")[lo - 8 * first:hi - 8 * first]
            where = where[bits.astype(bool)]
            lo = self._rank(level, lo)
            hi = lo + len(where)
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.ids(i, i + 1)[0])


def store(df: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
          end_id: int = 1, file_ids: int = FILE_IDS) -> DataFrame:
    """Write token files and return their list: (file_no, uri, n_docs, n_tokens, base), files in
    ascending order of their documents, ``base`` the ids in the files before. Sidecar Parquet files with the
    document ids stand beside them (``docs_uri``)."""
    path = path or public_path()
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # equal ids are dealt on by how their texts begin, so that a repeated id is no hot range
    dealt = (rows.withColumn("begin", F.substring("text", 1, 64)).repartitionByRange("doc_id", "begin")
             .sortWithinPartitions("doc_id", "text").drop("begin"))

    def run(batches):
        import pyarrow.parquet as pq
        part_no, made, held, ids, lens, names = TaskContext.get().partitionId(), 0, 0, [], [], []

        def file():
            nonlocal made, held
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(lens))])
            uri, docs_uri = (f"{folder}/{kind}-{part_no:06d}-{made:06d}.{end}" for kind, end in (("ids", "dac"), ("docs", "parquet")))
            with new_file(uri) as out:
                write_ids(out, np.concatenate(ids), offsets)
            with new_file(docs_uri) as out:
                pq.write_table(pa.table({"doc_id": pa.chunked_array(names)}), out)
            row = {"part": [part_no], "nth": [made], "uri": [uri], "docs_uri": [docs_uri], "n_docs": [len(offsets) - 1],
                   "n_tokens": [held]}
            made, held = made + 1, 0
            for x in (ids, lens, names):
                x.clear()
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for part, flat, off in documents(batch, "text", path, end_id):
                ids.append(flat.astype(np.uint16) if not len(flat) or flat.max() < 1 << 16 else flat)
                lens.append(np.diff(off))
                names.append(part.column("doc_id"))
                held += len(flat)
                if held >= file_ids:
                    yield file()
        if names:
            yield file()
    # a row for each file; written, so that no later step writes the files again
    made = written(dealt.mapInArrow(run, "part long, nth long, uri string, docs_uri string, n_docs long, n_tokens long"), "token-files")
    parts = made.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"), F.count(F.lit(1)).alias("part_files"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)     # a row for each task of the writer
    parts = parts.select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("part_tokens", "part_files")])
    before = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    return made.join(parts, "part").select(
        (F.col("part_files") + F.col("nth")).alias("file_no"), "uri", "docs_uri", "n_docs", "n_tokens",
        (F.col("part_tokens") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).alias("base"))


def read(spark: SparkSession, files: DataFrame, id_type: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files."""
    def run(batches):
        import pyarrow.parquet as pq
        for batch in batches:
            for r in batch.to_pylist():
                with read_file(r["docs_uri"]) as f:
                    names = pq.read_table(f).column("doc_id")
                with read_file(r["uri"]) as f:
                    t = TokenFile(f)
                    off = t.offsets()
                    crc = []
                    lo = 0
                    while lo < t.n_docs:            # some documents at a time: about a million ids
                        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + (1 << 20), side="right")) - 1)
                        ids = t.ids(int(off[lo]), int(off[hi])).astype("<u4")
                        crc += [zlib.crc32(ids[a - off[lo]:b - off[lo]].tobytes()) for a, b in zip(off[lo:hi], off[lo + 1:hi + 1])]
                        lo = hi
                yield pa.RecordBatch.from_arrays(
                    [names.combine_chunks(), pa.array(off[:-1] + r["base"]), pa.array(np.diff(off)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])
    files = written(files, "token-list")
    return (files.repartition(max(1, files.count()), "file_no")         # a count given is kept: about a file a task
            .mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"))


def round_trip(df: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str | None = None,
               path: str | None = None, end_id: int = 1, file_ids: int = FILE_IDS) -> DataFrame:
    """Store the ids of ``df`` and read every document back from the files."""
    spark = df.sparkSession
    files = store(df, folder or shared_path(spark, "token-files"), doc_id, text, path, end_id, file_ids)
    return read(spark, files, df.schema[doc_id].dataType.simpleString())

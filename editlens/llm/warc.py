"""WARC archives: writer with revisit records, normaliser of monolithic gzip files, and reader.

``write_monolithic`` writes each partition as one gzip stream over all its records, as careless
crawlers do: nothing in it can be reached without inflating all before it. ``normalise`` inflates such a
stream once from start to end, writes every record as a gzip member of its own, and writes a sidecar
index (Parquet: offset, length, id, type of each record), after which any record is one seek away.
``read`` opens the members at the offsets of the index. All three hold one record at a time.

Equal payloads: the record with the largest id is the response, the others are revisits that refer to it and
hold no body, if the payload has ``min_revisit`` bytes or more. Payload digest and length of every record stand in
its header, so a revisit describes the full payload too; a response's are taken from the body as read back.

Defined cases: null html is an empty payload; rows that repeat the largest id are responses all; a null id is
smaller than any other, and records of equal payload without any id are responses; null urls have no target
header, line ends and other control signs in urls are percent-coded; an empty table makes no file and gives no
rows; extra columns are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, written
from .files import new_file, read_file, read_stream

#: Fixed: every record gets the same date, so that reruns write the same bytes.
DATE = "2000-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
READ = 1 << 16


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = HTTP + (b"" if revisit else payload)
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_head(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def page_of(urn: str | None) -> int | None:
    return None if urn is None else int(urn.removeprefix("<urn:page:").removesuffix(">"))


def records(stream):
    """(head, whole record) of each record of a gzip stream, inflated once; members may be many."""
    z, held = zlib.decompressobj(31), b""
    raw = b""

    def more() -> bool:
        nonlocal z, held, raw
        while True:
            if not raw:
                raw = stream.read(READ)
                if not raw:
                    return False
            out = z.decompress(raw)
            raw = z.unused_data if z.eof else b""
            if z.eof:
                z = zlib.decompressobj(31)
            if out:
                held += out
                return True
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("record cut off")
                return
        head = parse_head(held[:end])
        size = end + 4 + int(head["content-length"]) + 4
        parts, n = [held], len(held)
        while n < size:
            held = b""
            if not more():
                raise ValueError("record cut off")
            parts.append(held)
            n += len(held)
        whole = b"".join(parts)
        held = whole[size:]
        yield head, whole[:size]


def with_revisits(pages: DataFrame, page_id: str, url: str, html: str, min_revisit: int) -> DataFrame:
    """(page_id, url, html, refers_to). Only ids and digests are shuffled to find equal payloads; groups
    are reduced before the shuffle, and the pages meet their few revisit rows by id."""
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    p = p.withColumn("sha", F.sha1(F.encode("html", "utf-8")))
    slim = p.where(F.octet_length("html") >= min_revisit).select("page_id", "sha")
    owners = written(slim.groupBy("sha").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n"))
                     .where("n > 1").select("sha", "owner"), "warc-owners")
    again = slim.join(owners, "sha").where(~F.col("page_id").eqNullSafe(F.col("owner")))
    again = written(again.distinct().select(F.col("page_id").alias("rp"), F.col("sha").alias("rs"), "owner"), "warc-revisits")
    return (p.join(again, F.col("page_id").eqNullSafe(F.col("rp")) & (F.col("sha") == F.col("rs")), "left")
            .select("page_id", "url", "html", F.col("owner").alias("refers_to")))


def by_file(files: DataFrame) -> DataFrame:
    """The list of files (a written table) dealt out to as many tasks. Without a count Spark would join these few bytes in one."""
    return files.repartition(max(1, files.count()), "file_no")


def write_monolithic(rows: DataFrame, folder: str) -> DataFrame:
    """One gzip stream for each partition -> (file_no, uri)."""
    def run(batches):
        no, first = TaskContext.get().partitionId(), next(batches, None)
        if first is None:
            return
        uri, z = f"{folder}/whole-{no:06d}.warc.gz", zlib.compressobj(6, zlib.DEFLATED, 31)

        def chain():
            yield first
            yield from batches
        with new_file(uri) as out:
            for batch in chain():
                for i in range(batch.num_rows):
                    r = {k: batch.column(k)[i].as_py() for k in ("page_id", "url", "html", "refers_to")}
                    out.write(z.compress(record(r["page_id"], r["url"], r["html"].encode(), r["refers_to"])))
            out.write(z.flush())
        yield pa.RecordBatch.from_pydict({"file_no": [no], "uri": [uri]})
    return written(rows.mapInArrow(run, "file_no long, uri string"), "warc-whole")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrite each file with one member a record -> (file_no, uri, index_uri, n_records)."""
    def run(batches):
        import pyarrow.parquet as pq
        kind = pa.schema([("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string())])
        for batch in batches:
            for r in batch.to_pylist():
                uri, index = (f"{folder}/records-{r['file_no']:06d}.{x}" for x in ("warc.gz", "index.parquet"))
                at, n, rows = 0, 0, []
                with read_stream(r["uri"]) as src, new_file(uri) as out, new_file(index) as side, pq.ParquetWriter(side, kind) as w:
                    for head, whole in records(src):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(whole) + z.flush()
                        out.write(member)
                        rows.append({"offset": at, "length": len(member), "page_id": page_of(head.get("warc-record-id")),
                                     "record_type": head["warc-type"]})
                        at += len(member)
                        n += 1
                        if len(rows) == 10_000:
                            w.write_table(pa.Table.from_pylist(rows, kind))
                            rows = []
                    w.write_table(pa.Table.from_pylist(rows, kind))
                yield pa.RecordBatch.from_pydict({"file_no": [r["file_no"]], "uri": [uri], "index_uri": [index], "n_records": [n]})
    return written(by_file(files).mapInArrow(run, "file_no long, uri string, index_uri string, n_records long"),
                   "warc-records")


def read(files: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, by the index."""
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def one(member: bytes) -> tuple:
        whole = zlib.decompress(member, 31)
        raw, _, rest = whole.partition(b"\r\n\r\n")
        head = parse_head(raw)
        page, kind = page_of(head.get("warc-record-id")), head["warc-type"]
        if kind == "revisit":
            return (page, int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:"), kind,
                    page_of(head["warc-refers-to"]))
        payload = rest[:int(head["content-length"])].partition(b"\r\n\r\n")[2]
        return page, len(payload), digest(payload), kind, None

    def run(batches):
        import pyarrow.parquet as pq
        for batch in batches:
            for r in batch.to_pylist():
                with read_file(r["index_uri"]) as side, read_file(r["uri"]) as f:
                    for part in pq.ParquetFile(side).iter_batches(4096, columns=["offset", "length"]):
                        rows = []
                        for at, n in zip(*(c.to_pylist() for c in part.columns)):
                            f.seek(at)
                            rows.append(one(f.read(n)))
                        cols = list(zip(*rows)) if rows else [()] * 5
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                            names=list(names))
    return by_file(files).mapInArrow(run, schema)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
               min_revisit: int = 0, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise them, and read every record back."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    rows = with_revisits(pages, page_id, url, html, min_revisit)
    return read(normalise(write_monolithic(rows, folder), folder))

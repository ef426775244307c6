"""One named text file a row, as a data source writer.

``df.write.format("named_files").option("path", ...)`` takes rows (folder, name, content) and leaves ``path/folder/name``
for each. A task writes every file under a name of its own and renames it when it is whole, so a lost or
repeated task never leaves half a file, and writing a file again leaves the same file. What a task has written stands in a
manifest; commit drops the manifests and leaves ``_SUCCESS``, abort removes the files that they list. Any store that pyarrow can
open serves as path. Rows of one folder and name should be reduced to one before (``last_of_name``), as the last
would win by chance; null contents are empty files, rows without a name are an error.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .io import scratch_path

SCHEMA = "folder string, name string, content string"
#: Files of a reading task: at most and, while there are shuffle partitions left, at least.
FILES, FEW_FILES = 20_000, 200
#: Names of a batch, and the signs after which a batch of contents is passed on.
ROWS, BATCH = 10_000, 1 << 24


def open_store(uri: str):
    """(file system, path) of a plain path or a URI."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass
class Written(WriterCommitMessage):
    manifest: str
    files: int


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> Written:
        store, base = open_store(self.path)
        task, n, made = uuid.uuid4().hex, 0, set()
        manifest = f"{base}/_manifests/{task}"
        store.create_dir(f"{base}/_manifests", recursive=True)
        with store.open_output_stream(manifest, compression=None) as listed:
            for row in iterator:
                if not row["name"] or "/" in row["name"]:
                    raise ValueError(f"not a file name: {row['name']!r}")
                folder = f"{base}/{row['folder']}" if row["folder"] else base
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                listed.write(f"{folder}/{row['name']}\n".encode())
                part = f"{folder}/_{row['name']}.{task}"
                with store.open_output_stream(part, compression=None) as out:
                    out.write((row["content"] or "").encode())
                store.move(part, f"{folder}/{row['name']}")
                n += 1
        return Written(manifest, n)

    def commit(self, messages) -> None:
        store, base = open_store(self.path)
        store.create_dir(base, recursive=True)
        if any(m is not None for m in messages):
            store.delete_dir(f"{base}/_manifests")
        with store.open_output_stream(f"{base}/_SUCCESS", compression=None) as out:
            out.write(b"")

    def abort(self, messages) -> None:
        store, _ = open_store(self.path)
        for m in messages:
            if m is None:
                continue
            with store.open_input_stream(m.manifest, compression=None) as f:
                for line in f.read().decode().splitlines():
                    store.delete_file(line)


class NamedFiles(DataSource):
    """Write-only data source ``named_files``."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("named_files only appends; give a fresh path")
        return NamedFilesWriter(self.options["path"])


def last_of_name(df: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one row for each folder and name, the last by ``order``; names that occurred more than once)."""
    g = df.groupBy("folder", "name").agg(F.max_by("content", F.struct(*order, "content")).alias("content"), F.count(F.lit(1)).alias("n"))
    return g.select("folder", "name", "content"), g.where(F.col("n") > 1).select("folder", "name", "n")


def write_named_files(df: DataFrame, path: str) -> None:
    """Write rows (folder, name, content) to ``path``."""
    df.sparkSession.dataSource.register(NamedFiles)
    df.select(*[F.col(c).cast("string").alias(c) for c in ("folder", "name", "content")]).write.format("named_files").option("path", path).mode("append").save()


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over, and every file with a leading underscore."""
    return name.startswith(("_", ".")) or name.endswith("._COPYING_")


def _listed(path: str):
    """(folder, name) of the files below ``path``; a local folder is never held whole."""
    from pyarrow import fs
    store, base = open_store(path)
    local, open_ = isinstance(store, fs.LocalFileSystem), [""]
    while open_:
        folder = open_.pop()
        at = f"{base}/{folder}" if folder else base
        found = (((e.name, e.is_dir()) for e in os.scandir(at)) if local else
                 ((e.base_name, e.type == fs.FileType.Directory) for e in store.get_file_info(fs.FileSelector(at))))
        for name, is_folder in found:
            if is_folder and (not _hidden(name) or name.startswith("_") and "=" in name):
                open_.append(f"{folder}/{name}" if folder else name)
            elif not is_folder and not _hidden(name):
                yield folder, name


def read_named_files(spark: SparkSession, path: str) -> DataFrame:
    """(folder, name, content) of the files below ``path``. A task lists the names, which are stored as a table and dealt to the tasks that
    read the files: the driver holds no list of them."""
    def names(_):
        listed = _listed(path)
        while some := list(islice(listed, ROWS)):
            yield pd.DataFrame(some, columns=["folder", "name"])

    def contents(batches):
        store, base = open_store(path)
        for batch in batches:
            made, size = [], 0
            for folder, name in zip(batch["folder"], batch["name"]):
                with store.open_input_stream(f"{base}/{folder}/{name}" if folder else f"{base}/{name}", compression=None) as f:
                    made.append((folder, name, f.read().decode("utf-8", "replace")))
                size += len(made[-1][2])
                if size >= BATCH:
                    yield pd.DataFrame(made, columns=["folder", "name", "content"])
                    made, size = [], 0
            if made:
                yield pd.DataFrame(made, columns=["folder", "name", "content"])
    at, kind = scratch_path(spark, "names"), "folder string, name string"
    spark.range(0, 1, 1, 1).mapInPandas(names, kind).write.parquet(at)
    table = spark.read.schema(kind).parquet(at)
    n = table.count()
    spread = max(1, -(-n // FILES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // FEW_FILES))
    return table.repartition(spread, "folder", "name").mapInPandas(contents, SCHEMA)

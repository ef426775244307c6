"""Files that tasks write into a shared folder, through any store that pyarrow can open."""

from __future__ import annotations

import uuid
from contextlib import contextmanager


def _open(uri: str):
    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


@contextmanager
def new_file(uri: str):
    """Binary stream to ``uri``: written under a name of its own and renamed when complete, so a task
    that is lost or runs twice never leaves half a file under the name."""
    store, path = _open(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part, compression=None) as out:
        yield out
    store.move(part, path)


@contextmanager
def read_file(uri: str):
    """Seekable binary file."""
    store, path = _open(uri)
    with store.open_input_file(path) as f:
        yield f


@contextmanager
def read_stream(uri: str):
    store, path = _open(uri)
    with store.open_input_stream(path, compression=None) as f:
        yield f

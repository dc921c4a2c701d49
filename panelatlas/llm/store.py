"""Files in the shared folder, read and written from tasks; local and mounted folders are memory-mapped."""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs


def _split(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def put(uri: str, chunks) -> int:
    """Write a whole file under a name of its own, then rename: a task that runs twice leaves one whole file."""
    store, path = _split(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    own, n = f"{path}.{uuid.uuid4().hex}", 0
    with store.open_output_stream(own) as out:
        for x in chunks:
            out.write(x)
            n += len(x)
    try:
        store.move(own, path)
    except OSError:
        if store.get_file_info(path).type != fs.FileType.File:
            raise
        store.delete_file(own)  # another run of the task was first
    return n


def mapping(uri: str) -> np.ndarray:
    """The file's bytes as a numpy array over a memory map, for as long as the array is held. A file of a remote store is
    copied to a temporary file that no longer has a name when this returns."""
    store, path = _split(uri)
    with tempfile.TemporaryDirectory() as own:
        if not isinstance(store, fs.LocalFileSystem):
            local = os.path.join(own, "copy")
            with store.open_input_stream(path) as src, open(local, "wb") as to:
                while x := src.read(1 << 22):
                    to.write(x)
            path = local
        with open(path, "rb") as f:
            if not os.fstat(f.fileno()).st_size:
                return np.zeros(0, dtype=np.uint8)
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), dtype=np.uint8)

"""Files that executors write and read in the shared folder, by any file system that pyarrow opens from a URI."""

from __future__ import annotations

import posixpath
import uuid


def opened(uri: str):
    """(file system, path) of a URI; a bare path is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def publish(uri: str, chunks) -> int:
    """Writes chunks under a name of this attempt and then moves the file to `uri`, so that readers see whole files only and a
    repeated task replaces its own file. Returns the number of bytes."""
    store, path = opened(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    draft, n = f"{path}.{uuid.uuid4().hex}.draft", 0
    with store.open_output_stream(draft) as out:
        for chunk in chunks:
            out.write(chunk)
            n += len(chunk)
    store.move(draft, path)
    return n


def read(uri: str, start: int = 0, length: int | None = None) -> bytes:
    store, path = opened(uri)
    with store.open_input_file(path) as f:
        f.seek(start)
        return f.read(length) if length is not None else f.read()

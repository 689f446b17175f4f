"""Files in the shared folder, opened from executors by URI.

A task writes under a name of its own and reports it as a row; only the rows
of successful attempts count, so a repeated or lost attempt leaves at worst an
unread file.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri:
        uri = ("file://" if uri.startswith("/") else "file:///") + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else "file://" + uri
    return fs.FileSystem.from_uri(uri)


def create(folder: str, stem: str, suffix: str):
    """(uri, stream) of a new file in ``folder``."""
    uri = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
    store, path = _at(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return uri, store.open_output_stream(path, compression=None)


def read(uri: str):
    store, path = _at(uri)
    return store.open_input_stream(path, compression=None)

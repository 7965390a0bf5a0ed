"""Byte files in the shared folder, by whatever file system its URI names (file, hdfs, s3, gs ...)."""

from __future__ import annotations

from pyarrow import fs as pafs


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path on it) of a folder or file URI; a bare path is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_bytes(uri: str, *chunks: bytes) -> None:
    """Write a new file."""
    where, path = filesystem(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    with where.open_output_stream(path, compression=None) as out:
        for c in chunks:
            out.write(c)


def open_writer(uri: str):
    """A stream that writes a new file."""
    where, path = filesystem(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    return where.open_output_stream(path, compression=None)


def open_reader(uri: str):
    """A sequential stream over a file's raw bytes."""
    where, path = filesystem(uri)
    return where.open_input_stream(path, compression=None)


def read_bytes(uri: str) -> bytes:
    """A file's bytes."""
    with open_reader(uri) as f:
        return f.read()

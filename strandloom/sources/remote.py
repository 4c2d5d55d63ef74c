"""Files by path or URI, opened in tasks by Arrow's file systems (local, HDFS, S3, GCS, Azure)."""

from __future__ import annotations

import pyarrow.fs as pafs

#: What Arrow opens; other schemes (viewfs, ...) are read by Spark's own sources.
SCHEMES = ("file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")


def scheme(path: str) -> str:
    head = path.split(":", 1)[0]
    return head if ":" in path and "/" not in head else "file"


def opens(path: str) -> bool:
    return scheme(path) in SCHEMES


def open_at(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if not opens(path):
        raise ValueError(f"no file system for {path}; use one of {', '.join(SCHEMES)}")
    if scheme(path) == "file":
        rest = path.removeprefix("file:")
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/") if path.startswith("file:") else rest
    return pafs.FileSystem.from_uri("s3" + path[3:] if path.startswith("s3a:") else path)


def files(path: str) -> list[pafs.FileInfo]:
    """The file of a path, or the files of a folder by name; names that start with ``.`` or ``_`` are hidden."""
    fs, at = open_at(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [info]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pafs.FileSelector(at))
    return sorted((f for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.base_name)

"""Opening and listing files from inside tasks by the paths that Spark uses."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlsplit

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a local path or a URI; Hadoop's names of S3 (``s3a``, ``s3n``) are known."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), urlsplit(path).path
    if "://" not in path:
        return fs.LocalFileSystem(), path
    scheme, rest = path.split("://", 1)
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


def listed(path: str, suffix: str) -> Iterator[tuple[str, int]]:
    """The file itself, or every file under a folder with that suffix: (path in the caller's form, size)."""
    system, inner = located(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        yield path, info.size
        return
    for entry in system.get_file_info(fs.FileSelector(inner, recursive=True)):
        if entry.type == fs.FileType.File and entry.path.endswith(suffix):
            yield path.rstrip("/") + entry.path[len(inner.rstrip("/")):], entry.size

"""Raw files in the shared folder, written and read by executors through Arrow's file systems.

A file gets a name of its own for each attempt of a task; only names that a committed Parquet table
lists are ever read, so a lost or repeated task leaves at most an unread file behind.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI such as file:///a or hdfs://host/a, and the path in it."""
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def file_uri(root: str) -> str:
    """Spark writes file:/a for file:///a."""
    return "file://" + root[5:] if root.startswith("file:/") and not root.startswith("file://") else root


def coalesced(ranges: list[tuple[int, int]], gap: int, most: int) -> Iterator[tuple[int, int, list[int]]]:
    """Joins sorted (offset, length) ranges: (offset, length, numbers of the ranges inside).

    Neighbours at most ``gap`` bytes apart share a read, which stays below ``most`` bytes unless a
    single range is longer.
    """
    start = end = 0
    inside: list[int] = []
    for i, (at, n) in enumerate(ranges):
        if inside and (at - end > gap or max(end, at + n) - start > most):
            yield start, end - start, inside
            inside = []
        if not inside:
            start, end = at, at
        inside.append(i)
        end = max(end, at + n)
    if inside:
        yield start, end - start, inside

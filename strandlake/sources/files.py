"""Path lists, and opening files wherever they are."""

from __future__ import annotations

import fnmatch
import glob
import io
import os
import re
from collections.abc import Iterator


def expand(paths: str) -> list[str]:
    """Space-separated paths with wildcards, ~ and $variables; commands are not run.

    Wildcards in the last part of a path in a store are looked up there.
    """
    out: list[str] = []
    for token in paths.split():
        token = os.path.expandvars(os.path.expanduser(token))
        found = remote_matches(token) if has_scheme(token) else sorted(glob.glob(token))
        out += found or [token]
    return out


def remote_matches(path: str) -> list[str]:
    folder, _, name = path.rpartition("/")
    if not re.search(r"[*?\[]", name):
        return []
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(folder)
    names = [x.base_name for x in store.get_file_info(fs.FileSelector(inner)) if x.type == fs.FileType.File]
    return sorted(f"{folder}/{x}" for x in names if fnmatch.fnmatchcase(x, name))


def batches(rows: Iterator[tuple[str, str, str | None]], most_rows: int = 4096, most_bytes: int = 4 << 20):
    """Arrow batches of (id, seq, qual), bounded in rows and bytes."""
    import pyarrow as pa

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in columns], ["id", "seq", "qual"])

    columns, size = ([], [], []), 0
    for row in rows:
        for column, x in zip(columns, row):
            column.append(x)
        size += 2 * len(row[1])
        if len(columns[0]) >= most_rows or size >= most_bytes:
            yield batch()
            columns, size = ([], [], []), 0
    if columns[0]:
        yield batch()


def has_scheme(path: str) -> bool:
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]+://", path) is not None


def opened(path: str) -> io.BufferedIOBase:
    """A seekable binary file, local or in a store that pyarrow knows."""
    if not has_scheme(path):
        return open(path, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def size_of(path: str) -> int:
    if not has_scheme(path):
        return os.path.getsize(path)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.get_file_info(inner).size


def exists(path: str) -> bool:
    try:
        size_of(path)
    except (OSError, TypeError):
        return False
    return True

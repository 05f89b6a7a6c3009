"""Files in the folder that driver and executors share, opened from tasks: what Spark has no reader for by ranges."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from urllib.parse import unquote


def located(uri: str):
    """(file system, path) of a URI of any store that pyarrow knows: local, s3, gs, abfs, hdfs with libhdfs."""
    from pyarrow import fs

    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", uri):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def unescaped(uri: str) -> str:
    """A file's place as Spark's _metadata gives it, without escapes."""
    return unquote(uri)


def ranges(file, wanted: Iterable[tuple[int, int]], most: int = 8 << 20) -> Iterator[bytes]:
    """The bytes of each (offset, length), sorted by offset; neighbours are read together, most bytes at once unless one is longer."""
    group: list[tuple[int, int]] = []
    stop = 0

    def read() -> Iterator[bytes]:
        file.seek(group[0][0])
        whole = file.read(stop - group[0][0])
        for offset, length in group:
            yield whole[offset - group[0][0] : offset - group[0][0] + length]

    for offset, length in wanted:
        if group and (offset > stop + 65_536 or max(stop, offset + length) - group[0][0] > most):
            yield from read()
            group = []
            stop = 0
        group.append((offset, length))
        stop = max(stop, offset + length)
    if group:
        yield from read()

"""Open files of a shared store inside a task."""

from __future__ import annotations

import pyarrow.fs


def open_path(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and inner path of a path as Spark spells it (``file:/x``, ``hdfs://..``, ``s3://..``, ``/x``)."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        path = "file:///" + (rest if colon else path).lstrip("/")
    elif scheme in ("s3a", "s3n"):
        path = "s3:" + rest
    return pyarrow.fs.FileSystem.from_uri(path)

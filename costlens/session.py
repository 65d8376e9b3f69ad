"""Session settings the operators rely on."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import SparkSession

_SETTINGS = {
    # Text timestamps without an offset are UTC wall time.
    "spark.sql.session.timeZone": "UTC",
    # A dataset id such as "007" must not be read back from its folder as 7.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; cluster sizing is left to the caller."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextlib.contextmanager
def during(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Runtime settings that hold for one job; what the caller had set comes back after it."""
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def require_utc(spark: SparkSession) -> None:
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "Z", "GMT", "+00:00"):
        raise ValueError(f"session time zone must be UTC, not {zone}; call session.configure")


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and written tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local-mode session,
    as in tests, may fall back to a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="costlens-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_table(spark: SparkSession, label: str) -> str:
    """Unused path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table written by ``scratch_table``'s caller."""
    if not path.startswith(shared_folder(spark) + "/"):
        raise ValueError(f"{path} is not below the shared folder")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

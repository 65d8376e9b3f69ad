"""Where data came from: file hashes and per-dataset provenance."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.currencies import named_currencies
from ..functions.tables import renewed
from ..schema import detect_version
from .storage import open_path

#: Bytes of a file that a task holds at a time.
CHUNK = 4 << 20
#: Hashes that are combined into one at a time.
WIDTH = 1024


def file_hashes(spark: SparkSession, path: str, glob: str = "*", chunk: int = CHUNK) -> DataFrame:
    """SHA-256 of every file below a landing folder, of any size.

    Files are listed without being read, spread over the tasks, and hashed there chunk by
    chunk.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length")
    )

    def hashed(batches):
        for batch in batches:
            digests = []
            for name in batch.column("path").to_pylist():
                system, inner = open_path(name)
                digest = hashlib.sha256()
                with system.open_input_stream(inner, compression=None) as source:
                    while part := source.read(chunk):
                        digest.update(part)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(digests, pa.string())], ["path", "length", "content_hash"]
            )

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(tasks, "path").mapInArrow(hashed, "path string, length long, content_hash string")


def unseen_files(hashes: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose hash is not recorded yet."""
    return hashes.join(known.select("content_hash").distinct(), "content_hash", "left_anti")


def combined_hash(hashes: DataFrame, width: int = WIDTH) -> str | None:
    """One hash for all files: of the one file, or of the sorted hashes of several; None without files.

    More than ``width`` different hashes are a tree: those that begin alike are combined first, some ``width`` at a
    time, then what they give, and so on, so no task and no array grows with the files.  A hash that several files have is marked with their number.
    """
    leaves = hashes.groupBy(F.col("content_hash").alias("key")).agg(F.count(F.lit(1)).alias("files"))
    number = F.when(F.col("files") > 1, F.concat(F.lit("*"), F.col("files").cast("string"))).otherwise("")
    leaves = leaves.select("key", "files", F.concat("key", number).alias("leaf"))
    found = leaves.agg(F.count(F.lit(1)).alias("n"), F.sum("files").alias("files")).first()
    if not found["n"]:
        return None
    if found["files"] == 1:
        return leaves.first()["key"]
    # digits that the hashes of one group share, and by how many each level goes down
    digits, fewer = 0, 1
    while found["n"] > width * 16**digits:
        digits += 1
    while 16 ** (fewer + 1) <= width:
        fewer += 1
    while True:
        combined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "leaf"))), lambda x: x["leaf"]), "\n"), 256)
        leaves = leaves.groupBy(F.substring("key", 1, digits).alias("key")).agg(combined.alias("leaf"))
        if not digits:
            return leaves.first()["leaf"]
        digits = max(0, digits - fewer)


def provenance(
    billing: DataFrame,
    *,
    source_url: str | None = None,
    focus_version: str | None = None,
    raw_columns: Sequence[str] | None = None,
    hashes: DataFrame | None = None,
) -> DataFrame:
    """One row per dataset: rows, date range, currency, source, version, hash, time of ingestion.

    Several currencies are comma-joined in sorted order, the first ``NAMED_CURRENCIES`` of them; ``currency_count``
    counts all, and ``functions.currencies.currencies`` is the table of all.  The version is detected from
    ``raw_columns``, the columns of the file as it came, unless it is given.  ``hashes`` (from ``file_hashes``) adds
    their ``combined_hash``.
    """
    present = set(billing.columns)
    starts = [c for c in ("charge_period_start", "billing_period_start") if c in present]
    no_time = F.lit(None).cast("timestamp_ntz")
    version = focus_version or (detect_version(list(raw_columns)) if raw_columns is not None else "1.0")
    # A bound falls back to the billing period only when no charge period exists,
    # and then both bounds are missing together.
    found = billing.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(*[F.min(c) for c in starts], no_time).alias("date_range_start"),
        F.coalesce(*[F.max(c) for c in starts], no_time).alias("date_range_end"),
        F.lit(source_url).cast("string").alias("source_url"),
        F.lit(version).alias("focus_version"),
        F.current_timestamp().alias("ingested_at"),
        F.lit(combined_hash(hashes) if hashes is not None else None).cast("string").alias("content_hash"),
    )
    return found.join(renewed(named_currencies(billing)), "dataset_id", "left").select(
        "dataset_id",
        "row_count",
        "date_range_start",
        "date_range_end",
        F.array_join("currencies", ",").alias("currency"),
        F.coalesce("currency_count", F.lit(0).cast("bigint")).alias("currency_count"),
        "source_url",
        "focus_version",
        "ingested_at",
        "content_hash",
    )

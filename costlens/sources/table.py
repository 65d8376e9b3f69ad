"""The canonical billing table: Parquet in versions, one manifest for each version of a dataset.

``<path>/data/version=<id>/dataset_id=<id>/charge_month=<month>/`` holds what one write brought, and
``<path>/manifests/dataset_id=<id>/<number>.json`` says which folder a dataset's rows lie in.  A write touches no file that is
there; a dataset changes when its next manifest gets its name, by one rename.  A reader looks up
the newest manifest once and reads that version whole, whatever is written meanwhile.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure, during

#: Older versions of a dataset that stay, for readers that have begun with them.
KEPT_VERSIONS = 1
#: A write keeps a file open for each folder it has begun, up to this number in a task, before it sorts the rows by folder.  What it
#: shuffled is deleted when it ends, not when the driver's memory is next collected.
_WRITING = {
    "spark.sql.maxConcurrentOutputFileWriters": "64",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
_MANIFEST = "dataset_id string, number int, version string, row_count long, schema string"


class DatasetMissing(FileNotFoundError):
    """No stored rows for a dataset."""

    def __init__(self, dataset_id: str) -> None:
        super().__init__(f"DATASET_STORAGE_MISSING: no stored rows for dataset {dataset_id}")


@dataclass(frozen=True)
class Version:
    """One version of a dataset: its number, the write that brought it, its rows and their columns."""

    dataset_id: str
    number: int
    version: str
    row_count: int
    schema: T.StructType


def _escaped(spark: SparkSession, dataset_id: str) -> str:
    """The dataset's folder, named as Spark's writer names it."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return f"dataset_id={escape(dataset_id)}"


def _files(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _numbers(spark: SparkSession, path: str, dataset_id: str) -> list[int]:
    files, folder = _files(spark, f"{path}/manifests/{_escaped(spark, dataset_id)}")
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(int(name[:-5]) for name in names if name.endswith(".json") and not name.startswith("."))


def _manifest(spark: SparkSession, path: str, dataset_id: str, number: int) -> str:
    return f"{path}/manifests/{_escaped(spark, dataset_id)}/{number:08d}.json"


def _read(spark: SparkSession, path: str, dataset_id: str, number: int) -> Version:
    files, name = _files(spark, _manifest(spark, path, dataset_id, number))
    source = files.open(name)
    try:
        found = json.loads(bytes(source.readAllBytes()))
    finally:
        source.close()
    return Version(dataset_id, number, found["version"], found["row_count"], T.StructType.fromJson(json.loads(found["schema"])))


def _publish(spark: SparkSession, path: str, new: Version) -> int:
    """Give the manifest the dataset's next free number; of two writers at a time the later one is the newer version."""
    content = {"dataset_id": new.dataset_id, "version": new.version, "row_count": new.row_count, "schema": new.schema.json()}
    files, draft = _files(spark, f"{path}/manifests/{_escaped(spark, new.dataset_id)}/.{new.version}")
    target = files.create(draft, True)
    try:
        target.write(bytearray(json.dumps(content).encode()))
    finally:
        target.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    # a rename that refuses a name that is taken
    careful = spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    number = max(_numbers(spark, path, new.dataset_id), default=0)
    while True:
        number += 1
        _, name = _files(spark, _manifest(spark, path, new.dataset_id, number))
        try:
            context.rename(files.makeQualified(draft), files.makeQualified(name), careful)
            return number
        except Exception as error:  # py4j hands every Java exception over as one class
            if "FileAlreadyExistsException" not in str(error):
                raise


def _forget(spark: SparkSession, path: str, dataset_id: str, keep: int) -> None:
    """Delete the manifests and rows of all versions but the newest one and ``keep`` before it."""
    for number in _numbers(spark, path, dataset_id)[: -1 - keep]:
        old = _read(spark, path, dataset_id, number)
        for name in (_manifest(spark, path, dataset_id, number), f"{path}/data/version={old.version}/{_escaped(spark, dataset_id)}"):
            files, target = _files(spark, name)
            files.delete(target, True)


@dataclass(frozen=True)
class Staged:
    """A write that no manifest names yet: its folder, rows of each dataset, columns."""

    version: str
    rows: dict[str, int]
    schema: T.StructType


def stage(df: DataFrame, path: str, arranged: bool = False) -> Staged:
    """Write rows where no reader looks.

    The rows are computed once.  Rows without a dataset id are not stored.  Files are partitioned by dataset and charge month, so
    that a period filter prunes folders; the rebalance hint sizes them: AQE splits a partition that
    holds a large share of the rows over many writers and merges small ones.  ``arranged`` says that a partition of ``df`` holds
    few datasets and months as it is, as one read from such a table does: then nothing is shuffled.
    """
    spark = df.sparkSession
    path, version = path.rstrip("/"), uuid.uuid4().hex
    root = f"{path}/data/version={version}"
    rows = df.where(F.col("dataset_id").isNotNull()).withColumn("charge_month", F.date_format("charge_period_start", "yyyy-MM"))
    if not arranged:
        rows = rows.hint("rebalance", "dataset_id", "charge_month")
    with during(spark, _WRITING):
        rows.write.partitionBy("dataset_id", "charge_month").parquet(root, compression="zstd")
    schema = T.StructType([f for f in df.schema.fields if f.name not in ("dataset_id", "charge_month")])
    written = spark.read.schema(_stored(schema)).parquet(root)
    # from the footers of the files; one row for each dataset of this write
    return Staged(version, {r["dataset_id"]: r["count"] for r in written.groupBy("dataset_id").count().collect()}, schema)


def discard(spark: SparkSession, path: str, staged: Staged) -> None:
    """Delete a write that was not published."""
    files, folder = _files(spark, f"{path.rstrip('/')}/data/version={staged.version}")
    files.delete(folder, True)


def publish(
    spark: SparkSession, path: str, staged: Staged, datasets: Sequence[str] = (), keep: int = KEPT_VERSIONS
) -> dict[str, Version]:
    """Make a staged write the newest version of its datasets, and of ``datasets`` it has no rows of."""
    path, found = path.rstrip("/"), {}
    for dataset_id in sorted({*staged.rows, *datasets}):
        new = Version(dataset_id, 0, staged.version, staged.rows.get(dataset_id, 0), staged.schema)
        found[dataset_id] = replace(new, number=_publish(spark, path, new))
        _forget(spark, path, dataset_id, keep)
    return found


def write_canonical(
    df: DataFrame, path: str, *, datasets: Sequence[str] = (), keep: int = KEPT_VERSIONS, arranged: bool = False
) -> dict[str, Version]:
    """Replace the datasets in ``df``, and empty those of ``datasets`` it has no rows of; leave others alone.

    ``arranged`` is that of ``stage``.  A write that fails changes no dataset.
    """
    return publish(df.sparkSession, path, stage(df, path, arranged), datasets, keep)


def _stored(schema: T.StructType) -> T.StructType:
    partitions = [T.StructField("dataset_id", T.StringType()), T.StructField("charge_month", T.StringType())]
    return T.StructType([*schema.fields, *partitions])


def versions(spark: SparkSession, path: str, dataset_id: str) -> list[Version]:
    """Versions of a dataset that can still be read, oldest first."""
    path = path.rstrip("/")
    return [_read(spark, path, dataset_id, number) for number in _numbers(spark, path, dataset_id)]


def _rows(spark: SparkSession, path: str, pinned: Sequence[Version]) -> DataFrame:
    """Rows of some versions in one scan; a column that some of them lack is NULL there."""
    merged: dict[str, T.StructField] = {}
    for schema in {v.schema.json(): v.schema for v in pinned}.values():
        for field in schema.fields:
            known = merged.setdefault(field.name, field)
            if known.dataType != field.dataType:
                raise ValueError(f"column {field.name} is {known.dataType.simpleString()} and {field.dataType.simpleString()}")
    schema = _stored(T.StructType(list(merged.values())))
    folders = [f"{path}/data/version={v.version}/{_escaped(spark, v.dataset_id)}" for v in pinned if v.row_count]
    if not folders:
        return spark.createDataFrame([], schema)
    full = T.StructType([*schema.fields, T.StructField("version", T.StringType())])
    return spark.read.schema(full).option("basePath", f"{path}/data").parquet(*folders).drop("version")


def scan_dataset(spark: SparkSession, path: str, dataset_id: str, number: int | None = None) -> DataFrame:
    """Rows of one dataset, of its newest version or a given one, read from its own folder."""
    configure(spark)
    path = path.rstrip("/")
    known = _numbers(spark, path, dataset_id)
    if not known or (number is not None and number not in known):
        raise DatasetMissing(dataset_id)
    pinned = _read(spark, path, dataset_id, number or known[-1])
    if not pinned.row_count:
        raise DatasetMissing(dataset_id)
    return _rows(spark, path, [pinned])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all datasets, each of its newest version; manifests are read in parallel, one row per dataset comes back."""
    configure(spark)
    path = path.rstrip("/")
    try:
        texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(f"{path}/manifests", wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise DatasetMissing("of any id") from error
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("int")
    parsed = texts.select(F.from_json("value", _MANIFEST).alias("m"), number.alias("number")).select("m.dataset_id", "number", "m.version", "m.row_count", "m.schema")
    newest = Window.partitionBy("dataset_id").orderBy(F.desc("number"))
    rows = parsed.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn").collect()
    pinned = [Version(r["dataset_id"], r["number"], r["version"], r["row_count"], T.StructType.fromJson(json.loads(r["schema"]))) for r in rows]
    return _rows(spark, path, sorted(pinned, key=lambda v: v.dataset_id))

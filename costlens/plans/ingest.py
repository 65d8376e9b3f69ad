"""One export from its files to the canonical table, checked and recorded."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..operators import quality
from ..schema import DATE_FIELDS, detect_version, missing_required
from ..sources import table as storage
from ..sources.dates import Vote
from ..sources.files import file_format


class IngestError(ValueError):
    """An export that cannot become a dataset."""


@dataclass(frozen=True)
class Ingested:
    """What a stored export is: its rows, quality report and provenance record, and how dates that aren't ISO were spelt."""

    dataset_id: str
    rows: DataFrame
    quality: DataFrame
    provenance: DataFrame
    date_votes: dict[str, Vote] = field(default_factory=dict)


def ingest(
    spark: SparkSession,
    path: str,
    table: str,
    *,
    dataset_id: str,
    fmt: str | None = None,
    source_url: str | None = None,
    distinct: str = "exact",
    multiline: bool = False,
) -> Ingested:
    """Read, detect the version, normalize, write, verify, validate, and record where it came from.

    The export replaces the dataset of that id; one without rows empties it and is an error.  A file without a required column
    is refused before anything is written.  The export is read once: its rows are counted in passing, and a
    difference to the table is an error.  Quality is judged on the table, whose files hold columns instead of text; a dataset that
    fails it stays stored, and the decision run stops it at its gate.
    """
    raw = sources.read_billing(spark, path, fmt=fmt or file_format(path), multiline=multiline)
    version = detect_version(raw.columns)
    columns = sources.to_canonical(raw, dataset_id=dataset_id, version=version).columns
    if absent := missing_required(columns):
        raise IngestError(f"{path} lacks {absent}")
    staged, unread = _staged(raw, table, dataset_id, version, {})
    votes = {}
    if unread:
        # some dates are not ISO: the values of each column say how they are spelt
        votes = {c: v for c, v in sources.date_votes(raw, version).items() if v.parsed}
        if votes:
            storage.discard(spark, table, staged)
            staged, _ = _staged(raw, table, dataset_id, version, {c: v.format for c, v in votes.items()})
    kept = staged.rows.get(dataset_id, 0)
    stored = storage.publish(spark, table, staged, [dataset_id])[dataset_id]
    if not kept:
        raise IngestError(f"{path} has no rows; dataset {dataset_id} is empty now")
    rows = sources.scan_dataset(spark, table, dataset_id, stored.number)
    return Ingested(
        dataset_id,
        rows,
        quality.quality_report(rows.drop("charge_month"), distinct),
        sources.provenance(
            rows,
            source_url=source_url or path,
            focus_version=version,
            hashes=sources.file_hashes(spark, path),
        ),
        votes,
    )


def _staged(raw: DataFrame, table: str, dataset_id: str, version: str, date_formats: dict[str, str]) -> tuple[storage.Staged, bool]:
    """The export written in one read, its rows and dates counted in passing, and whether some dates could not be read."""
    seen, typed = Observation(), Observation()
    dates = [c for c in sources.rename_to_canonical(raw, version).columns if c in DATE_FIELDS]
    renamed = dict(zip(sources.rename_to_canonical(raw, version).columns, raw.columns))
    rows = F.count(F.lit(1)).alias("rows")
    watched = raw.observe(seen, rows, *[F.count(f"`{renamed[c]}`").alias(c) for c in dates])
    canonical = sources.to_canonical(watched, dataset_id=dataset_id, version=version, date_formats=date_formats)
    staged = storage.stage(canonical.observe(typed, rows, *[F.count(c).alias(c) for c in dates]), table)
    kept = staged.rows.get(dataset_id, 0)
    # a task that ran twice may have counted twice, and nothing is counted where nothing came: only then the export is read again
    agreed = kept and seen.get["rows"] == kept
    if not agreed and (expected := raw.count()) != kept:
        storage.discard(raw.sparkSession, table, staged)
        raise IngestError(f"the export has {expected} rows, the table {kept}")
    return staged, bool(kept) and any(seen.get[c] != typed.get[c] for c in dates)

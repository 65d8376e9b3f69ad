from .files import read_billing
from .normalize import date_votes, rename_to_canonical, to_canonical
from .provenance import combined_hash, file_hashes, provenance, unseen_files
from .table import DatasetMissing, read_table, scan_dataset, versions, write_canonical

__all__ = [
    "DatasetMissing",
    "combined_hash",
    "date_votes",
    "file_hashes",
    "provenance",
    "read_billing",
    "read_table",
    "rename_to_canonical",
    "scan_dataset",
    "to_canonical",
    "unseen_files",
    "versions",
    "write_canonical",
]

"""Readers for raw billing exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# CSV cells that mean "no value" (the pandas defaults).
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def file_format(path: str) -> str:
    name = path.rstrip("/").lower()
    if name.endswith((".parquet", ".pq")):
        return "parquet"
    if name.endswith(".csv"):
        return "csv"
    raise ValueError(f"cannot tell the format of {path}: expected .csv, .parquet or .pq")


def read_billing(
    spark: SparkSession,
    path: str,
    *,
    fmt: str | None = None,
    multiline: bool = False,
    null_tokens: tuple[str, ...] = NULL_TOKENS,
) -> DataFrame:
    """Read one export or a folder of exports as it is.

    ``fmt`` is needed only for a folder whose name has no suffix.  CSV columns
    stay text, so identifiers keep their leading zeros; numbers and dates are
    typed by ``to_canonical``.  ``multiline`` allows quoted line breaks, at the
    price of one task per file.
    """
    if (fmt or file_format(path)) == "parquet":
        return spark.read.option("mergeSchema", True).parquet(path)
    raw = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("enforceSchema", False)
        .csv(path)
    )
    return raw.select(
        [
            F.when(~F.col(f"`{c}`").isin(*null_tokens), F.col(f"`{c}`")).alias(c)
            for c in raw.columns
        ]
    )

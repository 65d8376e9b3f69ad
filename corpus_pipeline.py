"""A corpus pipeline of five operators: language, near duplicates, secrets, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``.  Packing returns pieces, the others the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.llm import jaccard, langid, mixing, packing, secrets
from costlens.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null texts and texts without a letter (``und``) go."""
    found = langid.predict(docs.select(*COLUMNS), langid.fit(docs))
    return found.where("lang_pred <> 'und'").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; rows without an id go.

    Rows that repeat an id with one text are one document; of several texts under one id the smallest stays.
    """
    groups = jaccard.join(docs).where("doc_id = component_id")
    kept = groups.groupBy(F.col("doc_id").alias("kept")).agg(F.count("*").alias("rows"))
    # texts meet one narrow row for each id, by hash: they are not sorted
    some = docs.select(*COLUMNS).join(kept.hint("shuffle_hash"), F.col("doc_id") == F.col("kept"))
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    row = F.min(F.struct("text", *rest)).alias("row")
    more = some.where("rows > 1").groupBy("doc_id").agg(row)
    return some.where("rows = 1").select(*COLUMNS).unionByName(
        more.select("doc_id", "row.text", *[f"row.{c}" for c in rest]).select(*COLUMNS)
    )


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.redact(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document comes as often as its source's target asks, copies as rows of their own."""
    copies = mixing.pareto_mix(docs).where("copies > 0").groupBy(F.col("doc_id").alias("taken_id")).agg(F.max("copies").alias("copies"))
    return (
        docs.select(*COLUMNS)
        .join(copies.hint("shuffle_hash"), F.col("doc_id") == F.col("taken_id"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(*COLUMNS)
    )


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("secret_scan", without_secrets),
    ("pareto_mix", mixed),
    ("hilbert_packing", packed),
]

#: The model of the first stage, the battery of the third and the tokenizer of the last are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

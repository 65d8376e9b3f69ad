"""The registered query of each corpus operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.session import drop_table, scratch_table

from . import balltree, collisions, exact, fim, html, jaccard, langid, mixing, packing, secrets, substrings, tokenfiles, walsh
from .common import stored, table
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
__all__ = ["ORACLES", "QUERIES"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten highest integer inner products of every hundredth vector."""
    return balltree.top_k(table(spark, sf_dir, "embeddings"), divisor=100, k=10)


@query
def op2_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op3_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens, along the curve."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by a Jaccard similarity of 0.8 or more over five-word shingles."""
    return jaccard.join(table(spark, sf_dir, "documents"))


@query
def jaccard_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of each document at that similarity, counted, and its class of equal sets."""
    return jaccard.link_counts(table(spark, sf_dir, "documents"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learns from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in the flat token files written of all documents."""
    folder = scratch_table(spark, "tokens")
    written = tokenfiles.write_token_files(table(spark, sf_dir, "documents"), folder)
    counted = tokenfiles.count_tokens(spark, folder).join(written, ["file", "ordinal"])
    counts = stored(counted.select("doc_id", "n_tokens"), "counts")
    drop_table(spark, folder)
    return counts


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that an earlier 100-byte string repeats."""
    return substrings.dedup(table(spark, sf_dir, "documents"))


@query
def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all sources by weights 1, 2, 3."""
    mix = mixing.pareto_mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query
def op10_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors found for every fiftieth vector."""
    return collisions.nearest(table(spark, sf_dir, "embeddings"), divisor=50, k=5)


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle moved to the end, and what is rebuilt from that."""
    made = fim.transform(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


@query
def op12_walsh_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components in 16 clusters after three rounds."""
    found = walsh.cluster(table(spark, sf_dir, "embeddings"), clusters=16, rounds=3)
    numbers = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return found.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(numbers.cast("binary"), 256).alias("centroid_sha256")
    )


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts and the document of each that stays."""
    return exact.dedup(table(spark, sf_dir, "documents"), digests=True)

"""Token counts of documents in flat token files, by a separator scan.

A file holds the ids of its documents one after another, each document closed by a separator
id, and nothing else: no index, no lengths.  Files are read in blocks of bytes, each by any task;
a block yields the places of its separators.  A prefix scan over the blocks of a file
carries the number of documents and the last separator before a block, and so stitches
documents that cross blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costlens.sources.storage import open_path

from .common import steps, stored, tasks
from .tokens import STEP, Encoder

#: Bytes of a block.
BLOCK = 4 << 20
#: Separator: the vocabulary's end-of-text id, which text itself never gets here.
SEPARATOR = 50256


def write_token_files(docs: DataFrame, folder: str, separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """One flat file for each partition of ``docs(doc_id, text)``; returns ``file, ordinal, doc_id``.

    A task writes under a name of its attempt and renames at the end, so a repeated task leaves the same file.
    ``folder`` must be one that all executors reach.
    """
    kind = {2: "<u2", 4: "<u4"}[width]

    def rows(batches):
        context = TaskContext.get()
        name = f"{folder}/tokens-{context.partitionId():06d}.bin"
        system, path = open_path(name)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        attempt = f"{path}.{context.taskAttemptId()}.tmp"
        encoder, ordinal = Encoder(plain_specials=True), 0
        with system.open_output_stream(attempt) as out:
            for batch in steps(batches, "text", STEP):
                ids, ends = encoder.encode(batch.column("text"))
                flat = np.insert(ids, ends[1:], separator)
                out.write(flat.astype(kind).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.rpartition("/")[2]] * n), pa.array(np.arange(ordinal, ordinal + n)), batch.column("doc_id")], ["file", "ordinal", "doc_id"]
                )
                ordinal += n
        system.move(attempt, path)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "file string, ordinal long, doc_id long")
    return stored(found, "manifest")


def count_tokens(spark: SparkSession, folder: str, separator: int = SEPARATOR, width: int = 2, block: int = BLOCK) -> DataFrame:
    """``file, ordinal, n_tokens, closed`` for each document of the token files (``*.bin``) in ``folder``.

    A document with no ids counts 0.  Ids after the last separator are a last document that is not ``closed``;
    an empty file has no documents.  A file that ends within an id is refused.
    """
    kind = {2: "<u2", 4: "<u4"}[width]
    if block % width:
        raise ValueError("a block must hold whole ids")
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
        .select("path", "length").where("length > 0")
    )
    blocks = files.select("path", "length", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block).cast("long"))).alias("block", "offset"))
    blocks = blocks.repartition(tasks(blocks), "path", "block")

    def scan(batches):
        for batch in batches:
            for path, length, number, offset in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "block", "offset"))):
                if length % width:
                    raise ValueError(f"{path} ends within an id")
                system, inner = open_path(path)
                with system.open_input_file(inner) as source:
                    ids = np.frombuffer(source.read_at(min(block, length - offset), offset), kind)
                ends = np.flatnonzero(ids == separator) + offset // width
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.rpartition("/")[2]]), pa.array([number], pa.int32()), pa.array([length // width]),
                     pa.array([len(ends)], pa.int64()), pa.array([ends[-1] if len(ends) else None], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                    ["file", "block", "ids", "n", "last", "ends"],
                )

    found = stored(blocks.mapInArrow(scan, "file string, block int, ids long, n long, last long, ends array<long>"), "blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select(
        "file", "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("documents"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"),
    )
    closed = (
        found.where("n > 0").select("file", "block", "ends").join(carried, ["file", "block"])
        .select("file", "documents", "carry", "ends", F.posexplode("ends").alias("i", "end"))
        .select(
            "file", (F.col("documents") + F.col("i")).alias("ordinal"),
            (F.col("end") - F.when(F.col("i") == 0, F.col("carry")).otherwise(F.element_at("ends", F.greatest(F.col("i"), F.lit(1)))) - 1).alias("n_tokens"),
            F.lit(True).alias("closed"),
        )
    )
    whole = found.groupBy("file").agg(F.first("ids").alias("ids"), F.sum("n").alias("n"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"))
    left = whole.where("ids > last + 1").select(
        "file", F.col("n").alias("ordinal"), (F.col("ids") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("closed")
    )
    return closed.unionByName(left)

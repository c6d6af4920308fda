"""What the operators of this folder share: sessions, shared storage, folds and pickling."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import keelstate
from keelstate.sources.files import shared_folder

# Functions travel to the executors by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[keelstate.__name__])

#: Rows and bytes of one Arrow batch: bounds what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20

#: Whether the shuffle files of frames that are made now go when their run ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The fold that no model may learn from: crc32(doc_id as text) mod FOLDS == HELD_OUT.
FOLDS, HELD_OUT = 4, 2


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches, and see that a checkpoint folder is set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    shared_folder(spark)
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of frames that are made and run inside go with the end of their run.

    Otherwise they stay until the driver happens to collect garbage, however many steps that is away.
    """
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)


def settled(frame: DataFrame) -> DataFrame:
    """The frame's checkpoint; no shuffle files stay."""
    with cleaned(frame.sparkSession):
        return frame.select("*").checkpoint()


def store(frame: DataFrame, path: str) -> None:
    """Write the frame as Parquet; no shuffle files stay."""
    with cleaned(frame.sparkSession):
        frame.select("*").write.parquet(path)


def fresh(frame: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    while name in frame.columns:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """The SHA-256 of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("binary"), F.lit(b"")), 256))


def one_each(rows: DataFrame, mark: str) -> DataFrame:
    """(doc_id, text, mark) with one row for each doc_id, the first by a digest of its text.

    The choice combines before the shuffle, so an id that repeats often reaches nobody as many rows.
    """
    first = F.struct(F.sha2(F.col("text").cast("binary"), 256), mark)
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("text", mark), first).alias("row")).select("doc_id", "row.text", f"row.{mark}")


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold that nothing is learnt from; a null id does."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def sampled_labels(labels: DataFrame, column: str, limit: int) -> list[tuple[int, int]]:
    """At most `limit` (doc_id, label) rows of the training folds, the first by a hash of the id.

    A document with several labels counts with the smallest; null ids and labels are left out.
    The bound keeps what reaches the driver the same at every size of the table.
    """
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
        .collect()
    )
    return [(row.doc_id, row.label) for row in rows]

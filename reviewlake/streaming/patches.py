"""Screening decisions as a stream of patches."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewlake.operators.screening import latest_patches, patch_problem
from reviewlake.scale import lookup

PATCH_SCHEMA = (
    "record_index BIGINT, decision STRING, exclusion_reasons ARRAY<STRING>, ts TIMESTAMP, seq BIGINT"
)


UNKNOWN = "unknown_record"


def checked_batch(batch: DataFrame, known: DataFrame | None) -> DataFrame:
    """Patches with ``code``, why they are refused; null for those to apply.

    ``known (record_index)`` lists the records there are, each once; without it
    every index is taken to exist. A null index is that of no record.
    """
    checked = batch.withColumn("code", patch_problem())
    if known is None:
        return checked
    # Each index is looked up once, however many patches of the batch are on it.
    asked = batch.groupBy("record_index").agg(F.count("*").alias("patches"))
    there = known.select("record_index", F.lit(True).alias("there"))
    found = lookup(checked, asked.join(there, "record_index"), ["record_index"], "patches", "seq")
    missing = F.when(F.col("there").isNull(), UNKNOWN)
    return found.withColumn("code", F.coalesce("code", missing)).drop("there")


def write_batch(batch: DataFrame, epoch: int, folder: str, known: DataFrame | None = None) -> None:
    """One file set per micro-batch, replaced when the batch is run again.

    The source is read once; both tables are written from the checked rows.
    """
    checked = checked_batch(batch, known).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        good, refused = F.col("code").isNull(), F.col("code").isNotNull()
        latest = latest_patches(checked.where(good).drop("code"))
        latest.write.mode("overwrite").parquet(f"{folder}/accepted/epoch={epoch}")
        checked.where(refused).write.mode("overwrite").parquet(f"{folder}/refused/epoch={epoch}")
    finally:
        checked.unpersist()


def stream_patches(
    patches: DataFrame,
    folder: str,
    checkpoint: str,
    once: bool = True,
    known: DataFrame | None = None,
) -> StreamingQuery:
    """Reduce every micro-batch to the latest patch per record and store it.

    A batch that runs again writes the same files, so nothing counts twice, and
    the state is on storage only. Late patches need no watermark: the greatest
    ``(ts, seq)`` wins whenever it comes. Patches on records that are not among
    ``known`` are refused; the table is read anew by every batch.
    """
    writer = patches.writeStream.foreachBatch(
        lambda batch, epoch: write_batch(batch, epoch, folder, known)
    ).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stored_patches(df: DataFrame) -> DataFrame:
    """The latest stored patch per record over all micro-batches."""
    order = F.struct("ts", "seq")
    return df.groupBy("record_index").agg(
        F.max_by(F.struct("new_decision", "new_reasons", "ts", "seq"), order).alias("p")
    ).select("record_index", "p.*")


def accepted(spark: SparkSession, folder: str, merged: int | None = None) -> DataFrame:
    """Stored patches, several per record: the merge up to an epoch and the epochs after it.

    Without ``merged`` all epochs are read as they were written.
    """
    epochs = spark.read.parquet(f"{folder}/accepted")
    if merged is None:
        return epochs.drop("epoch")
    later = epochs.where(F.col("epoch") > merged).drop("epoch")
    return spark.read.parquet(f"{folder}/compacted/upto={merged}").unionByName(later)


def compact(spark: SparkSession, folder: str, upto: int, merged: int | None = None) -> None:
    """Merge the accepted patches of all epochs up to a finished one.

    It starts from an earlier merge, if one is named, so each epoch is read once.
    A merge that runs again replaces its own files; those of the epochs stay.
    """
    epochs = spark.read.parquet(f"{folder}/accepted").where(F.col("epoch") <= upto)
    if merged is None:
        parts = epochs.drop("epoch")
    else:
        before = spark.read.parquet(f"{folder}/compacted/upto={merged}")
        parts = before.unionByName(epochs.where(F.col("epoch") > merged).drop("epoch"))
    stored_patches(parts).write.mode("overwrite").parquet(f"{folder}/compacted/upto={upto}")


def apply_stored(
    base: DataFrame,
    stored: DataFrame,
    decision_column: str = "include",
    reason_column: str = "exclude_reasons",
) -> DataFrame:
    """The screening table after the stored patches."""
    from reviewlake.functions.text import stored_decision

    changed = F.col("new_decision").isNotNull()
    return (
        base.join(stored_patches(stored).drop("ts", "seq"), "record_index", "left")
        .withColumns(
            {
                decision_column: F.when(changed, stored_decision("new_decision")).otherwise(
                    F.col(decision_column)
                ),
                reason_column: F.when(changed, F.col("new_reasons")).otherwise(F.col(reason_column)),
            }
        )
        .select(base.columns)
    )

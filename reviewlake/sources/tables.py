"""Result tables: partitioned, bucketed by week, replaced by name, resumed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions.text import monday_of

DYNAMIC = {"partitionOverwriteMode": "dynamic"}


def write_by_backend(
    df: DataFrame, folder: str, week_of: Column | None = None, file_format: str = "parquet"
) -> None:
    """One partition per backend; with a date also one per week.

    Only the partitions that have rows are replaced, so a second run in the
    same week overwrites the first.
    """
    keys = ["backend"]
    if week_of is not None:
        df, keys = df.withColumn("week", monday_of(week_of)), ["week", "backend"]
    options = {"header": True} if file_format == "csv" else {}
    (
        df.write.mode("overwrite")
        .options(**DYNAMIC, **options)
        .partitionBy(*keys)
        .format(file_format)
        .save(folder)
    )


def write_named(tables: dict[str, DataFrame], folder: str, file_format: str = "parquet") -> None:
    """One table per name; named tables are replaced, others stay."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(file_format).save(f"{folder}/{name}")


def read_named(spark: SparkSession, folder: str, name: str, file_format: str = "parquet") -> DataFrame:
    return spark.read.format(file_format).load(f"{folder}/{name}")


def write_bundles(df: DataFrame, folder: str, key: str, file_format: str = "parquet") -> None:
    """One partition per reviewer or per split."""
    options = {"header": True} if file_format == "csv" else {}
    df.write.mode("overwrite").options(**options).partitionBy(key).format(file_format).save(folder)


def evaluator_name(day: Column, evaluator: Column) -> Column:
    """``YYYYMMDD-evaluatorNN`` of a reviewer counted from 0."""
    number = F.lpad((evaluator + 1).cast("string"), 2, "0")
    return F.concat(F.date_format(day, "yyyyMMdd"), F.lit("-evaluator"), number)


def split_name(split_no: Column) -> Column:
    """Four digits of a bundle counted from 1."""
    return F.lpad(split_no.cast("string"), 4, "0")


def stale_files(files: DataFrame, digests: DataFrame, key: str = "path") -> DataFrame:
    """Files whose content does not match its stored digest, or has none.

    ``files (key, content)``, ``digests (key, sha256)``; result
    ``(key, sha256, status)`` with status ``missing`` or ``changed``.
    """
    actual = files.select(key, F.sha2("content", 256).alias("sha256"))
    stored = digests.select(key, F.trim("sha256").alias("_stored"))
    return (
        actual.join(stored, key, "left")
        .where(~F.col("_stored").eqNullSafe(F.col("sha256")))
        .select(
            key,
            "sha256",
            F.when(F.col("_stored").isNull(), "missing").otherwise("changed").alias("status"),
        )
    )


def read_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Files as ``(path, content)``."""
    return spark.read.format("binaryFile").load(pattern).select("path", "content")


def not_yet_done(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs without an output row."""
    return inputs.join(done.select(key), key, "left_anti")


def resume(spark: SparkSession, inputs: DataFrame, output: str, key: str, step) -> DataFrame:
    """Run ``step`` on the inputs without output, append, return all output."""
    try:
        todo = not_yet_done(inputs, spark.read.parquet(output), key)
    except Exception as error:  # the first run has no output yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        todo = inputs
    step(todo).write.mode("append").parquet(output)
    return spark.read.parquet(output)

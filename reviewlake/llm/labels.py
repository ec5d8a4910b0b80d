"""Labelled rows for the classifiers, and what is held out from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.scale import cut_lineage

# Most labelled ids, and most different rows of theirs, a classifier is trained
# on: those with the lowest hashes, so the sample does not depend on the order of rows.
SAMPLE_ROWS = 20_000


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether a document's labels are kept for testing; a null id never is."""
    return F.coalesce(
        F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False)
    )


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, keep: Column, sample: int = SAMPLE_ROWS
) -> DataFrame:
    """``(doc_id, digest, text, y)`` of the bounded sample, ``digest`` a hash of the text.

    ``keep`` says by ``doc_id`` which labels may be used. Several labels of one
    document count as the largest. Different texts under one id are as many
    examples, equal rows are one, and ``sample`` bounds ids and examples alike,
    so an id with very many rows brings no more than that. Both lists are of at
    most ``sample`` rows and broadcast. Null texts are examples too; other
    columns are not read; without labels or documents the sample is empty.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep)
        .groupBy("doc_id")
        .agg(F.max(F.col(label)).cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    examples = cut_lineage(
        rows.select("doc_id", "digest")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "digest")
        .agg(F.first("y").alias("y"), F.count("*").alias("copies"))
        .orderBy(F.xxhash64("doc_id", "digest"), "doc_id", "digest")
        .limit(sample)
    )

    def texts(of: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(of.drop("copies")), ["doc_id", "digest"])

    # Texts pass a shuffle only where rows are repeated.
    single, repeated = texts(examples.where("copies = 1")), examples.where("copies > 1")
    if repeated.isEmpty():
        return single
    # Equal hashes of different texts, should there be any, count as one text.
    return single.unionByName(texts(repeated).dropDuplicates(["doc_id", "digest"]))

"""Distribution of studies to reviewers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.scale import hash_index, id_index


def assign_reviewers(
    studies: DataFrame,
    id_col: str,
    evaluators: int,
    per_study: int,
    criteria: Sequence[str] = (),
) -> DataFrame:
    """Give every study ``per_study`` distinct reviewers; loads differ by one at most.

    Study number j goes to reviewers ``(j * per_study + t) mod evaluators``.
    Score columns of the criteria start at 0.
    """
    if not 1 <= per_study <= evaluators:
        raise ValueError(f"reviewers per study must be between 1 and {evaluators}, got {per_study}")
    numbered = id_index(studies, id_col, "study_index")
    turn = F.explode(F.sequence(F.lit(0), F.lit(per_study - 1))).alias("turn")
    return (
        numbered.select("*", turn)
        .withColumn(
            "evaluator",
            F.pmod(F.col("study_index") * per_study + F.col("turn"), F.lit(evaluators)).cast("int"),
        )
        .drop("turn")
        .withColumns({c: F.lit(0.0) for c in criteria})
    )


def reviewer_loads(assigned: DataFrame, evaluators: int) -> DataFrame:
    """Studies per reviewer, reviewers without any included."""
    everyone = assigned.sparkSession.range(evaluators).select(F.col("id").cast("int").alias("evaluator"))
    counts = assigned.groupBy("evaluator").agg(F.count("*").alias("load"))
    return everyone.join(counts, "evaluator", "left").withColumn("load", F.coalesce("load", F.lit(0)))


def split_bundles(
    records: DataFrame,
    count: int,
    id_col: str = "cluster_id",
    seed: int = 0,
    digest: Column | None = None,
) -> DataFrame:
    """Random disjoint bundles 1…count; the first ones get the odd records.

    The order is a seeded hash of the id, so a rerun gives the same bundles.
    """
    if id_col not in records.columns:
        raise ValueError(f"records must contain a {id_col!r} column")
    shuffled = digest if digest is not None else F.md5(F.concat_ws("-", F.lit(seed), F.col(id_col)))
    placed = hash_index(records, shuffled, id_col, "_place")
    total = records.agg(F.count("*")).scalar()
    size, longer = F.floor(total / F.lit(count)), F.pmod(total, F.lit(count))
    place, cut = F.col("_place"), longer * (size + 1)
    # When there are fewer records than bundles every record is before the cut.
    bundle = F.when(place < cut, F.floor(place / (size + 1))).otherwise(
        longer + F.floor((place - cut) / F.greatest(size, F.lit(1)))
    )
    return placed.withColumn("split_no", (bundle + 1).cast("int")).drop("_place")

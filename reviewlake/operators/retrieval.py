"""Quality of a search result against known-good records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import comparison_key
from reviewlake.scale import cut_lineage

DEFAULT_COLUMNS = ("doi",)


def key_set(df: DataFrame, columns: Sequence[str], *extra: str, drop_blank: bool = False) -> DataFrame:
    """Distinct comparison keys, kept per ``extra`` columns."""
    keys = df.select(*extra, comparison_key(columns, df.columns).alias("key"))
    if drop_blank:
        keys = keys.where(F.regexp_replace("key", "_", "") != "")
    return keys.distinct()


def _ratio(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def search_quality(
    judgments: DataFrame,
    results: DataFrame,
    columns: Sequence[str] = DEFAULT_COLUMNS,
    judgment: str | None = None,
    drop_blank: bool = False,
) -> DataFrame:
    """Precision, recall, F1, Jaccard and Dice over distinct keys; 0/0 is 0.

    With ``judgment`` one row per judgement set in that column, else one row.
    Blank keys match each other unless ``drop_blank`` is set.
    """
    found = key_set(results, columns, drop_blank=drop_blank)
    if judgment is None:
        judged = key_set(judgments, columns, drop_blank=drop_blank)
        # One outer join counts all three sets in one pass over both sides.
        sides = judged.withColumn("j", F.lit(1)).join(found.withColumn("r", F.lit(1)), "key", "full")
        counts = sides.agg(
            F.count_if(F.col("j").isNotNull() & F.col("r").isNotNull()).alias("tp"),
            F.count_if(F.col("r").isNull()).alias("fn"),
            F.count_if(F.col("j").isNull()).alias("fp"),
        )
        group = []
    else:
        judged = key_set(judgments, columns, judgment, drop_blank=drop_blank)
        # The keys are read twice, the search behind them should run once.
        found = cut_lineage(found)
        counts = (
            judged.join(found.withColumn("r", F.lit(1)), "key", "left")
            .groupBy(judgment)
            .agg(F.count("r").alias("tp"), (F.count("*") - F.count("r")).alias("fn"))
        )
        # The result size is one number, so it comes in as a scalar subquery.
        counts = counts.withColumn("fp", found.agg(F.count("*")).scalar() - F.col("tp"))
        group = [judgment]
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scored = counts.withColumns(
        {"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn)}
    )
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumns(
        {
            "f1": _ratio(2 * p * r, p + r),
            "jaccard": _ratio(tp, tp + fp + fn),
            "dice": _ratio(2 * tp, 2 * tp + fp + fn),
            "columns": F.lit("; ".join(columns)),
        }
    ).select(
        *group, "columns", "tp", "fp", "fn", "precision", "recall", "f1", "jaccard", "dice"
    )

"""Agreement of two raters on labels: Cohen's kappa and disagreements."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LABELS = ("include", "exclude")
RIGHT_SUFFIX = "_right"


def paired_decisions(
    left: DataFrame, right: DataFrame, key: str, attributes: Sequence[str]
) -> DataFrame:
    """Long table ``(key, attribute, left, right)`` of common, decided records."""
    a = left.select(key, *[F.col(x).cast("string").alias(f"l_{i}") for i, x in enumerate(attributes)])
    b = right.select(key, *[F.col(x).cast("string").alias(f"r_{i}") for i, x in enumerate(attributes)])
    items = F.array(
        *[
            F.struct(
                F.lit(x).alias("attribute"),
                F.col(f"l_{i}").alias("left"),
                F.col(f"r_{i}").alias("right"),
            )
            for i, x in enumerate(attributes)
        ]
    )
    pairs = a.join(b, key).select(key, F.inline(items))
    return pairs.where(F.col("left").isNotNull() & F.col("right").isNotNull())


def agreement_band(kappa: Column) -> Column:
    return (
        F.when(kappa.isNull() | F.isnan(kappa), "undefined")
        .when(kappa <= 0, "chance agreement")
        .when(kappa <= 0.29, "poor agreement")
        .when(kappa <= 0.40, "fair agreement")
        .when(kappa <= 0.60, "moderate agreement")
        .when(kappa <= 0.80, "substantial agreement")
        .otherwise("almost perfect agreement")
    )


def kappa_of_pairs(pairs: DataFrame, labels: Sequence[str] = DEFAULT_LABELS) -> DataFrame:
    """Kappa per attribute of a ``(attribute, left, right)`` table.

    Pairs with a label outside the list do not count. All cells of the
    confusion matrix that matter come from one partial aggregation.
    """
    known = pairs.where(F.col("left").isin(*labels) & F.col("right").isin(*labels))
    counts = [F.count("*").alias("n"), F.count_if(F.col("left") == F.col("right")).alias("agreed")]
    for i, label in enumerate(labels):
        counts.append(F.count_if(F.col("left") == label).alias(f"_l{i}"))
        counts.append(F.count_if(F.col("right") == label).alias(f"_r{i}"))
    n = F.col("n").cast("double")
    products = [F.col(f"_l{i}").cast("double") * F.col(f"_r{i}") for i in range(len(labels))]
    expected = reduce(lambda a, b: a + b, products) / n
    score = F.when(n - expected == 0, F.lit(float("nan"))).otherwise(
        1 - (n - F.col("agreed")) / (n - expected)
    )
    return (
        known.groupBy("attribute")
        .agg(*counts)
        .select("attribute", "n", "agreed", score.alias("score"))
        .withColumn("agreement", agreement_band(F.col("score")))
    )


def kappa_score(
    left: DataFrame,
    right: DataFrame,
    key: str,
    attributes: Sequence[str],
    labels: Sequence[str] = DEFAULT_LABELS,
    names: tuple[str, str] = ("left", "right"),
) -> DataFrame:
    """One row per attribute: raters, kappa, band and disagreement table name."""
    stats = kappa_of_pairs(paired_decisions(left, right, key, attributes), labels)
    return stats.select(
        F.lit(names[0]).alias("left"),
        F.lit(names[1]).alias("right"),
        "attribute",
        "n",
        "agreed",
        "score",
        "agreement",
        F.concat(F.lit("disagreements on "), F.col("attribute")).alias("diff_table"),
    )


def disagreements(
    left: DataFrame,
    right: DataFrame,
    key: str,
    attribute: str,
    names: tuple[str, str] = ("left", "right"),
    extra: Sequence[str] = (),
) -> DataFrame:
    """Records both raters decided differently, with the rest of the left row."""
    renamed = right.where(F.col(attribute).isNotNull()).select(
        key,
        F.col(attribute).alias(f"{names[1]}_decision"),
        *[F.col(c).alias(f"{c}{RIGHT_SUFFIX}") for c in extra],
    )
    rest = [c for c in left.columns if c not in {key, attribute, *extra}]
    return (
        left.where(F.col(attribute).isNotNull())
        .join(renamed, key)
        .where(F.col(attribute) != F.col(f"{names[1]}_decision"))
        .select(
            key,
            F.col(attribute).alias(f"{names[0]}_decision"),
            f"{names[1]}_decision",
            *extra,
            *[f"{c}{RIGHT_SUFFIX}" for c in extra],
            *rest,
        )
    )

"""Numeric ratings: errors against a ground truth and intra-class correlation.

Ratings are long tables ``(attribute, id, rater, value)``; no matrix is built
on one machine. A metric is a function of Columns, so a user metric runs as a
built-in partial aggregation like the ones here.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.scale import HEAVY_KEYS, cut_lineage, lookup, range_index

Metric = Callable[[Column, Column], Column]
NAN = float("nan")
STATISTICS = {"average score": "avg", "minimum score": "min", "maximum score": "max"}
KEYS = ("attribute", "id")
# With at most so many raters the ratings of a record are put into one row.
ROW_PLACES = 1_024


def long_ratings(df: DataFrame, id_col: str, rater: Column | str, attributes: Sequence[str]) -> DataFrame:
    """Wide rating table to ``(attribute, id, rater, value)``."""
    who = F.lit(rater) if isinstance(rater, str) else rater
    items = F.array(
        *[
            F.struct(F.lit(a).alias("attribute"), F.col(a).cast("double").alias("value"))
            for a in attributes
        ]
    )
    return df.select(F.col(id_col).alias("id"), who.alias("rater"), F.inline(items)).select(
        "attribute", "id", "rater", "value"
    )


def mean_of_repeats(ratings: DataFrame) -> DataFrame:
    """One rating per rater and record: the mean of repeated ones."""
    return ratings.groupBy(*KEYS, "rater").agg(F.avg("value").alias("value"))


def ground_truth(ratings: DataFrame) -> DataFrame:
    """Mean, least and greatest rating per attribute and record."""
    return ratings.groupBy(*KEYS).agg(
        F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def mae(truth: Column, predicted: Column) -> Column:
    return F.avg(F.abs(truth - predicted))


def rmse(truth: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg((truth - predicted) * (truth - predicted)))


def lin_ccc(x: Column, y: Column) -> Column:
    """Lin's concordance correlation with sample moments."""
    gap = F.avg(x) - F.avg(y)
    spread = F.var_samp(x) + F.var_samp(y) + gap * gap
    return F.when((F.count("*") < 2) | (spread == 0), F.lit(NAN)).otherwise(
        2 * F.covar_samp(x, y) / spread
    )


METRICS: Mapping[str, Metric] = {"mae": mae, "rmse": rmse, "ccc": lin_ccc}


def compare_with_truth(
    ratings: DataFrame, evaluated: DataFrame, metrics: Mapping[str, Metric] = METRICS
) -> DataFrame:
    """Metrics of evaluated ratings against each statistic of the trusted ones.

    An evaluated record without trusted ratings is an error.
    """
    rated = evaluated.select(*KEYS, F.col("value").alias("predicted"))
    truth = ground_truth(ratings).withColumn("_rated", F.lit(True))
    joined = rated.join(truth, list(KEYS), "left")
    missing = F.raise_error(F.concat(F.lit("no trusted rating for id "), F.col("id").cast("string")))
    # A record whose trusted ratings are all null is rated, without a value.
    checked = joined.withColumn(
        "avg", F.when(F.col("_rated").isNull(), missing.cast("double")).otherwise(F.col("avg"))
    )
    items = F.array(
        *[
            F.struct(F.lit(label).alias("ground_truth"), F.col(stat).alias("truth"))
            for label, stat in STATISTICS.items()
        ]
    )
    long = checked.select("attribute", "predicted", F.inline(items))
    values = [F.round(m(F.col("truth"), F.col("predicted")), 4).alias(n) for n, m in metrics.items()]
    return long.groupBy("attribute", "ground_truth").agg(*values)


def metric_report(
    ratings: DataFrame,
    evaluated: DataFrame,
    metric: str,
    attributes: Sequence[str],
    evaluator: str,
    metrics: Mapping[str, Metric] = METRICS,
) -> DataFrame:
    """One row per ground truth statistic, one column per attribute."""
    table = compare_with_truth(ratings, evaluated, {metric: metrics[metric]})
    return (
        table.groupBy("ground_truth")
        .pivot("attribute", list(attributes))
        .agg(F.first(metric))
        .select(F.lit(evaluator).alias("evaluator"), "ground_truth", *attributes)
    )


def unmatched_ids(ratings: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Evaluated records that have no trusted rating."""
    return evaluated.select(*KEYS).join(ratings.select(*KEYS), list(KEYS), "left_anti")


def numbered_raters(ratings: DataFrame) -> DataFrame:
    """``(rater, n, place)``: the raters in order of their names, with their ratings."""
    counts = ratings.groupBy("rater").agg(F.count("*").alias("n"))
    return range_index(counts, ["rater"], "place")


def fixed_matrix(
    ratings: DataFrame, zero_is_missing: bool = True, raters: DataFrame | None = None
) -> DataFrame:
    """One rating per record and rater; gaps filled with the record's mean.

    A rating of 0 counts as missing, and a record of zeros stays zero, unless
    ``zero_is_missing`` is off. The matrix is in long form and has as many rows
    as it has cells; ``raters`` comes from :func:`numbered_raters`.
    """
    raters = numbered_raters(ratings) if raters is None else raters
    count = raters.count()
    value = F.nullif("value", F.lit(0.0)) if zero_is_missing else F.col("value")
    rated = ratings.groupBy(*KEYS, "rater").agg(F.avg("value").alias("value"))
    rated, last = rated.withColumn("value", value), F.lit(count - 1).cast("long")
    if count <= HEAVY_KEYS:
        given = rated.join(F.broadcast(raters.select("rater", "place")), "rater")
    else:
        given = lookup(rated, raters, ["rater"], "n", "id", how="inner")
    given = given.select(*KEYS, "place", "value")
    places = F.sequence(F.lit(0).cast("long"), last) if count else F.array().cast("array<bigint>")
    if count <= ROW_PLACES:
        # The cells of a record fit one row, so its gaps are known without a join.
        cells = F.collect_list(F.struct("place", "value")).alias("_cells")
        records = given.groupBy(*KEYS).agg(F.avg("value").alias("_mean"), cells)
        gaps = F.array_except(places, F.transform("_cells", lambda c: c["place"]))
        empty = F.transform(
            gaps, lambda p: F.struct(p.alias("place"), F.lit(None).cast("double").alias("value"))
        )
        full = records.select(*KEYS, "_mean", F.inline(F.concat("_cells", empty)))
        # A record without an id has no cells of its own, as in a join.
        known = F.col("attribute").isNotNull() & F.col("id").isNotNull()
        own = F.when(known, F.col("value"))
    else:
        grid = given.groupBy(*KEYS).agg(F.avg("value").alias("_mean")).select(
            *KEYS, "_mean", F.explode(places).alias("place")
        )
        full, own = grid.join(given, [*KEYS, "place"], "left"), F.col("value")
    return full.select(
        *KEYS,
        F.concat(F.lit("rater_"), F.col("place").cast("string")).alias("rater"),
        F.coalesce(own, "_mean", F.lit(0.0)).alias("value"),
    )


def random_matrix(ratings: DataFrame, seed: int = 0, order: Column | None = None) -> DataFrame:
    """The same number of ratings per record, drawn in a seeded hash order.

    The number is the least any record of the attribute has. The greatest of
    these numbers is read first, so Spark trims each record's ratings before the
    shuffle and a record with very many ratings never fills one task.
    """
    sizes = ratings.groupBy(*KEYS).agg(F.count("*").alias("n")).groupBy("attribute")
    least = cut_lineage(sizes.agg(F.min("n").alias("k"), F.sum("n").alias("n")))
    greatest = least.agg(F.max("k")).first()[0]
    if greatest is None:
        return ratings.limit(0)
    draw = order if order is not None else F.xxhash64(F.lit(seed), F.col("id"), F.col("rater"))
    window = Window.partitionBy(*KEYS).orderBy(draw, "rater")
    ranked = ratings.withColumn("_rank", F.row_number().over(window))
    ranked = ranked.where(F.col("_rank") <= greatest)
    drawn = lookup(ranked, least, ["attribute"], "n", "id", how="inner")
    return drawn.where(F.col("_rank") <= F.col("k")).select(
        *KEYS, F.concat(F.lit("rater_"), (F.col("_rank") - 1).cast("string")).alias("rater"), "value"
    )


def with_evaluated(matrix: DataFrame, evaluated: DataFrame, name: str = "evaluated") -> DataFrame:
    """Add the evaluated rater as the last one; only common records stay.

    ``matrix`` is a fixed or random matrix, whose first rater is ``rater_0``.
    """
    last = evaluated.select(*KEYS, F.col("value").alias("_last"))
    own = F.struct("rater", "value")
    # The first rater's row of a record brings in the evaluated one.
    extra = F.struct(F.lit(name).alias("rater"), F.col("_last").alias("value"))
    rows = F.when(F.col("rater") == "rater_0", F.array(own, extra)).otherwise(F.array(own))
    return matrix.join(last, list(KEYS)).select(*KEYS, F.inline(rows))


def mean_squares(ratings: DataFrame) -> DataFrame:
    """Per attribute: n, k and the mean squares of a complete rating table.

    ``msr`` between records, ``msc`` between raters, ``mse`` residual, ``msw``
    within records.
    """
    rows = ratings.groupBy(*KEYS).agg(
        F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count("*")).alias("within"),
        F.count("*").alias("k"),
    )
    by_row = rows.groupBy("attribute").agg(
        F.count("*").alias("n"),
        F.max("k").alias("k"),
        (F.var_pop("mean") * F.count("*")).alias("row_spread"),
        F.sum("within").alias("ssw"),
    )
    columns = ratings.groupBy("attribute", "rater").agg(F.avg("value").alias("mean"))
    by_column = columns.groupBy("attribute").agg(
        (F.var_pop("mean") * F.count("*")).alias("column_spread")
    )
    n, k = F.col("n"), F.col("k")
    ssr, ssc = k * F.col("row_spread"), n * F.col("column_spread")
    sse = F.col("ssw") - ssc
    return by_row.join(by_column, "attribute").select(
        "attribute",
        "n",
        "k",
        F.try_divide(ssr, n - 1).alias("msr"),
        F.try_divide(ssc, k - 1).alias("msc"),
        F.try_divide(sse, (n - 1) * (k - 1)).alias("mse"),
        F.try_divide(F.col("ssw"), n * (k - 1)).alias("msw"),
    )


MatrixMetric = Callable[[Mapping[str, Column]], Column]


def icc_one_way(m: Mapping[str, Column]) -> Column:
    return F.try_divide(m["msr"] - m["msw"], m["msr"] + (m["k"] - 1) * m["msw"])


def icc_random(m: Mapping[str, Column]) -> Column:
    total = m["msr"] + (m["k"] - 1) * m["mse"] + m["k"] * (m["msc"] - m["mse"]) / m["n"]
    return F.try_divide(m["msr"] - m["mse"], total)


def icc_fixed(m: Mapping[str, Column]) -> Column:
    return F.try_divide(m["msr"] - m["mse"], m["msr"] + (m["k"] - 1) * m["mse"])


# name -> (metric, reads the random matrix)
MATRIX_METRICS: Mapping[str, tuple[MatrixMetric, bool]] = {
    "ICC1": (icc_one_way, True),
    "ICC2": (icc_random, True),
    "ICC3": (icc_fixed, False),
}


def matrix_metrics(ratings: DataFrame, metrics: Mapping[str, MatrixMetric]) -> DataFrame:
    """``(attribute, n, k, names…)``; NaN without two records and two raters."""
    squares = mean_squares(ratings)
    columns = {c: F.col(c) for c in squares.columns}
    values = [
        F.round(F.coalesce(metric(columns), F.lit(NAN)), 4).alias(name)
        for name, metric in metrics.items()
    ]
    return squares.select("attribute", "n", "k", *values)


def icc(ratings: DataFrame) -> DataFrame:
    """The three coefficients of one complete rating table."""
    return matrix_metrics(ratings, {n.lower(): metric for n, (metric, _) in MATRIX_METRICS.items()})


def matrix_report(
    ratings: DataFrame,
    evaluated: DataFrame,
    attributes: Sequence[str],
    evaluator: str,
    seed: int = 0,
    order: Column | None = None,
    metrics: Mapping[str, tuple[MatrixMetric, bool]] = MATRIX_METRICS,
) -> DataFrame:
    """One row per metric, one column per attribute."""
    table = None
    for random in (True, False):
        chosen = {n: metric for n, (metric, drawn) in metrics.items() if drawn == random}
        if not chosen:
            continue
        if random:
            matrix = random_matrix(ratings, seed, order)
        else:
            matrix = fixed_matrix(ratings)
        # Row and column means both read the cells; build them once.
        values = matrix_metrics(cut_lineage(with_evaluated(matrix, evaluated)), chosen)
        items = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in chosen]
        rows = values.select("attribute", F.inline(F.array(*items)))
        table = rows if table is None else table.unionByName(rows)
    return (
        table.groupBy("metric")
        .pivot("attribute", list(attributes))
        .agg(F.first("value"))
        .select(F.lit(evaluator).alias("evaluator"), "metric", *attributes)
    )

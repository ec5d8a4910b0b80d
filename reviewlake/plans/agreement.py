"""Rater agreement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.operators import agreement as ag
from reviewlake.operators import ratings as rt
from reviewlake.plans.registry import query, table
from reviewlake.scale import cut_lineage

_BAND = """
    CASE WHEN score IS NULL THEN 'undefined' WHEN score <= 0 THEN 'chance agreement'
         WHEN score <= 0.29 THEN 'poor agreement' WHEN score <= 0.40 THEN 'fair agreement'
         WHEN score <= 0.60 THEN 'moderate agreement' WHEN score <= 0.80 THEN 'substantial agreement'
         ELSE 'almost perfect agreement' END
"""
_KAPPA = """
    cells AS (SELECT attribute, l, r, count(*) AS c FROM pairs
              WHERE l IN ('include', 'exclude') AND r IN ('include', 'exclude') GROUP BY ALL),
    n AS (SELECT attribute, sum(c) AS n, sum(CASE WHEN l = r THEN c ELSE 0 END) AS agreed
          FROM cells GROUP BY attribute),
    rows_ AS (SELECT attribute, l AS label, sum(c) AS c FROM cells GROUP BY ALL),
    cols_ AS (SELECT attribute, r AS label, sum(c) AS c FROM cells GROUP BY ALL),
    chance AS (SELECT attribute, sum(CAST(rows_.c AS DOUBLE) * cols_.c) AS products
               FROM rows_ JOIN cols_ USING (attribute, label) GROUP BY attribute),
    kappa AS (SELECT attribute, n, agreed,
                (CAST(agreed AS DOUBLE) / n - products / n / n) / (1 - products / n / n) AS score
              FROM n JOIN chance USING (attribute))
"""


_LABEL_PAIRS = """
    pairs AS (SELECT doc_id, 'decision' AS attribute,
                CASE WHEN quality = 1 THEN 'include' ELSE 'exclude' END AS l,
                CASE WHEN toxic = 0 THEN 'include' ELSE 'exclude' END AS r FROM labels)
"""


def _raters(spark, folder):
    labels = table(spark, folder, "labels")
    left = labels.select(
        "doc_id",
        F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("decision"),
        "quality",
    )
    right = labels.select(
        "doc_id", F.when(F.col("toxic") == 0, "include").otherwise("exclude").alias("decision"), "toxic"
    )
    return left, right


@query(
    f"""
    WITH {_LABEL_PAIRS}, {_KAPPA}
    SELECT attribute, CAST(n AS BIGINT) AS n, CAST(agreed AS BIGINT) AS agreed,
           round(score, 6) AS score, {_BAND} AS agreement FROM kappa
    """
)
def kappa(spark, folder):
    left, right = _raters(spark, folder)
    stats = ag.kappa_score(left, right, "doc_id", ["decision"], names=("quality", "toxic"))
    return stats.select("attribute", "n", "agreed", F.round("score", 6).alias("score"), "agreement")


@query(
    f"""
    WITH {_LABEL_PAIRS}
    SELECT doc_id, l AS quality_decision, r AS toxic_decision, quality
    FROM pairs JOIN labels USING (doc_id) WHERE l <> r
    """
)
def kappa_disagreements(spark, folder):
    left, right = _raters(spark, folder)
    return ag.disagreements(left, right, "doc_id", "decision", names=("quality", "toxic"))


@query(
    f"""
    WITH pairs AS (
      SELECT 'status' AS attribute,
             CASE o_orderstatus WHEN 'F' THEN 'include' WHEN 'O' THEN 'exclude' END AS l,
             CASE WHEN o_totalprice >= 250000 THEN 'include' ELSE 'exclude' END AS r FROM orders
      UNION ALL
      SELECT 'priority', CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'include'
                              WHEN o_orderpriority = '5-LOW' THEN 'unsure' ELSE 'exclude' END,
             CASE WHEN o_orderpriority < '3' OR o_totalprice > 400000 THEN 'include' ELSE 'exclude' END
      FROM orders), {_KAPPA}
    SELECT 'first' AS "left", 'second' AS "right", attribute, round(score, 6) AS score,
           {_BAND} AS agreement, 'disagreements on ' || attribute AS diff_table FROM kappa
    """
)
def kappa_multi_attribute(spark, folder):
    orders = table(spark, folder, "orders")
    price, rank = F.col("o_totalprice"), F.col("o_orderpriority")
    first = orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "include")
        .when(F.col("o_orderstatus") == "O", "exclude")
        .alias("status"),
        F.when(rank.isin("1-URGENT", "2-HIGH"), "include")
        .when(rank == "5-LOW", "unsure")
        .otherwise("exclude")
        .alias("priority"),
    )
    second = orders.select(
        "o_orderkey",
        F.when(price >= 250000, "include").otherwise("exclude").alias("status"),
        F.when((rank < "3") | (price > 400000), "include").otherwise("exclude").alias("priority"),
    )
    stats = ag.kappa_score(
        first, second, "o_orderkey", ["status", "priority"], names=("first", "second")
    )
    return stats.select(
        "left", "right", "attribute", F.round("score", 6).alias("score"), "agreement", "diff_table"
    )


# Raters are line numbers, records are orders, repeated lines are averaged.
_RATINGS = """
    lines AS (
      SELECT 'quantity' AS attribute, l_orderkey AS id, l_linenumber AS line, l_quantity AS value
      FROM lineitem
      UNION ALL SELECT 'tax', l_orderkey, l_linenumber, l_tax * 100 FROM lineitem),
    ratings AS (SELECT attribute, id, 'line' || line AS rater, avg(value) AS value
                FROM lines WHERE line <> 4 GROUP BY ALL),
    evaluated AS (SELECT attribute, id, avg(value) AS value FROM lines e WHERE line = 4
                  AND EXISTS (SELECT 1 FROM ratings r WHERE r.attribute = e.attribute AND r.id = e.id)
                  GROUP BY ALL),
    truth AS (SELECT attribute, id, avg(value) AS a, min(value) AS lo, max(value) AS hi
              FROM ratings GROUP BY ALL),
    stats AS (
      SELECT attribute, 'average score' AS ground_truth, a AS t, value AS p
      FROM truth JOIN evaluated USING (attribute, id)
      UNION ALL SELECT attribute, 'minimum score', lo, value FROM truth JOIN evaluated USING (attribute, id)
      UNION ALL SELECT attribute, 'maximum score', hi, value FROM truth JOIN evaluated USING (attribute, id))
"""


def _ratings(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_tax") * 100).alias("tax"),
    )

    def rated(rows):
        rater = F.concat(F.lit("line"), F.col("line").cast("string"))
        return rt.mean_of_repeats(rt.long_ratings(rows, "id", rater, ["quantity", "tax"]))

    # The queries read the ratings more than once.
    trusted = cut_lineage(rated(lines.where(F.col("line") != 4)))
    evaluated = rated(lines.where(F.col("line") == 4)).drop("rater")
    # An order with its fourth line only has no truth to compare with.
    return trusted, evaluated.join(trusted.select(*rt.KEYS).distinct(), list(rt.KEYS), "left_semi")


@query(
    f"""
    WITH {_RATINGS}
    SELECT attribute, id, round(a, 4) AS "avg", round(lo, 4) AS "min", round(hi, 4) AS "max" FROM truth
    """
)
def ground_truth(spark, folder):
    trusted, _ = _ratings(spark, folder)
    return rt.ground_truth(trusted).withColumns({c: F.round(c, 4) for c in ("avg", "min", "max")})


@query(
    """
    SELECT DISTINCT 'quantity' AS attribute, l_orderkey AS id FROM lineitem l WHERE l_linenumber = 4
      AND NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_orderkey = l.l_orderkey AND o.l_linenumber <> 4)
    """
)
def unmatched_ids(spark, folder):
    """Orders whose fourth line is the only one have no truth to compare with."""
    lines = table(spark, folder, "lineitem").select(
        F.lit("quantity").alias("attribute"),
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("line"),
    )
    evaluated = lines.where(F.col("line") == 4).drop("line").distinct()
    return rt.unmatched_ids(lines.where(F.col("line") != 4), evaluated)


def _metric_sql(value: str) -> str:
    return f"""
    WITH {_RATINGS},
         m AS (SELECT attribute, ground_truth, round({value}, 4) AS v FROM stats GROUP BY ALL)
    SELECT 'line4' AS evaluator, ground_truth,
           max(CASE WHEN attribute = 'quantity' THEN v END) AS quantity,
           max(CASE WHEN attribute = 'tax' THEN v END) AS tax
    FROM m GROUP BY ground_truth
    """


def _metric(name):
    def run(spark, folder):
        trusted, evaluated = _ratings(spark, folder)
        return rt.metric_report(trusted, evaluated, name, ["quantity", "tax"], "line4")

    return run


query(_metric_sql("avg(abs(t - p))"), "mae")(_metric("mae"))
query(_metric_sql("sqrt(avg((t - p) * (t - p)))"), "rmse")(_metric("rmse"))
query(
    _metric_sql(
        "2 * covar_samp(t, p) / (var_samp(t) + var_samp(p) + (avg(t) - avg(p)) * (avg(t) - avg(p)))"
    ),
    "lin_ccc",
)(_metric("ccc"))

_FIXED = """
    raters AS (SELECT DISTINCT rater FROM ratings),
    ids AS (SELECT DISTINCT attribute, id FROM ratings),
    grid AS (SELECT attribute, id, rater, nullif(value, 0) AS value
             FROM ids CROSS JOIN raters LEFT JOIN ratings USING (attribute, id, rater)),
    fixed AS (SELECT attribute, id, rater,
                coalesce(value, avg(value) OVER (PARTITION BY attribute, id), 0) AS value FROM grid)
"""
_RANDOM = """
    sizes AS (SELECT attribute, min(n) AS k FROM (
                SELECT attribute, id, count(*) AS n FROM ratings GROUP BY ALL) GROUP BY attribute),
    ranked AS (SELECT *, row_number() OVER (
                 PARTITION BY attribute, id ORDER BY md5(CAST(id AS VARCHAR) || '-' || rater), rater) AS rn
               FROM ratings),
    drawn AS (SELECT attribute, id, rn, value FROM ranked JOIN sizes USING (attribute) WHERE rn <= k)
"""


def _draw():
    return F.md5(F.concat_ws("-", F.col("id").cast("string"), F.col("rater")))


@query(
    f"""
    WITH {_RATINGS}, {_FIXED}
    SELECT attribute, id, 'rater_' || (dense_rank() OVER (ORDER BY rater) - 1) AS rater,
           round(value, 4) AS value FROM fixed
    """
)
def fixed_matrix(spark, folder):
    trusted, _ = _ratings(spark, folder)
    return rt.fixed_matrix(trusted).withColumn("value", F.round("value", 4))


@query(
    f"""
    WITH {_RATINGS}, {_RANDOM}
    SELECT attribute, id, 'rater_' || (rn - 1) AS rater, round(value, 4) AS value FROM drawn
    """
)
def random_matrix(spark, folder):
    trusted, _ = _ratings(spark, folder)
    return rt.random_matrix(trusted, order=_draw()).withColumn("value", F.round("value", 4))


def _icc_sql(matrix: str) -> str:
    """Mean squares from the cells of a complete matrix, cell by cell."""
    return f"""
    full_ AS (SELECT attribute, id, rater, value FROM {matrix} SEMI JOIN evaluated USING (attribute, id)
              UNION ALL SELECT attribute, id, 'evaluated', value FROM evaluated
              SEMI JOIN {matrix} USING (attribute, id)),
    means AS (SELECT *, avg(value) OVER (PARTITION BY attribute) AS g,
                avg(value) OVER (PARTITION BY attribute, id) AS mi,
                avg(value) OVER (PARTITION BY attribute, rater) AS mj FROM full_),
    sums AS (SELECT attribute, CAST(count(DISTINCT id) AS DOUBLE) AS n,
               CAST(count(DISTINCT rater) AS DOUBLE) AS k, sum((mi - g) ** 2) AS ssr,
               sum((mj - g) ** 2) AS ssc, sum((value - g) ** 2) AS sst FROM means GROUP BY attribute),
    ms AS (SELECT attribute, n, k, ssr / (n - 1) AS msr, ssc / (k - 1) AS msc,
             (sst - ssr - ssc) / ((n - 1) * (k - 1)) AS mse, (sst - ssr) / (n * (k - 1)) AS msw
           FROM sums)
    """


@query(
    f"""
    WITH {_RATINGS}, {_FIXED}, {_icc_sql("fixed")}
    SELECT attribute, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k,
           round((msr - msw) / (msr + (k - 1) * msw), 4) AS icc1,
           round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 4) AS icc2,
           round((msr - mse) / (msr + (k - 1) * mse), 4) AS icc3
    FROM ms
    """
)
def icc_forms(spark, folder):
    trusted, evaluated = _ratings(spark, folder)
    matrix = rt.fixed_matrix(trusted)
    return rt.icc(cut_lineage(rt.with_evaluated(matrix, evaluated)))


@query(
    f"""
    WITH {_RATINGS}, {_FIXED}, {_RANDOM},
    cells AS (SELECT attribute, id, 'rater_' || rn AS rater, value FROM drawn),
    by_fixed AS (WITH {_icc_sql("fixed")} SELECT * FROM ms),
    by_random AS (WITH {_icc_sql("cells")} SELECT * FROM ms),
    report AS (
      SELECT 'ICC1' AS metric, attribute, round((msr - msw) / (msr + (k - 1) * msw), 4) AS v FROM by_random
      UNION ALL SELECT 'ICC2', attribute,
        round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 4) FROM by_random
      UNION ALL SELECT 'ICC3', attribute, round((msr - mse) / (msr + (k - 1) * mse), 4) FROM by_fixed)
    SELECT 'line4' AS evaluator, metric, max(CASE WHEN attribute = 'quantity' THEN v END) AS quantity,
           max(CASE WHEN attribute = 'tax' THEN v END) AS tax
    FROM report GROUP BY metric
    """
)
def icc_report(spark, folder):
    trusted, evaluated = _ratings(spark, folder)
    return rt.matrix_report(trusted, evaluated, ["quantity", "tax"], "line4", order=_draw())

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlake.operators import agreement as ag
from reviewlake.operators import ratings as rt
from reviewlake.operators.retrieval import search_quality


def quality(spark, judged, found, **kw):
    j = spark.createDataFrame([(x,) for x in judged], "doi string")
    r = spark.createDataFrame([(x,) for x in found], "doi string")
    row = search_quality(j, r, **kw).first()
    return [round(row[c], 4) for c in ("precision", "recall", "f1", "jaccard", "dice")]


def test_search_quality(spark):
    got = quality(spark, ["alpha", "beta", "gamma"], ["alpha", "beta", "delta", "epsilon"])
    assert got == [0.5, 0.6667, 0.5714, 0.4, 0.5714]
    assert quality(spark, [" A ", "", "a"], ["a", None, "x"]) == [0.6667, 1.0, 0.8, 0.6667, 0.8]
    assert quality(spark, ["a", ""], [None, "a"], drop_blank=True) == [1.0] * 5
    assert quality(spark, [], []) == [0.0] * 5
    assert quality(spark, ["a"], []) == [0.0] * 5


def test_search_quality_per_judgement(spark):
    j = spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "c")], "set string, doi string")
    r = spark.createDataFrame([("a",), ("c",)], "doi string")
    rows = {x["set"]: x for x in search_quality(j, r, judgment="set").collect()}
    assert (rows["u"]["tp"], rows["u"]["fn"], rows["u"]["fp"]) == (1, 1, 1)
    assert (rows["v"]["tp"], rows["v"]["fn"], rows["v"]["fp"]) == (1, 0, 1)


A = ["include", "exclude"] * 4
B = ["include", "exclude", "include", "exclude", "exclude", "exclude", "include", "include"]


def raters(spark, a, b):
    def table(x):
        return spark.createDataFrame([(f"study-{i}", v, f"t{i}") for i, v in enumerate(x, 1)], "id string, d string, title string")

    return table(a), table(b)


def test_kappa_and_disagreements(spark):
    left, right = raters(spark, A, B)
    row = ag.kappa_score(left, right, "id", ["d"], names=("a", "b")).first()
    assert round(row["score"], 2) == 0.5 and row["agreement"] == "moderate agreement"
    diff = ag.disagreements(left, right, "id", "d", names=("a", "b"))
    assert diff.columns == ["id", "a_decision", "b_decision", "title"]
    assert sorted(r["id"] for r in diff.collect()) == ["study-5", "study-8"]
    wide = ag.disagreements(left, right, "id", "d", names=("a", "b"), extra=["title"])
    assert wide.columns == ["id", "a_decision", "b_decision", "title", "title_right"]


def test_kappa_edge_cases(spark):
    left, right = raters(spark, ["include"] * 3, ["include"] * 3)
    row = ag.kappa_score(left, right, "id", ["d"]).first()
    assert math.isnan(row["score"]) and row["agreement"] == "undefined"
    left, right = raters(spark, ["include", None, "maybe", "exclude"], ["include", "include", "include", "exclude"])
    row = ag.kappa_score(left, right, "id", ["d"]).first()
    assert row["n"] == 2 and row["score"] == 1.0 and row["agreement"] == "almost perfect agreement"


@pytest.mark.parametrize(
    "kappa, band",
    [(-0.1, "chance"), (0.0, "chance"), (0.2, "poor"), (0.35, "fair"), (0.5, "moderate"), (0.7, "substantial"), (0.81, "almost perfect"), (1.0, "almost perfect")],
)
def test_bands(spark, kappa, band):
    got = spark.range(1).select(ag.agreement_band(F.lit(kappa)).alias("b")).first()["b"]
    assert got == f"{band} agreement"


TRUSTED_A = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
TRUSTED_B = [1.5, 2.0, 2.5, 4.5, 4.5, 6.5]
EVALUATED = [1.0, 2.5, 3.5, 4.0, 5.5, 6.0]


def long(spark, columns, attribute="score"):
    rows = [(attribute, f"s{i}", r, float(v)) for r, col in columns.items() for i, v in enumerate(col) if v is not None]
    return spark.createDataFrame(rows, "attribute string, id string, rater string, value double")


def test_errors_against_ground_truth(spark):
    trusted = long(spark, {"a": TRUSTED_A, "b": TRUSTED_B})
    evaluated = long(spark, {"e": EVALUATED}).drop("rater")
    rows = {r["ground_truth"]: r for r in rt.compare_with_truth(trusted, evaluated).collect()}
    want = {"average score": (0.4583, 0.5103, 0.9568), "minimum score": (0.4167, 0.6124, 0.9408), "maximum score": (0.5, 0.5, 0.958)}
    assert {k: (r["mae"], r["rmse"], r["ccc"]) for k, r in rows.items()} == want
    report = rt.metric_report(trusted, evaluated, "mae", ["score"], "me").collect()
    assert {r["ground_truth"]: r["score"] for r in report} == {k: v[0] for k, v in want.items()}


def test_missing_truth_is_an_error(spark):
    trusted = long(spark, {"a": [1.0]})
    evaluated = long(spark, {"e": [1.0, 2.0]}).drop("rater")
    with pytest.raises(Exception, match="no trusted rating"):
        rt.compare_with_truth(trusted, evaluated).collect()
    assert [r["id"] for r in rt.unmatched_ids(trusted, evaluated).collect()] == ["s1"]


def ccc(spark, x, y):
    df = spark.createDataFrame(list(zip(map(float, x), map(float, y))), "x double, y double")
    return df.agg(rt.lin_ccc(F.col("x"), F.col("y")).alias("c")).first()["c"]


def test_lin_ccc(spark):
    x = [1, 2, 3, 4, 5]
    assert round(ccc(spark, x, x), 4) == 1 and round(ccc(spark, x, x[::-1]), 4) == -1
    assert round(ccc(spark, x, [1.1, 1.9, 3.2, 3.8, 5.1]), 4) == 0.9945
    assert math.isnan(ccc(spark, [2, 2], [2, 2])) and math.isnan(ccc(spark, [1], [2]))
    assert ccc(spark, [1, 1, 1], [1, 2, 3]) == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-50, 50), st.floats(-50, 50)), min_size=3, max_size=12))
def test_ccc_is_symmetric(spark, pairs):
    x, y = zip(*pairs)
    a, b = ccc(spark, x, y), ccc(spark, y, x)
    assert (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, abs_tol=1e-9)


def icc(spark, columns):
    row = rt.icc(long(spark, columns)).first()
    return row["icc1"], row["icc2"], row["icc3"]


def test_icc(spark):
    table = [(9, 2, 5, 8), (6, 1, 3, 2), (8, 4, 6, 8), (7, 1, 2, 6), (10, 5, 6, 9), (6, 2, 4, 7)]
    assert icc(spark, {f"r{j}": [row[j] for row in table] for j in range(4)}) == (0.1657, 0.2898, 0.7148)
    assert icc(spark, {r: [1, 2, 3] for r in "abc"}) == (1, 1, 1)
    noise = [(1, 9, 4), (1, 8, 4), (1, 8, 5)]
    assert all(v <= 0 for v in icc(spark, {f"r{j}": [row[j] for row in noise] for j in range(3)}))
    assert all(math.isnan(v) for v in icc(spark, {"a": [1, 1], "b": [1, 1]}))
    assert all(math.isnan(v) for v in icc(spark, {"a": [1, 2]}))
    assert icc(spark, {"a": TRUSTED_A, "b": TRUSTED_B, "e": EVALUATED}) == (0.9607, 0.9607, 0.9584)


def cells(df):
    return {(r["id"], r["rater"]): r["value"] for r in df.collect()}


def test_fixed_matrix(spark):
    ratings = long(spark, {"r1": [1, 2, 0], "r2": [3, None, 0]})
    got = cells(rt.fixed_matrix(ratings))
    assert got == {("s0", "rater_0"): 1, ("s0", "rater_1"): 3, ("s1", "rater_0"): 2, ("s1", "rater_1"): 2, ("s2", "rater_0"): 0, ("s2", "rater_1"): 0}
    kept = cells(rt.fixed_matrix(long(spark, {"r1": [0], "r2": [4]}), zero_is_missing=False))
    assert kept == {("s0", "rater_0"): 0, ("s0", "rater_1"): 4}


def test_random_matrix_draws_k_of_each(spark):
    ratings = long(spark, {"r1": [1, 2, 3], "r2": [4, 5, None], "r3": [7, 8, 9]})
    got = cells(rt.random_matrix(ratings, seed=3))
    assert len(got) == 6 and {k[1] for k in got} == {"rater_0", "rater_1"}
    assert got == cells(rt.random_matrix(ratings, seed=3))
    assert {got[("s2", "rater_0")], got[("s2", "rater_1")]} == {3, 9}


def test_matrix_report(spark):
    trusted = long(spark, {"a": TRUSTED_A, "b": TRUSTED_B})
    evaluated = long(spark, {"e": EVALUATED}).drop("rater")
    rows = {r["metric"]: r["score"] for r in rt.matrix_report(trusted, evaluated, ["score"], "e").collect()}
    assert rows["ICC3"] == 0.9584 and rows["ICC1"] == 0.9607 and set(rows) == {"ICC1", "ICC2", "ICC3"}


def test_null_trusted_ratings_are_no_missing_ones(spark):
    ddl = "attribute string, id string, rater string, value double"
    trusted = spark.createDataFrame([("q", "s1", "a", None), ("q", "s2", "a", 2.0)], ddl)
    evaluated = spark.createDataFrame([("q", "s1", "e", 1.0), ("q", "s2", "e", 3.0)], ddl)
    got = rt.compare_with_truth(trusted, evaluated).where("ground_truth = 'average score'").first()
    assert got["mae"] == 1.0


def test_fixed_matrix_fills_gaps_in_one_row(spark, monkeypatch):
    """Cells of a record are not joined with a grid; many raters still give the same cells."""
    ratings = spark.createDataFrame(
        [("a", 1, "x", 2.0), ("a", 1, "y", 4.0), ("a", 2, "z", 0.0), ("a", None, "x", 1.0), ("a", None, "y", 3.0)],
        "attribute string, id long, rater string, value double",
    )
    fewer = rt.fixed_matrix(ratings)
    plan = fewer._jdf.queryExecution().optimizedPlan().toString()
    # One join numbers the raters, one brings in their numbers.
    assert plan.count("Join ") == 2
    monkeypatch.setattr(rt, "ROW_PLACES", 0)
    monkeypatch.setattr(rt, "HEAVY_KEYS", 0)
    key = lambda r: (r["attribute"], str(r["id"]), r["rater"])
    assert sorted(fewer.collect(), key=key) == sorted(rt.fixed_matrix(ratings).collect(), key=key)
    assert len(fewer.collect()) == 9

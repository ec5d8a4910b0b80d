import pytest
from pyspark.sql import functions as F

from reviewlake.operators import answers as an

CRITERIA = [
    an.Criterion("c1", "Design", "Is it sound?", "soundness", "0-1"),
    an.Criterion("c2", "Report", "Is it clear?", "clarity", "0-1"),
    an.Criterion("c3", "Design", "Is it new?", "novelty", "0-1"),
]


def parsed(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["p"] for r in df.select("i", fn("t").alias("p")).orderBy("i").collect()]


def test_answers_plain_fenced_and_broken(spark):
    texts = ['{"answer": "include"}', '```json\n{"answer": "exclude", "justification": "a"}\n```', "nope", '{"answer": "x"}', None]
    got = parsed(spark, texts, an.parse_verdict)
    assert got[0]["answer"] == "include" and got[1]["justification"] == "a" and got[2:] == [None] * 3
    scores = parsed(spark, ['{"score": 1.5, "reason": "r"}', '{"score": "bad"}', '{"reason": "r"}'], lambda c: an.parse_answer(c, an.SCORE_SCHEMA))
    assert scores[0]["score"] == 1.5 and scores[1:] == [None, None]


def test_usable_score(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (None,)], "s double")
    assert [r[0] for r in df.select(an.usable_score(F.col("s"))).collect()] == [None, 2.0, None]
    assert [r[0] for r in df.select(an.usable_score(F.col("s"), True)).collect()] == [0.0, 2.0, None]


def test_prompts(spark):
    df = spark.createDataFrame([("T", None, "x")], "title string, abstract string, skip string")
    assert df.select(an.row_prompt(df.columns, ["skip"]).alias("p")).first()["p"] == "title: T\nabstract: "
    text = an.selection_prompt("topic", [("I", "in")], [("E", "out")], "more")
    assert all(x in text for x in ("topic", "**I**: in", "**E**: out", "more"))


def failing(system, user):
    if "boom" in user:
        raise RuntimeError("no answer")
    return '{"answer": "include"}' if "good" in user else '`{"answer": "exclude", "justification": "j"}`'


def test_select_studies(spark):
    rows = [(0, "good", None, None), (1, "bad", None, None), (2, "boom", None, "kept"), (3, "good", "exclude", "before"), (4, "good", None, None)]
    df = spark.createDataFrame(rows, "id long, title string, include string, exclude_reason string")
    got = {r["id"]: (r["include"], r["exclude_reason"]) for r in an.select_studies(df, "id", "s", failing, limit=3).collect()}
    assert got == {0: ("include", ""), 1: ("exclude", "j"), 2: (None, "kept"), 3: ("exclude", "before"), 4: (None, None)}


def test_ask_repeats_and_keeps_failures_apart(spark, tmp_path):
    log = str(tmp_path / "calls")

    def flaky(system, user):
        with open(log, "a") as f:
            f.write("x")
        calls = len(open(log).read())
        return "bad" if calls < 3 else '{"answer": "include"}'

    df = spark.createDataFrame([("s", "u")], "system_prompt string, user_prompt string").coalesce(1)
    asked = an.ask(df, flaky, attempts=4, accept=lambda t: t.startswith("{"))
    asked = asked.withColumn("parsed", an.parse_verdict("raw_answer"))
    assert asked.first()["parsed"]["answer"] == "include"
    assert asked.count() == 1 and len(open(log).read()) == 3
    boom = an.ask(df.withColumn("user_prompt", F.lit("boom")), failing).withColumn("parsed", an.parse_verdict("raw_answer"))
    good, bad = an.split_failures(boom)
    assert good.count() == 0 and "no answer" in bad.first()["error"]


def score(system, user):
    if "clarity" in system:
        return '{"score": 0, "reason": "zero"}'
    if "novelty" in system and "p1" in user:
        return "no idea"
    return '```json\n{"score": 0.5, "reason": "fine"}\n```'


def test_assess_quality(spark):
    papers = spark.createDataFrame([(0, "p0", "7"), (1, "p1", "x"), (2, None, "8")], "id long, text string, c1 string")
    scores = an.assess_quality(papers.where("text is not null"), "id", "text", CRITERIA, "t", score)
    rows = {r["id"]: r for r in an.with_scores(papers, "id", scores, CRITERIA).collect()}
    assert (rows[0]["c1"], rows[0]["c2"], rows[0]["c3"]) == (0.5, None, 0.5)
    assert (rows[1]["c1"], rows[1]["c3"]) == (0.5, None)
    assert rows[2]["c1"] == 8.0 and rows[2]["evaluation"] is None
    assert rows[0]["evaluation"] == (
        "\n# Design\n\n1. **Is it sound?**\nfine\n\n3. **Is it new?**\nfine\n"
        f"\n# Report\n\n2. **Is it clear?**\n{an.UNSCORED}\n"
    )


def test_criteria_table(spark):
    rows = [(2, "b", "c", "q", "d", "s"), (1, "a", "c", "q", "d", "s")]
    df = spark.createDataFrame(rows, "ord int, label string, category string, question string, description string, scoring string")
    assert [c.label for c in an.criteria_from(df, "ord")] == ["a", "b"]
    with pytest.raises(ValueError):
        an.criteria_from(df.withColumn("label", F.lit("x")), "ord")

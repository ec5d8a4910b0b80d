"""Questions to an answer generator and what becomes of its answers.

The generator is a plug-in ``answer(system_prompt, user_prompt) -> str``. It
runs inside ``mapInPandas``, once per row, and its answers are checkpointed, so
a lost executor or a later action does not ask again what has been answered.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.scale import CONFIG_ROWS, config_rows, cut_lineage

AnswerFn = Callable[[str, str], str]

# Shape of the two kinds of answers.
VERDICT_SCHEMA = "answer STRING, justification STRING"
SCORE_SCHEMA = "score DOUBLE, reason STRING"
UNSCORED = "left unscored: no usable score was returned"
MAX_ATTEMPTS = 3


@dataclass(frozen=True)
class Criterion:
    """A question of a quality assessment."""

    label: str
    category: str
    question: str
    description: str = ""
    scoring: str = ""


def criteria_from(df: DataFrame, order: str) -> list[Criterion]:
    """Criteria of a small configuration table, in ``order``; labels are unique."""
    names = ["label", "category", "question", "description", "scoring"]
    rows = config_rows(df.orderBy(order).select(*names), "criteria")
    found = [Criterion(**row.asDict()) for row in rows]
    labels = [c.label for c in found]
    if not found or len(set(labels)) != len(labels):
        raise ValueError("criteria need at least one item and unique labels")
    return found


def pending(df: DataFrame, order: str, verdict: str = "include", limit: int | None = None) -> DataFrame:
    """Rows without a verdict, the first ``limit`` of them if given."""
    if verdict not in df.columns:
        df = df.withColumn(verdict, F.lit(None).cast("string"))
    rows = df.where(F.col(verdict).isNull())
    return rows if limit is None else rows.orderBy(order).limit(limit)


def row_prompt(columns: Sequence[str], ignored: Sequence[str] = ()) -> Column:
    """``name: value`` lines of a row, without the ignored columns."""
    lines = [
        F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))
        for c in columns
        if c not in set(ignored)
    ]
    return F.concat_ws("\n", *lines)


def selection_prompt(
    topic: str,
    inclusion: Sequence[tuple[str, str]],
    exclusion: Sequence[tuple[str, str]],
    context: str | None = None,
) -> str:
    """System prompt for include / exclude verdicts."""

    def listed(items: Sequence[tuple[str, str]]) -> str:
        return "\n".join(f"* **{label}**: {text}" for label, text in items)

    parts = [
        "Decide from title and abstract whether a study belongs to a literature review.",
        f"Topic: {topic}",
        context or "",
        f"A study is included only if it meets all of these:\n{listed(inclusion)}",
        f"A study is excluded if it meets any of these:\n{listed(exclusion)}",
        'Answer with JSON only: {"answer": "include"} or '
        '{"answer": "exclude", "justification": "labels of the criteria, comma-separated"}',
    ]
    return "\n\n".join(p for p in parts if p)


def score_prompt(topic: str, criterion: Column) -> Column:
    """System prompt for the score of one criterion (struct column)."""
    return F.concat_ws(
        "\n\n",
        F.lit("Assess the quality of the study below, strictly from its text."),
        F.lit(f"Topic: {topic}"),
        criterion["description"],
        F.concat(F.lit("Scoring: "), criterion["scoring"]),
        F.lit('Answer with JSON only: {"score": number, "reason": "brief justification"}'),
    )


def with_criteria(papers: DataFrame, criteria: Sequence[Criterion]) -> DataFrame:
    """One row per paper and criterion, without a join.

    The criteria are a literal array, so each task expands its own papers.
    """
    if len(criteria) > CONFIG_ROWS:
        raise ValueError(f"more than {CONFIG_ROWS} criteria")
    items = [
        F.struct(
            F.lit(i).alias("ord"),
            *[
                F.lit(getattr(c, n)).alias(n)
                for n in ("label", "category", "question", "description", "scoring")
            ],
        )
        for i, c in enumerate(criteria, 1)
    ]
    return papers.select("*", F.explode(F.array(*items)).alias("criterion"))


def ask(
    questions: DataFrame,
    answer: AnswerFn,
    system: str = "system_prompt",
    user: str = "user_prompt",
    attempts: int = MAX_ATTEMPTS,
    accept: Callable[[str], bool] | None = None,
) -> DataFrame:
    """Add ``raw_answer`` and ``error`` to every question.

    A call that raises, or whose text is not accepted, is repeated inside the
    task. A row that fails to the end keeps its error and stops nothing else.
    """
    schema = T.StructType(
        [
            *questions.schema.fields,
            T.StructField("raw_answer", T.StringType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def one(system_prompt: str, user_prompt: str) -> tuple[str | None, str | None]:
        text, problem = None, None
        for _ in range(attempts):
            try:
                text, problem = answer(system_prompt, user_prompt), None
            except Exception as error:  # noqa: BLE001 - reported in the row
                problem = f"{type(error).__name__}: {error}"
                continue
            if accept is None or accept(text):
                break
        return text, problem

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = [one(s, u) for s, u in zip(batch[system], batch[user])]
            yield batch.assign(
                raw_answer=[r[0] for r in results], error=[r[1] for r in results]
            )

    return cut_lineage(questions.mapInPandas(run, schema))


def split_failures(asked: DataFrame, parsed: str = "parsed") -> tuple[DataFrame, DataFrame]:
    """Answered rows and failed rows."""
    failed = F.col("error").isNotNull() | F.col(parsed).isNull()
    return asked.where(~failed), asked.where(failed)


def strip_fence(text: Column | str) -> Column:
    """The text from its first to its last brace, or as it is without the two."""
    c = F.col(text) if isinstance(text, str) else text
    first, behind = F.instr(c, "{"), F.instr(F.reverse(c), "}")
    size = F.length(c) - behind - first + 2
    return F.when((first > 0) & (behind > 0) & (size > 0), F.substring(c, first, size)).otherwise(c)


def parse_answer(text: Column | str, schema: str) -> Column:
    """Struct of the JSON answer; null when it is none."""
    parsed = F.from_json(strip_fence(text), schema)
    first = schema.split()[0]
    return F.when(parsed[first].isNotNull(), parsed)


def parse_verdict(text: Column | str) -> Column:
    """Verdict struct; null unless the answer is include or exclude."""
    parsed = parse_answer(text, VERDICT_SCHEMA)
    return F.when(parsed["answer"].isin("include", "exclude"), parsed)


def exclude_reason(verdict: Column, old: Column | None = None) -> Column:
    """Justification of an exclusion, '' for an inclusion, else the old value."""
    before = old if old is not None else F.lit(None).cast("string")
    return (
        F.when(verdict["answer"] == "exclude", verdict["justification"])
        .when(verdict["answer"] == "include", F.lit(""))
        .otherwise(before)
    )


def usable_score(score: Column, zero_is_valid: bool = False) -> Column:
    """A score of 0 is no usable score unless ``zero_is_valid``."""
    return score if zero_is_valid else F.nullif(score, F.lit(0.0))


def fill_back(base: DataFrame, results: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Write result columns onto the base; rows without a result keep theirs."""
    found = results.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    old = {c: F.col(c) if c in base.columns else F.lit(None) for c in columns}
    joined = base.join(found, key, "left").withColumns(
        {c: F.coalesce(F.col(f"_new_{c}"), old[c]) for c in columns}
    )
    return joined.drop(*[f"_new_{c}" for c in columns])


def select_studies(
    records: DataFrame,
    key: str,
    system_prompt: str,
    answer: AnswerFn,
    ignored: Sequence[str] = (),
    limit: int | None = None,
    attempts: int = MAX_ATTEMPTS,
) -> DataFrame:
    """Verdicts for the pending records, written back with their reasons."""
    hidden = {"include", "exclude_reason", *ignored}
    questions = pending(records, key, "include", limit).select(
        key,
        F.lit(system_prompt).alias("system_prompt"),
        row_prompt(records.columns, sorted(hidden)).alias("user_prompt"),
    )
    asked = ask(questions, answer, attempts=attempts)
    verdicts = asked.select(key, parse_verdict("raw_answer").alias("v")).select(
        key, F.col("v.answer").alias("include"), exclude_reason(F.col("v")).alias("exclude_reason")
    )
    return fill_back(records, verdicts, key, ["include", "exclude_reason"])


def assess_quality(
    papers: DataFrame,
    key: str,
    text: str,
    criteria: Sequence[Criterion],
    topic: str,
    answer: AnswerFn,
    attempts: int = MAX_ATTEMPTS + 1,
    zero_is_valid: bool = False,
) -> DataFrame:
    """Ask for every criterion of every paper; long ``(key, criterion, score, reason)``."""
    asked = with_criteria(papers.select(key, text), criteria).select(
        key,
        "criterion",
        score_prompt(topic, F.col("criterion")).alias("system_prompt"),
        F.col(text).alias("user_prompt"),
    )

    def scored(raw: str) -> bool:
        try:
            found = json.loads(raw[raw.find("{") : raw.rfind("}") + 1])
            return bool(found.get("score")) or (zero_is_valid and found.get("score") == 0)
        except (ValueError, AttributeError):
            return False

    parsed = ask(asked, answer, attempts=attempts, accept=scored).withColumn(
        "parsed", parse_answer("raw_answer", SCORE_SCHEMA)
    )
    score = usable_score(F.col("parsed.score"), zero_is_valid)
    return parsed.select(
        key,
        "criterion",
        score.alias("score"),
        F.when(score.isNotNull(), F.col("parsed.reason")).otherwise(F.lit(UNSCORED)).alias("reason"),
        "error",
    )


def score_columns(scores: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    """One score column per criterion label."""
    flat = scores.select(key, F.col("criterion.label").alias("label"), "score")
    return flat.groupBy(key).pivot("label", list(labels)).agg(F.first("score", ignorenulls=True))


def evaluation_text(scores: DataFrame, key: str) -> DataFrame:
    """``(key, evaluation)``: numbered answers under category headings.

    Categories come in the order of their first question. A paper has one
    answer per criterion, so the collected lists are as short as the criteria.
    """
    entry = F.concat(
        F.col("criterion.ord").cast("string"),
        F.lit(". **"),
        F.col("criterion.question"),
        F.lit("**\n"),
        F.coalesce("reason", F.lit("")),
    )
    blocks = (
        scores.select(
            key,
            F.col("criterion.category").alias("category"),
            F.col("criterion.ord").alias("ord"),
            entry.alias("entry"),
        )
        .groupBy(key, "category")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "entry"))).alias("entries"))
        .select(
            key,
            F.col("entries")[0]["ord"].alias("first"),
            F.concat(
                F.lit("\n# "),
                F.col("category"),
                F.lit("\n\n"),
                F.array_join(F.transform("entries", lambda e: e["entry"]), "\n\n"),
                F.lit("\n"),
            ).alias("block"),
        )
    )
    return (
        blocks.groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("first", "block"))).alias("blocks"))
        .select(key, F.array_join(F.transform("blocks", lambda b: b["block"]), "").alias("evaluation"))
    )


def with_scores(
    papers: DataFrame, key: str, scores: DataFrame, criteria: Sequence[Criterion]
) -> DataFrame:
    """Papers with score columns and evaluation text; unscored ones keep nulls."""
    labels = [c.label for c in criteria]
    numeric = papers.withColumns(
        {
            c: F.col(c).cast("string").try_cast("double") if c in papers.columns else F.lit(None).cast("double")
            for c in labels
        }
    )
    table = score_columns(scores, key, labels).join(evaluation_text(scores, key), key)
    return fill_back(numeric, table, key, [*labels, "evaluation"])

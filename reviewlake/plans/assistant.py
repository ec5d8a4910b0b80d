"""Prompt, answer and scoring queries; the generator is a fixed rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.operators import answers as an
from reviewlake.plans.registry import query, table


@query(
    """
    SELECT event_id, CASE event_type WHEN 'click' THEN 'include' WHEN 'view' THEN 'exclude' END AS answer,
      CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN 'k=' || json_extract_string(props, '$.k')
           ELSE 'kept' END AS exclude_reason
    FROM events
    """
)
def json_answer(spark, folder):
    """Answers in plain, fenced, wrong and broken form."""
    kind = F.col("event_type")
    reason = F.concat(F.lit("k="), F.get_json_object("props", "$.k"))
    told = F.to_json(F.struct(F.lit("exclude").alias("answer"), reason.alias("justification")))
    raw = (
        F.when(kind == "click", '{"answer": "include"}')
        .when(kind == "view", F.concat(F.lit("```json\n"), told, F.lit("\n```")))
        .when(kind == "error", "no idea")
        .when(kind == "signup", '{"answer": "perhaps"}')
        .otherwise('{"verdict": "include"}')
    )
    verdict = F.col("verdict")
    return (
        table(spark, folder, "events")
        .select("event_id", an.parse_verdict(raw).alias("verdict"))
        .select(
            "event_id",
            verdict["answer"].alias("answer"),
            an.exclude_reason(verdict, F.lit("kept")).alias("exclude_reason"),
        )
    )


@query(
    """
    SELECT p_partkey, 'p_name: ' || p_name || chr(10) || 'p_brand: ' || p_brand || chr(10) || 'p_size: '
      || p_size AS prompt
    FROM part WHERE p_type <> 'PROMO'
    """
)
def prompt_rows(spark, folder):
    verdict = F.when(F.col("p_type") == "PROMO", "include")
    part = table(spark, folder, "part").withColumn("include", verdict)
    prompt = an.row_prompt(part.columns, ["include", "p_partkey", "p_type", "p_retailprice"])
    return an.pending(part, "p_partkey").select("p_partkey", prompt.alias("prompt"))


@query(
    """
    SELECT p_partkey, p_name FROM part WHERE p_type <> 'PROMO' ORDER BY p_partkey LIMIT 40
    """
)
def first_pending(spark, folder):
    verdict = F.when(F.col("p_type") == "PROMO", "include")
    part = table(spark, folder, "part").withColumn("include", verdict)
    return an.pending(part, "p_partkey", limit=40).select("p_partkey", "p_name")


def _verdict(system_prompt: str, user_prompt: str) -> str:
    if "thing" in user_prompt.lower():
        return '{"answer": "include"}'
    return '```json\n{"answer": "exclude", "justification": "off topic"}\n```'


@query(
    """
    SELECT doc_id, coalesce(old, CASE WHEN contains(lower(text), 'thing') THEN 'include' ELSE 'exclude' END)
             AS include,
           CASE WHEN old IS NOT NULL THEN 'before' WHEN contains(lower(text), 'thing') THEN ''
                ELSE 'off topic' END AS exclude_reason
    FROM (SELECT doc_id, text, CASE WHEN lang = 'es' THEN 'include' END AS old FROM documents)
    """
)
def study_selection(spark, folder):
    docs = table(spark, folder, "documents")
    done = F.col("lang") == "es"
    records = docs.select(
        "doc_id",
        "text",
        F.when(done, "include").alias("include"),
        F.when(done, "before").alias("exclude_reason"),
    )
    prompt = an.selection_prompt("things", [("IC1", "about things")], [("EC1", "off topic")])
    judged = an.select_studies(records, "doc_id", prompt, _verdict, ignored=["doc_id"])
    return judged.select("doc_id", "include", "exclude_reason")


def _criteria(spark, folder):
    """One criterion per region; regions in two categories."""
    region = table(spark, folder, "region")
    number = F.col("r_regionkey")
    return an.criteria_from(
        region.select(
            F.col("r_regionkey").alias("ord"),
            F.concat(F.lit("c"), number).alias("label"),
            F.when(number % 2 == 0, "even").otherwise("odd").alias("category"),
            F.concat(F.lit("How about "), "r_name", F.lit("?")).alias("question"),
            F.concat(F.lit("factor "), number + 1).alias("description"),
            F.lit("0 to 10").alias("scoring"),
        ),
        "ord",
    )


# The stub score of criterion i (from 1) on a text of n characters.
_SCORES = """
    s AS (SELECT doc_id, i, name, CAST(n * i % 11 AS DOUBLE) / 2 AS score FROM (
      SELECT doc_id, length(text) AS n, r_regionkey + 1 AS i, r_name AS name FROM documents, region))
"""


def _score(system_prompt: str, user_prompt: str) -> str:
    import re

    factor = int(re.search(r"factor (\d+)", system_prompt).group(1))
    score = len(user_prompt) * factor % 11 / 2
    return f'{{"score": {score}, "reason": "r{factor}"}}'


def _scored(spark, folder):
    papers = table(spark, folder, "documents").select("doc_id", "text")
    criteria = _criteria(spark, folder)
    return criteria, an.assess_quality(papers, "doc_id", "text", criteria, "regions", _score)


_PIVOT = ", ".join(f"max(CASE WHEN i = {i} THEN nullif(score, 0) END) AS c{i - 1}" for i in range(1, 6))


@query(f"WITH {_SCORES} SELECT doc_id, {_PIVOT} FROM s GROUP BY doc_id")
def score_pivot(spark, folder):
    criteria, scores = _scored(spark, folder)
    return an.score_columns(scores, "doc_id", [c.label for c in criteria])


@query(
    f"""
    WITH {_SCORES},
    e AS (SELECT doc_id, (i - 1) % 2 AS cat, i, i || '. **How about ' || name || '?**' || chr(10)
            || CASE WHEN score = 0 THEN 'left unscored: no usable score was returned' ELSE 'r' || i END AS entry
          FROM s),
    g AS (SELECT doc_id, cat, string_agg(entry, chr(10) || chr(10) ORDER BY i) AS entries FROM e
          GROUP BY doc_id, cat),
    b AS (SELECT doc_id, cat, chr(10) || '# ' || CASE cat WHEN 0 THEN 'even' ELSE 'odd' END || chr(10) || chr(10)
            || entries || chr(10) AS block FROM g)
    SELECT doc_id, string_agg(block, '' ORDER BY cat) AS evaluation FROM b GROUP BY doc_id
    """
)
def evaluation_text(spark, folder):
    _, scores = _scored(spark, folder)
    return an.evaluation_text(scores, "doc_id")


@query(
    f"""
    WITH {_SCORES}
    SELECT doc_id, max(CASE WHEN i = 1 THEN nullif(score, 0) END) AS c0, count(nullif(score, 0)) AS scored,
           lang
    FROM s JOIN documents USING (doc_id) GROUP BY doc_id, lang
    """
)
def quality_assessment(spark, folder):
    criteria, scores = _scored(spark, folder)
    papers = table(spark, folder, "documents").select("doc_id", "lang")
    full = an.with_scores(papers, "doc_id", scores, criteria)
    given = sum((F.col(c.label).isNotNull().cast("long") for c in criteria), F.lit(0).cast("long"))
    return full.select("doc_id", "c0", given.alias("scored"), "lang")

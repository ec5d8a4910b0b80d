"""Queries on many screening sheets (events) and criteria files (documents) at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.operators import workbooks as wb
from reviewlake.operators.screening import EVIDENCE_FIELDS
from reviewlake.plans.registry import query, table
from reviewlake.sources import criteria as cr

# Headers and settings vary from workbook to workbook by these rules.
HEADERS = [
    ["Name", "authors", " include ", "exclude_reason"],
    ["title", "authors", "include", None],
    ["title", "", "authors", "include", "include"],
    ["title", "include"],
    [" ", "title", "authors", "exclude_reasons"],
    ["title", "authors", "decision", "reason", " "],
    ["title", "authors", "include"],
    [None, " "],
]
MAPPINGS = [
    '{"title": "Name"}', None, "[1]", '{"title": 5}', '{"title": " ", "doi": "x"}', "no json",
    '{" title ": " Name "}', '{"authors": "title", "url": "include"}', " ",
]


def _sql(value) -> str:
    if isinstance(value, list):
        return "[" + ", ".join(map(_sql, value)) + "]"
    return "NULL::VARCHAR" if value is None else f"'{value}'"


def _choice(by: str, values: list) -> str:
    return f"CASE {by} " + " ".join(f"WHEN {i} THEN {_sql(v)}" for i, v in enumerate(values)) + " END"


_FIELDS = ", ".join(f"('{f}', '{c}', {str(must).lower()})" for f, (c, must) in EVIDENCE_FIELDS.items())
_SHEETS = f"""
    e AS (SELECT event_id // 40 AS w, event_id % 40 AS r, * FROM events),
    sheets AS (SELECT w AS workbook, r AS "row", CASE
        WHEN r < w % 3 OR w % 8 = 7 THEN [NULL, ' ']
        WHEN r = w % 3 THEN {_choice("w % 8", HEADERS)}
        WHEN value < 1 THEN [NULL, '', ' ']
        ELSE [props, user_id::VARCHAR, CASE WHEN event_type = 'click' THEN 'include'
          WHEN event_type = 'view' THEN ' Exclude ' WHEN event_type = 'error' THEN ''
          WHEN event_type = 'signup' AND value > 60 THEN 'maybe' END, event_type, 'past'] END AS cells FROM e),
    settings AS (SELECT DISTINCT w AS workbook, {_choice("w % 9", MAPPINGS)} AS mappings,
        CASE WHEN w % 5 = 4 THEN 'decision' ELSE 'include' END AS decision_column,
        CASE WHEN w % 6 = 5 THEN 'include' ELSE 'exclude_reason' END AS asked_reason FROM e),
    long AS (SELECT workbook, "row", i, coalesce(trim(cells[i]), '') AS cell, cells[i] AS raw
        FROM sheets, range(1, 6) t(i) WHERE i <= len(cells)),
    head AS (SELECT workbook, min("row") AS header_row FROM long WHERE cell <> '' GROUP BY ALL),
    width AS (SELECT workbook, header_row, max(i) AS n FROM long JOIN head USING (workbook)
        WHERE "row" = header_row AND cell <> '' GROUP BY ALL),
    names AS (SELECT workbook, header_row, i, cell AS name FROM long JOIN width USING (workbook)
        WHERE "row" = header_row AND i <= n),
    whole AS (SELECT *, trim(coalesce(mappings, '')) = '' AS blank,
        coalesce(json_valid(mappings) AND json_type(CASE WHEN json_valid(mappings) THEN mappings END) = 'OBJECT', false)
          AS object FROM settings),
    entries AS (SELECT workbook, k, json_extract(mappings, '$."' || k || '"') AS v FROM (
        SELECT workbook, mappings, unnest(json_keys(mappings)) AS k FROM whole WHERE object)),
    wrong AS (SELECT * FROM entries WHERE trim(k) = '' OR json_type(v) <> 'VARCHAR' OR trim(v ->> '$') = ''),
    fields AS (SELECT settings.workbook, field, must, coalesce(trim(v ->> '$'), col) AS col
        FROM settings, (VALUES {_FIELDS}) f(field, col, must)
        LEFT JOIN entries ON entries.workbook = settings.workbook AND trim(k) = field),
    chosen AS (SELECT s.*, CASE WHEN asked_reason = 'exclude_reason'
          AND NOT EXISTS (FROM names n WHERE n.workbook = s.workbook AND name = 'exclude_reason')
          AND EXISTS (FROM names n WHERE n.workbook = s.workbook AND name = 'exclude_reasons')
          THEN 'exclude_reasons' ELSE asked_reason END AS reason_column,
        (blank OR object) AND workbook NOT IN (SELECT workbook FROM wrong) AS sound FROM whole s),
    below AS (SELECT workbook, "row", header_row, bool_or(i <= n AND cell <> '') AS filled
        FROM long JOIN width USING (workbook) WHERE "row" > header_row GROUP BY ALL),
    ends AS (SELECT workbook, max("row") AS last_row FROM below WHERE filled GROUP BY ALL),
    spot AS (SELECT workbook, name, min(i) AS i FROM names GROUP BY ALL)
"""


def _sheets(spark, folder):
    w, r, kind = F.expr("event_id div 40"), F.expr("event_id % 40"), F.col("event_type")
    decision = (
        F.when(kind == "click", "include").when(kind == "view", " Exclude ").when(kind == "error", "")
        .when((kind == "signup") & (F.col("value") > 60), "maybe")
    )
    texts = lambda values: F.array(*[F.lit(v).cast("string") for v in values])
    header = F.get(F.array(*[texts(h) for h in HEADERS]), (w % 8).cast("int"))
    cells = (
        F.when((r < w % 3) | (w % 8 == 7), texts([None, " "]))
        .when(r == w % 3, header)
        .when(F.col("value") < 1, texts([None, "", " "]))
        .otherwise(F.array("props", F.col("user_id").cast("string"), decision, kind, F.lit("past")))
    )
    events = table(spark, folder, "events")
    sheets = events.select(w.alias("workbook"), r.alias("row"), cells.alias("cells"))
    w = F.col("workbook")
    settings = sheets.select("workbook").distinct().select(
        "workbook",
        F.get(texts(MAPPINGS), (w % 9).cast("int")).alias("mappings"),
        F.when(w % 5 == 4, "decision").otherwise("include").alias("decision_column"),
        F.when(w % 6 == 5, "include").otherwise("exclude_reason").alias("reason_column"),
    )
    return sheets, settings


@query(
    f"""
    WITH {_SHEETS}, found AS (
      SELECT workbook, 'missing_header' AS code, NULL::VARCHAR AS "column", NULL::VARCHAR AS value
      FROM settings WHERE workbook NOT IN (SELECT workbook FROM head)
      UNION ALL SELECT workbook, 'invalid_header', i::VARCHAR, NULL FROM names WHERE name = ''
      UNION ALL SELECT workbook, 'duplicate_header', a.i::VARCHAR, name FROM names a WHERE name <> ''
        AND EXISTS (FROM names b WHERE b.workbook = a.workbook AND b.name = a.name AND b.i < a.i)
      UNION ALL SELECT workbook, 'invalid_field_mappings', NULL, mappings FROM whole WHERE NOT blank AND NOT object
      UNION ALL SELECT workbook, 'invalid_field_mappings', k, v::VARCHAR FROM wrong
      UNION ALL SELECT f.workbook, 'missing_mandatory_fields', col, NULL FROM fields f JOIN chosen c USING (workbook)
        WHERE must AND sound AND f.workbook IN (SELECT workbook FROM head)
        AND NOT EXISTS (FROM names n WHERE n.workbook = f.workbook AND n.name = col)
      UNION ALL SELECT workbook, 'duplicate_screening_columns', decision_column, NULL FROM chosen
        WHERE sound AND decision_column = reason_column AND workbook IN (SELECT workbook FROM head)
      UNION ALL SELECT DISTINCT workbook, 'screening_evidence_column_collision', col, NULL
        FROM chosen JOIN fields USING (workbook)
        WHERE sound AND col IN (decision_column, reason_column) AND workbook IN (SELECT workbook FROM head))
    SELECT found.workbook, code, header_row AS "row", "column", value FROM found LEFT JOIN head USING (workbook)
    UNION ALL SELECT workbook, 'missing_records', NULL, NULL, NULL FROM head
      WHERE workbook NOT IN (SELECT workbook FROM ends)
    UNION ALL SELECT workbook, 'blank_record_row', "row", NULL, NULL FROM below JOIN ends USING (workbook)
      WHERE NOT filled AND "row" < last_row
    UNION ALL SELECT l.workbook, 'invalid_decision', l."row", decision_column, raw
      FROM long l JOIN below b ON l.workbook = b.workbook AND l."row" = b."row" AND b.filled
      JOIN chosen c ON c.workbook = l.workbook JOIN spot s ON s.workbook = l.workbook AND name = decision_column
      WHERE l.i = s.i AND lower(cell) NOT IN ('', 'include', 'exclude')
    """
)
def workbook_violations(spark, folder):
    return wb.workbook_violations(*_sheets(spark, folder))


def _field(name: str) -> str:
    return f"max(CASE WHEN field = '{name}' THEN trim(raw) END) AS \"{name}\""


@query(
    f"""
    WITH {_SHEETS}, places AS (
      SELECT workbook, field, col FROM fields
      UNION ALL SELECT workbook, 'decision', decision_column FROM chosen
      UNION ALL SELECT workbook, 'reasons', reason_column FROM chosen)
    SELECT b.workbook, b."row" - header_row - 1 AS record_index, b."row",
      {", ".join(map(_field, EVIDENCE_FIELDS))}, {_field("reasons")},
      coalesce(max(CASE WHEN field = 'decision' THEN lower(cell) END), '') AS decision
    FROM below b JOIN places p ON p.workbook = b.workbook
      LEFT JOIN spot s ON s.workbook = b.workbook AND s.name = p.col
      LEFT JOIN long l ON l.workbook = b.workbook AND l."row" = b."row" AND l.i = s.i
    WHERE filled GROUP BY ALL
    """
)
def workbook_records(spark, folder):
    return wb.workbook_records(*_sheets(spark, folder))


@query(
    """
    WITH d AS (SELECT doc_id, doc_id // 10 AS g,
        CASE WHEN doc_id % 10 < 6 THEN 'inclusion_criteria' ELSE 'exclusion_criteria' END AS place,
        CASE doc_id % 23 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN 'null' END AS odd,
        coalesce(lang, 'none') || (doc_id % 4)::VARCHAR AS label FROM documents),
      kept AS (SELECT *, place || '[' || (row_number() OVER (PARTITION BY g, place ORDER BY doc_id) - 1)::VARCHAR || ']' AS spot
        FROM d WHERE g % 11 <> 5 AND NOT (place = 'exclusion_criteria' AND g % 5 = 2)),
      files AS (SELECT DISTINCT g FROM d), found AS (
        SELECT g, 'invalid_json' AS code, '' AS place, NULL::VARCHAR AS value FROM files WHERE g % 11 = 5
        UNION ALL SELECT g, 'missing_text', 'review_topic', NULL FROM files WHERE g % 11 <> 5 AND g % 7 = 3
        UNION ALL SELECT g, 'no_criteria', p, NULL
          FROM files, (VALUES ('inclusion_criteria'), ('exclusion_criteria')) t(p)
          WHERE g % 11 <> 5 AND NOT EXISTS (FROM kept k WHERE k.g = files.g AND k.place = p)
        UNION ALL SELECT g, CASE odd WHEN 'null' THEN 'missing_text' ELSE 'not_a_text' END, spot || '.label',
          nullif(odd, 'null') FROM kept WHERE odd IS NOT NULL
        UNION ALL SELECT g, 'not_a_text', spot || '.description', '[1]' FROM kept WHERE doc_id % 29 = 0
        UNION ALL SELECT g, 'duplicate_label', place, label FROM kept WHERE odd IS NULL
          GROUP BY g, place, label HAVING count(*) > 1)
    SELECT g::VARCHAR AS path, code, place, value FROM found
    """
)
def criteria_violations(spark, folder):
    """A criteria file for every ten documents, some of them broken by rule."""
    number, file = F.col("doc_id"), F.expr("doc_id div 10")
    label = (
        F.when(number % 23 == 0, number.cast("string")).when(number % 23 == 1, "null")
        .otherwise(F.concat(F.lit('"'), F.coalesce("lang", F.lit("none")), (number % 4).cast("string"), F.lit('"')))
    )
    told = F.when(number % 29 == 0, "[1]").otherwise(F.concat(F.lit('"'), F.coalesce("n_chars", F.lit(0)).cast("string"), F.lit('"')))
    item = F.struct("doc_id", F.concat(F.lit('{"label": '), label, F.lit(', "description": '), told, F.lit("}")).alias("json"))
    first = number % 10 < 6

    def listed(inside):
        # Ten documents at most meet here.
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(inside, item))), lambda x: x["json"]), ", ")

    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars", file.alias("file"))
    files = docs.groupBy("file").agg(listed(first).alias("yes"), listed(~first & (F.col("file") % 5 != 2)).alias("no"))
    topic = F.when(F.col("file") % 7 == 3, "null").otherwise('"t"')
    whole = F.concat(
        F.lit('{"review_topic": '), topic, F.lit(', "inclusion_criteria": ['), "yes",
        F.lit('], "exclusion_criteria": ['), "no", F.lit("]}"),
    )
    text = F.when(F.col("file") % 11 == 5, '{"review_topic": ').otherwise(whole)
    return cr.criteria_violations(files.select(F.col("file").cast("string").alias("path"), text.alias("text")))

"""Screening sheets of many workbooks at once: headers, checks, records.

A sheet is a table ``(workbook, row, cells)`` with the cells of a row as an array
of strings; ``settings`` has one row ``(workbook, mappings, decision_column,
reason_column)`` per workbook, ``mappings`` being the JSON text that maps evidence
fields to columns. What :mod:`reviewlake.operators.screening` checks for one table
is a table of violations here. A workbook may hold any share of all rows: its few
facts are aggregated with map-side combining and brought to its rows by
:func:`reviewlake.scale.lookup`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import DECISION_STATES, decision_word, strip
from reviewlake.operators.screening import EVIDENCE_FIELDS, REASON_COLUMNS
from reviewlake.scale import lookup

VIOLATION = "workbook, code, row, column, value".split(", ")


def _filled(cells: Column) -> Column:
    return F.coalesce(F.exists(cells, _named), F.lit(False))


def _named(cell: Column) -> Column:
    return F.coalesce(strip(cell) != "", F.lit(False))


def sheet_headers(sheets: DataFrame) -> DataFrame:
    """``(workbook, rows, header_row, headers)``: the first row that is not blank.

    Headers are trimmed, blank ones empty texts; those after the last name are cut
    off. A workbook of blank rows has nulls.
    """
    row = F.when(_filled(F.col("cells")), F.col("row"))
    heads = sheets.groupBy("workbook").agg(
        F.count("*").alias("rows"), F.min(row).alias("header_row"), F.min_by("cells", row).alias("cells")
    )
    names = F.transform("cells", lambda c: F.coalesce(strip(c), F.lit("")))
    last = F.array_max(F.transform(names, lambda n, i: F.when(n != "", i + 1)))
    return heads.select("workbook", "rows", "header_row", F.slice(names, 1, last).alias("headers"))


def _entries(text: Column) -> Column:
    """Key, text and type of each entry of a JSON object; null if it is none."""
    found = F.from_json(F.when(strip(text) == "", None).otherwise(text), "map<string, variant>")
    read = F.transform(
        F.map_entries(found),
        lambda e: F.struct(
            e["key"].alias("key"), F.to_json(e["value"]).alias("json"), F.schema_of_variant(e["value"]).alias("type"),
            F.try_variant_get(e["value"], "$", "string").alias("text"),
        ),
    )
    return F.when(F.coalesce(strip(text), F.lit("")) == "", F.filter(read, lambda e: F.lit(False))).otherwise(read)


def _settled(sheets: DataFrame, settings: DataFrame) -> DataFrame:
    """One row per workbook: headers, mapping entries and the columns that hold its fields."""
    facts = sheet_headers(sheets).join(settings, "workbook", "left")
    blank = F.coalesce(strip(F.col("mappings")), F.lit("")) == ""
    facts = facts.withColumn("entries", _entries(F.col("mappings")))
    facts = facts.withColumn("entries", F.when(blank, F.array().cast(facts.schema["entries"].dataType)).otherwise(F.col("entries")))

    def held(field: str, column: str) -> Column:
        own = F.filter("entries", lambda e: strip(e["key"]) == field)
        return F.coalesce(strip(F.get(own, F.size(own) - 1)["text"]), F.lit(column)).alias(field)

    reason = F.col("reason_column")
    known = F.array(*[F.lit(c) for c in REASON_COLUMNS])
    other = F.get(F.filter(known, lambda c: F.array_contains("headers", c)), F.lit(0))
    spelt = F.when(F.array_contains("headers", reason) | ~reason.isin(*REASON_COLUMNS), reason).otherwise(
        F.coalesce(other, reason)
    )
    return facts.withColumn("reason_column", spelt).withColumn(
        "fields", F.struct(*[held(f, c) for f, (c, _) in EVIDENCE_FIELDS.items()])
    )


def _good_entry(e: Column) -> Column:
    return _named(e["key"]) & F.coalesce((e["type"] == "STRING") & _named(e["text"]), F.lit(False))


def _column_violations(facts: DataFrame) -> DataFrame:
    """What a workbook's header and settings break, each with the header's row."""
    headers, nothing = F.col("headers"), F.lit(None).cast("string")

    def one(code: str, column: Column, value: Column = nothing) -> Column:
        return F.struct(
            F.lit(code).alias("code"), column.cast("string").alias("column"), value.cast("string").alias("value")
        )

    def when(condition: Column, *found: Column) -> Column:
        return F.when(condition, F.array(*found)).otherwise(F.filter(F.array(*found), lambda _: F.lit(False)))

    spots = F.transform(headers, lambda h, i: F.struct(h.alias("name"), (i + 1).alias("at")))
    unnamed = F.filter(spots, lambda s: s["name"] == "")
    again = F.filter(spots, lambda s: (s["name"] != "") & (F.array_position(headers, s["name"]) < s["at"]))
    object_ = F.col("entries").isNotNull()
    wrong = F.filter("entries", lambda e: ~_good_entry(e))
    sound = object_ & (F.size(wrong) == 0)
    fields = [F.col("fields")[f] for f in EVIDENCE_FIELDS]
    needed = [F.col("fields")[f] for f, (_, must) in EVIDENCE_FIELDS.items() if must]
    absent = F.filter(F.array(*needed), lambda c: ~F.array_contains(headers, c))
    decision, reason = F.col("decision_column"), F.col("reason_column")
    inside = F.filter(F.array_distinct(F.array(decision, reason)), lambda c: F.array_contains(F.array(*fields), c))
    none = F.filter(F.array(one("", nothing)), lambda _: F.lit(False))
    found = F.concat(
        when(F.col("header_row").isNull(), one("missing_header", nothing)),
        F.coalesce(F.transform(unnamed, lambda s: one("invalid_header", s["at"])), none),
        F.coalesce(F.transform(again, lambda s: one("duplicate_header", s["at"], s["name"])), none),
        when(~object_, one("invalid_field_mappings", nothing, F.col("mappings"))),
        F.coalesce(F.transform(wrong, lambda e: one("invalid_field_mappings", e["key"], e["json"])), none),
        F.when(sound & F.col("header_row").isNotNull(), F.concat(
            F.transform(absent, lambda c: one("missing_mandatory_fields", c)),
            when(decision == reason, one("duplicate_screening_columns", decision)),
            F.transform(inside, lambda c: one("screening_evidence_column_collision", c)),
        )).otherwise(none),
    )
    row = F.col("header_row").cast("long").alias("row")
    return facts.select("workbook", row, F.explode(found).alias("v")).select("workbook", "row", "v.*")


def _below(sheets: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows below their workbook's header, cut to its width, and whether they are filled."""
    known = facts.where(F.col("header_row").isNotNull()).select(
        "workbook", "rows", "header_row", "headers", "fields", "decision_column", "reason_column"
    )
    rows = lookup(sheets.select("workbook", "row", "cells"), known, ["workbook"], "rows", "row", "inner")
    cells = F.slice("cells", 1, F.size("headers"))
    return rows.where(F.col("row") > F.col("header_row")).withColumn("cells", cells).withColumn("filled", _filled(cells))


def _cell(column: Column) -> Column:
    """The cell under a header, the first of its name; null where there is none."""
    at = F.array_position("headers", column)
    return F.when(at > 0, F.get(F.col("cells"), at.cast("int") - 1))


def workbook_violations(sheets: DataFrame, settings: DataFrame) -> DataFrame:
    """All broken rules of all workbooks: ``(workbook, code, row, column, value)``.

    Nothing stops at the first one. Columns are checked where the header is there
    and the mappings are sound; records (none at all, blank rows before the last
    filled one, unknown decisions) wherever there is a header.
    """
    facts = _settled(sheets, settings)
    below = _below(sheets, facts)
    counts = below.groupBy("workbook").agg(
        F.count_if(~F.col("filled")).alias("blanks"), F.max(F.when(F.col("filled"), F.col("row"))).alias("last_row")
    )
    blank = below.where(~F.col("filled")).select("workbook", "row")
    blank = lookup(blank, counts, ["workbook"], "blanks", "row", "inner").where(F.col("row") < F.col("last_row"))
    headed = facts.where(F.col("header_row").isNotNull()).select("workbook")
    empty = headed.join(counts.where(F.col("last_row").isNotNull()), "workbook", "left_anti")
    nothing = F.lit(None).cast("string")
    cell = _cell(F.col("decision_column"))
    decided = below.where(F.col("filled") & ~F.coalesce(decision_word(cell), F.lit("")).isin(*DECISION_STATES))
    parts = [
        _column_violations(facts),
        empty.select("workbook", F.lit("missing_records").alias("code"), F.lit(None).cast("long").alias("row"),
                     nothing.alias("column"), nothing.alias("value")),
        blank.select("workbook", F.lit("blank_record_row").alias("code"), F.col("row").cast("long"),
                     nothing.alias("column"), nothing.alias("value")),
        decided.select("workbook", F.lit("invalid_decision").alias("code"), F.col("row").cast("long"),
                       F.col("decision_column").alias("column"), cell.alias("value")),
    ]
    out = parts[0].select(*VIOLATION)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def workbook_records(sheets: DataFrame, settings: DataFrame) -> DataFrame:
    """The filled rows of all workbooks by evidence field, each from its own column.

    ``(workbook, record_index, row, <fields>, decision, reasons)``; the index counts
    from the row below the header. Columns that a sheet lacks, screening columns
    included, give nulls.
    """
    below = _below(sheets, _settled(sheets, settings)).where(F.col("filled"))
    return below.select(
        "workbook",
        (F.col("row") - F.col("header_row") - 1).cast("long").alias("record_index"),
        F.col("row").cast("long"),
        *[strip(_cell(F.col("fields")[f])).alias(f) for f in EVIDENCE_FIELDS],
        decision_word(_cell(F.col("decision_column"))).alias("decision"),
        strip(_cell(F.col("reason_column"))).alias("reasons"),
    )

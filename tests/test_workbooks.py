"""Many screening sheets at once: every rule, and the fields of the records."""

from reviewlake.operators import workbooks as wb

SHEETS = [
    ("a", 0, [None, " "]),
    ("a", 1, ["Name", "authors", " include ", "include", None]),
    ("a", 2, ["T", "A", "maybe", ""]),
    ("a", 3, [None] * 4),
    ("a", 4, ["T2", "A2", " Exclude ", "x"]),
    ("a", 5, ["", "", "", "", "past the last name"]),
    ("b", 0, ["title", "", "authors"]),
    ("c", 0, [" "]),
    ("c", 1, None),
    ("d", 3, ["title", "authors"]),
    ("d", 4, ["x", "y"]),
]
SETTINGS = [
    ("a", '{" title ":"Name"}', "include", "exclude_reason"),
    ("b", '{"title": 5, "x":" "}', "include", "include"),
    ("c", "[1]", "include", "exclude_reason"),
    ("d", '{"doi":"include"}', "include", "include"),
]
SHEET, SETTING = (
    "workbook string, row int, cells array<string>",
    "workbook string, mappings string, decision_column string, reason_column string",
)


def test_all_broken_rules_of_all_workbooks(spark):
    sheets, settings = spark.createDataFrame(SHEETS, SHEET), spark.createDataFrame(SETTINGS, SETTING)
    got = {tuple(r) for r in wb.workbook_violations(sheets, settings).collect()}
    assert got == {
        ("a", "blank_record_row", 3, None, None),
        ("a", "duplicate_header", 1, "4", "include"),
        ("a", "invalid_decision", 2, "include", "maybe"),
        ("b", "invalid_field_mappings", 0, "title", "5"),
        ("b", "invalid_field_mappings", 0, "x", '" "'),
        ("b", "invalid_header", 0, "2", None),
        ("b", "missing_records", None, None, None),
        ("c", "invalid_field_mappings", None, None, "[1]"),
        ("c", "missing_header", None, None, None),
        ("d", "duplicate_screening_columns", 3, "include", None),
        ("d", "screening_evidence_column_collision", 3, "include", None),
    }
    rows = wb.workbook_records(sheets, settings).select("workbook", "record_index", "title", "authors", "decision", "reasons")
    assert sorted(map(tuple, rows.collect())) == [
        ("a", 0, "T", "A", "maybe", None), ("a", 2, "T2", "A2", "exclude", None), ("d", 0, "x", "y", "", None),
    ]


def test_one_workbook_with_nearly_all_rows_and_none_at_all(spark):
    rows = [("hot", i, ["title", "authors", "include"] if i == 0 else [f"t{i}", "a", "include"]) for i in range(5_000)]
    sheets = spark.createDataFrame([*rows, *SHEETS], SHEET)
    settings = spark.createDataFrame([*SETTINGS, ("hot", None, "include", "exclude_reason")], SETTING)
    assert wb.workbook_violations(sheets, settings).where("workbook = 'hot'").count() == 0
    assert wb.workbook_records(sheets, settings).where("workbook = 'hot'").count() == 4_999
    assert wb.workbook_violations(sheets.where("false"), settings).count() == 0
    assert wb.workbook_records(sheets.where("false"), settings).count() == 0

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlake.operators import assign as asg
from reviewlake.operators import screening as sc
from reviewlake.streaming import patches as pt


def test_assignment(spark):
    studies = spark.createDataFrame([(i * 1000 - 3, f"t{i}") for i in range(5)], "study_id long, title string")
    df = asg.assign_reviewers(studies, "study_id", 3, 2, ["q1", "q2"])
    rows = df.collect()
    assert len(rows) == 10 and all(r["q1"] == 0.0 and r["q2"] == 0.0 for r in rows)
    loads = {r["evaluator"]: r["load"] for r in asg.reviewer_loads(df, 3).collect()}
    assert loads == {0: 4, 1: 3, 2: 3}
    none = asg.assign_reviewers(studies.limit(0), "study_id", 2, 1)
    assert [r["load"] for r in asg.reviewer_loads(none, 2).collect()] == [0, 0]
    with pytest.raises(ValueError):
        asg.assign_reviewers(studies, "study_id", 2, 3)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 30), st.integers(1, 7), st.data())
def test_loads_are_even_and_reviewers_distinct(spark, papers, n, data):
    k = data.draw(st.integers(1, n))
    df = asg.assign_reviewers(spark.range(papers), "id", n, k)
    loads = [r["load"] for r in asg.reviewer_loads(df, n).collect()]
    assert sum(loads) == papers * k and max(loads) - min(loads) <= 1
    assert df.select("id", "evaluator").distinct().count() == papers * k


@pytest.mark.parametrize("rows, count", [(3, 2), (10, 4), (2, 5), (12, 3)])
def test_split(spark, rows, count):
    df = asg.split_bundles(spark.range(rows).withColumnRenamed("id", "cluster_id"), count)
    got = df.collect()
    sizes = [sum(r["split_no"] == i for r in got) for i in range(1, count + 1)]
    assert len({r["cluster_id"] for r in got}) == rows
    assert sizes == [rows // count + (i < rows % count) for i in range(count)]
    with pytest.raises(ValueError):
        asg.split_bundles(spark.range(3), 2)


def test_headers_and_columns():
    assert sc.check_headers([" a ", "b"]) == ["a", "b"]
    for bad, code in ((["a", " "], "invalid_header"), (["a", 3], "invalid_header"), (["a", "a "], "duplicate_header")):
        with pytest.raises(sc.ScreeningError) as error:
            sc.check_headers(bad)
        assert error.value.code == code
    sc.check_columns(["title", "authors"], {}, "include", "why")
    cases = [
        ((["title"], {}, "include", "why"), "missing_mandatory_fields"),
        ((["title", "authors"], {}, "x", "x"), "duplicate_screening_columns"),
        ((["title", "authors"], {}, "abstract", "why"), "screening_evidence_column_collision"),
    ]
    for args, code in cases:
        with pytest.raises(sc.ScreeningError) as error:
            sc.check_columns(*args)
        assert error.value.code == code
    assert sc.reason_column_of(["exclude_reasons"], "exclude_reason") == "exclude_reasons"
    assert sc.parse_field_mappings('{" title ": "Name"}') == {"title": "Name"}
    assert sc.parse_field_mappings(" ") == {}
    for bad in ("[1]", '{"a": 1}', '{"a": " "}', "{"):
        with pytest.raises(sc.ScreeningError):
            sc.parse_field_mappings(bad)


def test_header_row_and_violations(spark):
    raw = spark.createDataFrame(
        [(0, None, " ", None), (1, "title", "include", " "), (2, "a", "Include", None), (3, " ", None, "x"), (4, "b", "maybe", None), (5, None, "", None)],
        "row long, _c0 string, _c1 string, _c2 string",
    )
    table = sc.table_below_header(raw, "row")
    assert table.columns == ["row", "title", "include"]
    got = {(r["code"], r["row"], r["value"]) for r in sc.record_violations(table, "row").collect()}
    assert got == {("blank_record_row", 3, None), ("invalid_decision", 4, "maybe")}
    empty = sc.record_violations(table.where("row = 3"), "row").collect()
    assert [r["code"] for r in empty] == ["missing_records"]


def test_records(spark):
    df = spark.createDataFrame(
        [(0, "A title", "An abstract", "10.1/e", "Ada;Grace", "testing;software", "2024", "Journal", "https://e.test", "false", "exclude", "too old; Off"),
         (1, "B", None, None, "Ada", None, "nan", "nan", None, "nan", None, None)],
        "i long, title string, abstract string, doi string, authors string, keywords string, year string, source string, url string, has_pdf string, include string, exclude_reason string",
    )
    a, b = sc.screening_records(df, "i", mappings={"publicationDate": "year", "publicationVenue": "source"}).orderBy("record_index").collect()
    assert (a["decision"], a["include"], a["exclude_reasons"]) == ("excluded", False, ["too old", "Off"])
    assert a["authors"] == ["Ada", "Grace"] and a["publication_date"] == datetime.datetime(2024, 1, 1)
    assert (b["decision"], b["include"], b["doi"], b["keywords"]) == ("undecided", True, "", [])
    assert b["publication_date"] is None and b["publication_venue"] is None and b["has_pdf"] is False
    shown = sc.evidence_response(sc.screening_records(df, "i", mappings={"publicationVenue": "source"})).orderBy("record_index").collect()
    assert shown[1]["publication_venue"] == "<not specified>" and shown[1]["doi_link"] is None
    assert shown[0]["doi_link"] == "https://dx.doi.org/10.1/e" and shown[0]["selection_status"] == "exclude"


T = datetime.datetime
PATCHES = [
    (0, "included", [], T(2024, 1, 1), 1),
    (0, "excluded", [" Bad ", "bad", "", "Old"], T(2024, 1, 2), 2),
    (0, "undecided", ["x"], T(2024, 1, 2), 1),
    (1, "excluded", [], T(2024, 1, 5), 3),
    (1, "included", ["ignored"], T(2024, 1, 1), 4),
    (9, "included", [], T(2024, 1, 1), 5),
    (2, "later", [], T(2024, 1, 1), 6),
]


def base(spark):
    return spark.createDataFrame([(0, None, None), (1, "exclude", "old"), (2, "", "")], "record_index long, include string, exclude_reasons string")


AFTER = {0: ("exclude", "bad;old"), 1: ("include", ""), 2: ("", "")}


def test_patches(spark):
    patches = spark.createDataFrame(PATCHES, pt.PATCH_SCHEMA)
    got = {r["record_index"]: (r["include"], r["exclude_reasons"]) for r in sc.apply_patches(base(spark), patches).collect()}
    assert got == AFTER
    refused = {(r["seq"], r["code"]) for r in sc.rejected_patches(patches, base(spark)).collect()}
    assert refused == {(3, "missing_reason"), (5, "unknown_record"), (6, "invalid_decision")}


def test_patch_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, part in enumerate((PATCHES[:3], PATCHES[3:])):
        spark.createDataFrame(part, pt.PATCH_SCHEMA).coalesce(1).write.parquet(f"{source}/b{n}")
        stream = spark.readStream.schema(pt.PATCH_SCHEMA).parquet(f"{source}/*")
        query = pt.stream_patches(stream, out, str(tmp_path / "state"))
        assert query.awaitTermination(120) and query.exception() is None
    stored = spark.read.parquet(f"{out}/accepted")
    rows = pt.apply_stored(base(spark), stored).collect()
    assert {r["record_index"]: (r["include"], r["exclude_reasons"]) for r in rows} == AFTER
    assert {r["seq"] for r in spark.read.parquet(f"{out}/refused").collect()} == {3, 6}
    before, again = stored.count(), spark.createDataFrame(PATCHES[3:], pt.PATCH_SCHEMA)
    pt.write_batch(again, 1, out)
    assert spark.read.parquet(f"{out}/accepted").count() == before


def test_progress_and_navigation(spark):
    rows = [("w", 0, "include"), ("w", 1, None), ("w", 2, " "), ("w", 3, "exclude"), ("v", 0, "include")]
    df = spark.createDataFrame(rows, "book string, i long, include string")
    got = {r["book"]: (r["record_count"], r["unfilled_record_count"], r["complete"]) for r in sc.progress(df, "include", "book").collect()}
    assert got == {"w": (4, 2, False), "v": (1, 0, True)}
    nav = {(r["book"], r["i"]): r for r in sc.navigation(df, "i", "include", ["book"]).collect()}
    first, last = nav[("w", 0)], nav[("w", 3)]
    assert (first["previous_index"], first["next_index"], first["first_undecided_index"], first["next_undecided_index"]) == (None, 1, 1, 1)
    assert nav[("w", 1)]["next_undecided_index"] == 2
    assert (last["previous_index"], last["next_index"], last["next_undecided_index"], last["complete"]) == (2, None, None, False)
    assert nav[("v", 0)]["complete"] is True and nav[("v", 0)]["next_index"] is None


def patch_rows(numbers):
    at = datetime.datetime(2024, 1, 1)
    for n in numbers:
        decision = ("included", "excluded", "undecided", "maybe")[n % 4]
        reasons = ["x"] if n % 8 == 1 else []
        yield (None if n % 11 == 0 else n % 6, decision, reasons, at + datetime.timedelta(minutes=n * 7 % 30), n)


def test_stream_refuses_unknown_records_and_merges_epochs(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    for part in range(4):
        spark.createDataFrame(list(patch_rows(range(part * 40, part * 40 + 40))), pt.PATCH_SCHEMA).coalesce(1).write.parquet(f"{source}/{part}")
    known = spark.createDataFrame([(i, "x") for i in range(4)], "record_index long, code string")
    stream = spark.readStream.schema(pt.PATCH_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    pt.stream_patches(stream, out, str(tmp_path / "state"), known=known).awaitTermination()
    everything = spark.read.schema(pt.PATCH_SCHEMA).parquet(f"{source}/*")
    key = lambda df: sorted((r["seq"], r["code"]) for r in df.collect())
    refused = spark.read.parquet(f"{out}/refused")
    want = sc.rejected_patches(everything, known.select("record_index"))
    assert key(refused) == key(want) and {c for _, c in key(want)} == {"invalid_decision", "missing_reason", "unknown_record"}
    good = everything.join(want.select("seq"), "seq", "left_anti")
    rows = lambda df: sorted(map(tuple, df.select("record_index", "new_decision", "new_reasons", "ts", "seq").collect()))
    latest = rows(sc.latest_patches(good))
    assert rows(pt.stored_patches(pt.accepted(spark, out))) == latest and len(latest) == 4
    epochs = sorted(r["epoch"] for r in spark.read.parquet(f"{out}/accepted").select("epoch").distinct().collect())
    assert len(epochs) == 4
    pt.compact(spark, out, epochs[1])
    assert rows(pt.stored_patches(pt.accepted(spark, out, epochs[1]))) == latest
    pt.compact(spark, out, epochs[3], epochs[1])
    assert rows(pt.accepted(spark, out, epochs[3])) == latest
    assert pt.checked_batch(everything.where("false"), known).count() == 0

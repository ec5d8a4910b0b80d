import datetime

import pytest
from pyspark.sql import functions as F

from reviewlake.functions import text as tx


def run(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in df.select("i", fn("v").alias("r")).orderBy("i").collect()]


def test_clean_value(spark):
    values = ["  Hello  ", "'Hello'", '"Hello"', "\nHello\t", "", None, " 'a b' "]
    assert run(spark, tx.clean_value, values) == ["hello"] * 4 + [None, None, "a b"]
    assert run(spark, tx.clean_value, [123], "int") == ["123"]


def test_normalize_doi(spark):
    values = [" HTTPS://DOI.ORG/10/A ", "doi:10/B", "http://dx.doi.org/10/c", "10/D", "https://doi.org/", None]
    assert run(spark, tx.normalize_doi, values) == ["10/a", "10/b", "10/c", "10/d", None, None]


def test_parse_list(spark):
    assert run(spark, tx.parse_list, ["a; b ;;c", " ; ", None]) == [["a", "b", "c"], [], []]


def test_parse_date(spark):
    d = datetime.datetime
    values = ["2025", "2025-06", "2025-06-15", "2025-06-15T01:02:03", "nan", "", " ", None, "ajdbc", "-2025"]
    want = [d(2025, 1, 1), d(2025, 6, 1), d(2025, 6, 15), d(2025, 6, 15, 1, 2, 3)] + [None] * 6
    assert run(spark, tx.parse_date, values) == want
    with pytest.raises(Exception, match="invalid publication date"):
        run(spark, lambda c: tx.parse_date(c, strict=True), ["ajdbc"])


def test_to_bool(spark):
    for word in tx.TRUE_WORDS:
        assert run(spark, tx.to_bool, [f" {word.upper()} "]) == [True]
    assert run(spark, tx.to_bool, [*tx.FALSE_WORDS, None, "maybe"]) == [False] * 11 + [None]
    with pytest.raises(Exception, match="can't convert"):
        run(spark, lambda c: tx.to_bool(c, strict=True), ["maybe"])


def test_links_and_paths(spark):
    urls = ["https://x.org/a%20b.pdf", "file:///tmp/a+b.txt", "file://other/x", "FILE:/tmp/y"]
    names = run(spark, tx.local_file_name, urls)
    assert names[0].startswith("a b-") and names[0].endswith(".pdf") and len(names[0]) == 40
    assert run(spark, tx.url_scheme, urls) == ["https", "file", "file", "file"]
    assert run(spark, tx.local_path, urls) == [None, "/tmp/a+b.txt", None, "/tmp/y"]


def test_reasons_and_keys(spark):
    reasons = run(spark, tx.split_reasons, [["a, b", "c"], []], "array<string>")
    assert reasons == [["a", "b", "c"], []]
    assert run(spark, tx.ordered_distinct, [[" B", "a", "b ", ""]], "array<string>") == [["b", "a"]]
    df = spark.createDataFrame([(" A ", None)], "x string, y string")
    key = tx.comparison_key(["x", "y", "z"], df.columns)
    assert df.select(key.alias("k")).first()["k"] == "a__"


def test_monday(spark):
    day = F.to_date("v")
    assert run(spark, lambda c: tx.monday_of(day), ["2024-03-10", "2024-03-11"]) == ["20240304", "20240311"]

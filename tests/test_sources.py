import hashlib
import json

import pytest
from pyspark.sql import functions as F

from reviewlake.sources import bibliography as bib
from reviewlake.sources import criteria as cr
from reviewlake.sources import tables as tb
from reviewlake.sources import vendors as vd

WOS = "Author Full Names,Article Title,Source Title,Abstract,Author Keywords,Publication Year,DOI,DOI Link\n" \
    'Mira Voss,"Rivers, ""Slow"" ones",Water Letters,"First line\nsecond line",flow;silt,2017,10.5555/w9,http://w.example/9\n'
XPLORE = "Document Title,Abstract,Author Keywords,Authors,Publication Title,Publication Year,DOI,PDF Link\n" \
    "T,A,K,Au,P,2022,,\n"
PLAIN = "title,abstract,authors,keywords,source,year,doi,url,extra\nT,A,Au,K,S,2020.0,,,z\n"
BIB = """@comment{skip @me}
@article{one,
  title = {A {Nested} title, with comma},
  author = "Mira Voss and Olu Adeyemi", journal = {J},
  year = 2021, doi = {10.1/x}, abstract = {Two
  lines}, keywords = "flow, silt"
}
@inproceedings{two, title={B}, booktitle={Conf}, journal={J}, year={2020}, url={https://e.org}}
@misc{three, title={C}, year={2019}}
"""


def test_directory(spark, tmp_path):
    for name, text in (("wos.csv", WOS), ("ieee.csv", XPLORE), ("plain.csv", PLAIN), ("refs.bib", BIB), ("other.txt", "x")):
        (tmp_path / name).write_text(text)
    df = bib.read_directory(spark, str(tmp_path))
    assert df.columns == list(bib.RECORD_COLUMNS) and dict(df.dtypes)["year"] == "int"
    rows = {(r["filename"], r["title"]): r for r in df.collect()}
    assert len(rows) == 6
    wos = rows[("wos", 'Rivers, "Slow" ones')]
    assert (wos["abstract"], wos["year"], wos["authors"]) == ("First line\nsecond line", 2017, "Mira Voss")
    assert (rows[("ieee", "T")]["doi"], rows[("ieee", "T")]["url"]) == ("N/A", "N/A")
    assert rows[("plain", "T")]["year"] == 2020
    one = rows[("refs", "A {Nested} title, with comma")]
    assert one["authors"] == "Mira Voss; Olu Adeyemi" and one["keywords"] == "flow; silt"
    assert (one["source"], one["url"], one["abstract"]) == ("J", "https://doi.org/10.1/x", "Two lines")
    assert rows[("refs", "B")]["source"] == "Conf" and rows[("refs", "B")]["url"] == "https://e.org"
    assert rows[("refs", "C")]["doi"] == "N/A" and rows[("refs", "C")]["url"] == "N/A"


def test_tabs_and_missing_year(spark, tmp_path):
    (tmp_path / "t.csv").write_text(PLAIN.replace(",", "\t"))
    assert bib.read_csv(spark, str(tmp_path / "t.csv"), tabs=True).first()["title"] == "T"
    (tmp_path / "bad.csv").write_text(PLAIN.replace("2020.0", ""))
    with pytest.raises(Exception, match="record without year"):
        bib.read_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_rating_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,score\ns1,1.5\n")
    (tmp_path / "b.tsv").write_text("id\tscore\ns1\t2\n")
    df = bib.read_raters(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.tsv")], "id")
    assert {(r["rater"], r["score"]) for r in df.collect()} == {("a", "1.5"), ("b", "2")}
    with pytest.raises(ValueError, match="unsupported"):
        bib.read_table(spark, "x.xlsx", "id")
    with pytest.raises(ValueError, match="was not found"):
        bib.read_table(spark, str(tmp_path / "a.csv"), "key")


def test_vendor_pages(spark, tmp_path):
    springer = {"records": [{"title": "T", "abstract": "A", "keyword": [" k1", "k2 "], "creators": [{"creator": " X "}], "publicationName": "P", "url": [{"format": "pdf", "value": "p"}], "publicationDate": "2020-02-03"}]}
    scopus = {"search-results": {"entry": [{"dc:title": "S", "author": [{"given-name": "A", "surname": "B"}] * 2, "authkeywords": "a | b", "prism:publicationName": "P", "prism:doi": "10.1/S", "prism:coverDate": "2019-01-01"}]}}
    for name, page in (("springer", springer), ("scopus", scopus)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.json").write_text(json.dumps(page, indent=1))
    df = vd.read_responses(spark, {n: str(tmp_path / n) for n in ("springer", "scopus")})
    rows = {r["backend"]: r for r in df.collect()}
    a, b = rows["springer"], rows["scopus"]
    assert (a["keywords"], a["authors"], a["doi"], a["url"], a["year"]) == ("k1; k2", "X", "N/A", "N/A", 2020)
    assert (b["keywords"], b["authors"], b["url"], b["abstract"]) == ("a; b", "A, B", "https://doi.org/10.1/S", "")


def test_common_values(spark):
    df = spark.createDataFrame([("scopus", "cp"), ("wos", "Article"), ("springer", "Journal"), ("wos", "cp")], "backend string, type string")
    got = [r["common_evidence_type"] for r in vd.common_values(df, "evidence_type", "type").collect()]
    assert sorted(got, key=str) == sorted(["conference", "article", "article", None], key=str)
    assert vd.rename_fields(df.withColumnRenamed("type", "DT"), "wos").columns == ["backend", "evidence_type"]


def test_result_tables(spark, tmp_path):
    out = str(tmp_path / "r")
    day = F.lit("2024-03-13").cast("date")
    make = lambda rows: spark.createDataFrame(rows, "backend string, n int")
    tb.write_by_backend(make([("a", 1), ("b", 2)]), out, day)
    tb.write_by_backend(make([("a", 3)]), out, day)
    rows = spark.read.parquet(out).collect()
    assert {(r["backend"], r["n"], str(r["week"])) for r in rows} == {("a", 3, "20240311"), ("b", 2, "20240311")}
    named = str(tmp_path / "n")
    tb.write_named({"stats": make([("a", 1)]), "diff": make([("b", 2)])}, named)
    tb.write_named({"stats": make([("c", 9)])}, named)
    assert tb.read_named(spark, named, "stats").first()["n"] == 9 and tb.read_named(spark, named, "diff").first()["n"] == 2
    tb.write_bundles(make([("a", 1), ("b", 2)]), str(tmp_path / "s"), "backend", "csv")
    assert (tmp_path / "s" / "backend=a").is_dir()


def test_integrity_and_resume(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.pdf").write_bytes(name.encode())
    files = tb.read_files(spark, str(tmp_path / "*.pdf")).withColumn("path", F.regexp_extract("path", "([a-z]).pdf$", 1))
    good = hashlib.sha256(b"a").hexdigest()
    digests = spark.createDataFrame([("a", f" {good} "), ("b", good)], "path string, sha256 string")
    got = {(r["path"], r["status"]) for r in tb.stale_files(files, digests).collect()}
    assert got == {("b", "changed"), ("c", "missing")}
    out, calls = str(tmp_path / "out"), []

    def step(df):
        calls.append(df.count())
        return df.select("path", F.length("content").alias("n"))

    assert tb.resume(spark, files.where("path <> 'c'"), out, "path", step).count() == 2
    assert tb.resume(spark, files, out, "path", step).count() == 3
    assert calls == [2, 1]


def test_criteria_files(spark, tmp_path):
    item = lambda *labels: [{"label": x, "description": f"d{x}"} for x in labels]
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"review_topic": "t", "inclusion_criteria": item("a", "b"), "exclusion_criteria": item("x")}, indent=1))
    rows = cr.read_selection(spark, str(path)).orderBy("kind", "ord").collect()
    assert [(r["kind"], r["ord"], r["label"]) for r in rows] == [("exclusion", 0, "x"), ("inclusion", 0, "a"), ("inclusion", 1, "b")]
    path.write_text(json.dumps({"review_topic": "t", "inclusion_criteria": item("a", "a"), "exclusion_criteria": []}))
    with pytest.raises(ValueError, match="no criteria.*duplicate label a"):
        cr.read_selection(spark, str(path))
    path.write_text(json.dumps({"topic": "t", "criteria": [{"label": "q", "category": "c", "question": "?", "description": "d", "scoring": "s"}]}))
    assert cr.read_quality(spark, str(path)).first()["label"] == "q"


def test_bibtex_macros_parts_and_parentheses(spark):
    chunks = [
        ("f", "@string{rv = {River Review}}\n@string(lg = rv # { Letters})\n"),
        ("f", "@article(a, title = {A} # { B}, journal = RV, year = 2001, month = mar)\n"),
        ("f", '@article{b, title = "Say {"}x{"} (y), z", journal = lg, year = 2002, keywords = sep # " " # unknown}\n'),
        ("g", "@book{c, journal = rv, title={never closed, year = {2003}"),
        ("g", "@article{d, stray words, title={T}, year={2004}, title={U}}\n@article{e,}\n@misc{}\n"),
        (None, None),
        ("g", ""),
    ]
    df = bib.parse_bibtex(spark.createDataFrame(chunks, "filename string, value string").repartition(3))
    rows = {(r["filename"], r["title"]): r for r in df.collect()}
    assert (rows[("f", "A B")]["source"], rows[("f", "A B")]["year"]) == ("River Review", 2001)
    quoted = rows[("f", 'Say {"}x{"} (y), z')]
    assert (quoted["source"], quoted["keywords"]) == ("River Review Letters", "September unknown")
    assert rows[("g", "U")]["year"] == 2004
    # A macro of another file is unknown; an open brace takes in the rest.
    assert rows[("g", "never closed, year = {2003}")]["source"] == "rv"
    assert df.count() == 6


def test_years_are_whole(spark):
    df = spark.createDataFrame([("2020.7",)], "year string").selectExpr(
        "year", *[f"'x' AS {c}" for c in bib.RECORD_COLUMNS if c != "year"]
    )
    with pytest.raises(Exception, match="whole year"):
        bib.normalise(df).collect()


def test_bibtex_macros_hold_from_where_they_are_defined(spark, tmp_path):
    """A file of many splits in which one macro is defined anew before every entry."""
    lines, want = [], {}
    for i in range(60):
        lines.append('@string{base = "v%d"}\n@string{mid = base # "-mid"}\n@string{top = "<" # MID # ">"}' % i)
        lines.append("@article{k%d,\n title = {T%d},\n journal = top,\n year = 2000\n}" % (i, i))
        want[f"T{i}"] = f"<v{i}-mid>"
    lines.append("@string{self = self # {!}}\n@article{z, title = {Z}, journal = self, abstract = later, year = 1999}")
    lines.append("@string{later = {too late}}")
    want["Z"] = "self!"
    (tmp_path / "many.bib").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        df = bib.read_bibtex(spark, str(tmp_path / "many.bib"))
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["title"]: r["source"] for r in rows} == want
    assert next(r["abstract"] for r in rows if r["title"] == "Z") == "later"


def test_bibtex_long_chain_of_macros(spark):
    chain = ["@string{m0 = {x}}"] + ["@string{m%d = m%d # {y}}" % (i, i - 1) for i in range(1, 8)]
    text = "\n".join(chain) + "\n@book{b, title = m7, year = 2001}"
    (row,) = bib.parse_bibtex(spark.createDataFrame([("f", text)], "filename string, value string")).collect()
    assert row["title"] == "x" + "y" * 7


def test_all_that_is_wrong_with_criteria_files(spark):
    good = {"review_topic": "t", "inclusion_criteria": [{"label": "a", "description": "d"}]}
    good["exclusion_criteria"] = good["inclusion_criteria"]
    labels = [{"label": "a", "description": "d"}, {"label": "b", "description": None}, {"label": "a"}, {"label": "a", "description": [1]}]
    bad = {"review_topic": 5, "inclusion_criteria": labels, "exclusion_criteria": []}
    texts = {"good": json.dumps(good), "bad": json.dumps(bad), "cut": '{"review_topic": "t", "incl', "list": "[1]", "none": None,
             "blank": " ", "type": '{"review_topic": "t", "inclusion_criteria": 7}', "empty": "{}"}
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    got = {tuple(r) for r in cr.criteria_violations(files).collect()}
    assert got == {(p, "invalid_json", "", None) for p in ("cut", "list", "none", "blank", "type")} | {
        ("bad", "not_a_text", "review_topic", "5"),
        ("bad", "missing_text", "inclusion_criteria[1].description", None),
        ("bad", "missing_text", "inclusion_criteria[2].description", None),
        ("bad", "not_a_text", "inclusion_criteria[3].description", "[1]"),
        ("bad", "duplicate_label", "inclusion_criteria", "a"),
        ("bad", "no_criteria", "exclusion_criteria", None),
        ("empty", "missing_text", "review_topic", None),
        ("empty", "no_criteria", "inclusion_criteria", None),
        ("empty", "no_criteria", "exclusion_criteria", None),
    }
    quality = spark.createDataFrame([("q", '{"topic": "t", "criteria": [{"label": "x"}]}')], "path string, text string")
    assert cr.criteria_violations(quality, "quality").count() == 4


def test_bibtex_macro_joins_are_not_broadcast(spark):
    """Spark takes cut entries for a small table; only the heaviest names may be broadcast."""
    text = F.concat(F.lit('@string{a = "x'), "id", F.lit('"}\n@article{k, title = a # "!", year = 2000}\n'))
    texts = spark.range(3).select(F.concat(F.lit("f"), "id").alias("filename"), text.alias("value"))
    read = bib.parse_bibtex(texts)
    assert read._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") == 1
    assert sorted(r["title"] for r in read.collect()) == ["x0!", "x1!", "x2!"]

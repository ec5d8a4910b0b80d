import datetime

import pytest

from reviewlake.operators import predicates as p

DDL = """doc_id long, title string, abstract string, keywords string, author string,
evidence_type string, language string, published date, year int"""
D = datetime.date
ROWS = [
    (1, "Machine learning in review", "deep graph networks", "ml;graph", "Ada", "article", "en", D(2020, 1, 1), 2020),
    (2, "machine\nlearning", "learning deep in the middle", "dl", "Bob", "review", "de", D(2020, 12, 31), 2020),
    (3, "Learned machines", None, None, "Ada", "article", "en", D(2021, 5, 5), 2021),
    (4, None, "Éclair modèles", "cake", None, "book", "fr", D(2019, 6, 1), 2019),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(ROWS, DDL).cache()


def ids(corpus, clause, **kw):
    return sorted(r["doc_id"] for r in corpus.where(clause.on(corpus, **kw)).collect())


def test_pattern():
    assert p.wildcard_pattern("machine learning") == r"machine\slearning"
    assert p.wildcard_pattern("a*b?c+(d.e)") == r"a\w*b\w?c.+(d\.e)"


@pytest.mark.parametrize(
    "clause, want",
    [
        (p.term("machine learning", "title"), [1, 2]),
        (p.term("LEARN*", "title", "abstract"), [1, 2, 3]),
        (p.term("machine?", "title"), [1, 2, 3]),
        (p.term("learning+view", "title"), [1]),
        (p.term("mod?les", "abstract"), [4]),
        (p.all_of(p.term("machine"), p.term("learning")).in_fields("title"), [1, 2]),
        (p.any_of(p.term("graph"), p.term("cake")).in_fields("abstract", "keywords"), [1, 4]),
        (p.negate(p.term("machine", "title")), [4]),
        (~p.term("graph", "keywords") & p.term("Ada", "author"), [3]),
        (p.all_of(p.term("machine"), p.term("Ada", "author")).in_fields("title"), [1, 3]),
        (p.any_of(p.term("cake"), p.all_of(p.term("graph"), p.term("ml"))).in_fields("keywords"), [1, 4]),
        (p.regex(r"^learn\w+\s", "title"), [3]),
        (p.strict_match("machines", "title") | p.loose_match("cake", "keywords"), [3, 4]),
        (p.approx("machina", "title"), []),
        (p.approx("machina", "title", max_edits=1), [1, 2]),
        (p.near("deep", "middle", 2, "abstract"), [2]),
        (p.near("middle", "deep", 1, "abstract"), []),
        (p.near("machine", "learning", 0, "title"), [1, 2]),
        (p.between("published", "2020", "2020"), [1, 2]),
        (p.after("published", "2020-12-31"), [2, 3]),
        (p.before("published", "2020-01-01"), [1, 4]),
        (p.before("published", "2019"), [4]),
        (p.year_range(2020, 2021), [1, 2, 3]),
        (p.exact("article", "evidence_type") & p.languages("en", "de"), [1, 3]),
        (p.all_of(p.doc_types(), p.subject_areas(), p.keywords()), [1, 2, 3, 4]),
        (p.keywords("graph", "cake"), [1, 4]),
        (p.title_abs("deep") & p.title_abs_keys("dl"), [2]),
        (p.all_of(p.term("x", "missing"), p.term("cake", "keywords")), [4]),
    ],
)
def test_clause(corpus, clause, want):
    assert ids(corpus, clause) == want


def test_absent_fields_are_dropped_or_refused(corpus):
    clause = p.term("x", "missing")
    assert ids(corpus, clause) == [1, 2, 3, 4]
    with pytest.raises(ValueError, match="missing"):
        clause.on(corpus, strict=True)


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "corpus")
    spark.createDataFrame(ROWS, DDL).write.parquet(path)
    df = spark.read.parquet(path)
    clause = p.exact("article", "evidence_type") & p.between("published", "2020", "2020")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    try:
        plan = df.where(clause.on(df)).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    assert "EqualTo(evidence_type,article)" in pushed
    assert "GreaterThanOrEqual(published,2020-01-01)" in pushed
    assert "LessThan(published,2021-01-01)" in pushed

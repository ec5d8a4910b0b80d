"""Landed search responses of publishers, brought to one record schema.

Every function takes the JSON text of response pages, one page per row in
column ``value``, and gives records
``title, abstract, keywords, authors, source, doi, url, year``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions.text import doi_url, strip, year_of

MISSING = "N/A"

# Record columns of a search result.
SEARCH_COLUMNS = ("title", "abstract", "keywords", "authors", "source", "doi", "url", "year")

# Names the sources use for the common search fields.
FIELD_NAMES = {
    "scopus": {
        "title": "TITLE",
        "abstract": "ABS",
        "keywords": "AUTHKEY",
        "author": "AUTH",
        "affiliation": "AFFIL",
        "evidence_type": "DOCTYPE",
        "language": "LANGUAGE",
        "subject": "SUBJAREA",
        "published": "PUBYEAR",
    },
    "springer": {
        "title": "title",
        "abstract": "abstract",
        "keywords": "keyword",
        "author": "name",
        "language": "language",
        "subject": "discipline",
        "evidence_type": "type",
    },
    "wos": {
        "title": "TI",
        "abstract": "AB",
        "keywords": "AK",
        "evidence_type": "DT",
        "subject": "WC",
        "language": "LA",
        "published": "DOP",
    },
    "acm": {
        "title": "Title",
        "abstract": "Abstract",
        "keywords": "Keyword",
        "published": "E-Publication Date",
        "evidence_type": "Article Type",
    },
    "xplore": {
        "title": "Document Title",
        "abstract": "Abstract",
        "author": "Authors",
        "keywords": "Author Keywords",
        "affiliation": "Author Affiliations",
        "evidence_type": "content_type",
    },
    "science_direct": {
        "title": "TITLE",
        "abstract": "ABSTRACT",
        "keywords": "KEYWORDS",
        "evidence_type": "CONTENT-TYPE",
        "published": "PUB-DATE",
        "author": "AUTHORS",
    },
}

# Words the sources use for common field values.
FIELD_VALUES = {
    "scopus": {
        "evidence_type": {"article": "ar", "conference": "cp", "review": "re"},
        "subject": {"computer science": "COMP"},
    },
    "springer": {"evidence_type": {"article": "Journal", "conference": "Journal"}},
    "wos": {
        "evidence_type": {"article": "Article"},
        "subject": {"computer science": "Computer Science"},
        "language": {"english": "English"},
    },
    "acm": {
        "evidence_type": {"article": "Research Article", "conference": "Research Article"},
    },
    "xplore": {"evidence_type": {"article": "Journals", "conference": "Conferences"}},
    "science_direct": {"evidence_type": {"article": "JL"}},
}


def value_dictionary(
    spark: SparkSession,
    values: Mapping[str, Mapping[str, Mapping[str, str]]] = FIELD_VALUES,
) -> DataFrame:
    """``(backend, field, vendor_value, value)``; the first of equal words wins."""
    rows, seen = [], set()
    for backend, fields in values.items():
        for field, words in fields.items():
            for word, vendor in words.items():
                if (backend, field, vendor) not in seen:
                    seen.add((backend, field, vendor))
                    rows.append((backend, field, vendor, word))
    return spark.createDataFrame(rows, "backend string, field string, vendor_value string, value string")


def common_values(
    df: DataFrame,
    field: str,
    column: str,
    values: Mapping[str, Mapping[str, Mapping[str, str]]] = FIELD_VALUES,
    backend: str = "backend",
    output: str | None = None,
) -> DataFrame:
    """Add the common word for a source's own value; unknown ones give null.

    The dictionary is a Python constant of known size, hence broadcast.
    """
    words = value_dictionary(df.sparkSession, values).where(F.col("field") == field)
    lookup = words.select(
        F.col("backend").alias("_backend"),
        F.col("vendor_value").alias("_vendor"),
        F.col("value").alias(output or f"common_{field}"),
    )
    return df.join(
        F.broadcast(lookup),
        (F.col(backend) == F.col("_backend")) & (F.col(column) == F.col("_vendor")),
        "left",
    ).drop("_backend", "_vendor")


def rename_fields(df: DataFrame, backend: str) -> DataFrame:
    """A source's field names to the common ones; others stay."""
    names = {theirs: ours for ours, theirs in FIELD_NAMES[backend].items()}
    return df.withColumnsRenamed({c: names[c] for c in df.columns if c in names})


def _joined(items: Column, separator: str = "; ") -> Column:
    return F.coalesce(F.array_join(items, separator), F.lit(""))


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(MISSING))


_SPRINGER = """
records ARRAY<STRUCT<
  title: STRING, abstract: STRING, keyword: ARRAY<STRING>,
  creators: ARRAY<STRUCT<creator: STRING>>, publicationName: STRING, doi: STRING,
  url: ARRAY<STRUCT<format: STRING, value: STRING>>, publicationDate: STRING>>
"""

_SCOPUS = """
`search-results` STRUCT<entry: ARRAY<STRUCT<
  `dc:title`: STRING, `dc:description`: STRING, authkeywords: STRING,
  author: ARRAY<STRUCT<`given-name`: STRING, surname: STRING>>,
  `prism:publicationName`: STRING, `prism:doi`: STRING,
  link: ARRAY<STRUCT<`@ref`: STRING, `@href`: STRING>>, `prism:coverDate`: STRING>>>
"""

_SCIENCE_DIRECT = """
`search-results` STRUCT<entry: ARRAY<STRUCT<
  `dc:title`: STRING, `dc:description`: STRING, authkeywords: STRING,
  authors: STRUCT<author: ARRAY<STRUCT<`$`: STRING>>>,
  `prism:publicationName`: STRING, `prism:doi`: STRING,
  link: ARRAY<STRUCT<`@href`: STRING>>, `available-online-date`: STRING>>>
"""

_WEB_OF_SCIENCE = """
hits ARRAY<STRUCT<
  title: STRING, types: ARRAY<STRING>, source: STRUCT<source_title: STRING>,
  names: STRUCT<authors: ARRAY<STRUCT<display_name: STRING>>>,
  keywords: STRUCT<author_keywords: ARRAY<STRING>>>>
"""


def springer_records(pages: DataFrame) -> DataFrame:
    r = F.col("r")
    rows = pages.select(F.explode(F.from_json("value", _SPRINGER)["records"]).alias("r"))
    html = F.filter(r["url"], lambda u: u["format"] == "html")
    return rows.select(
        r["title"].alias("title"),
        r["abstract"].alias("abstract"),
        _joined(F.transform(r["keyword"], strip)).alias("keywords"),
        _joined(F.transform(r["creators"], lambda c: strip(c["creator"]))).alias("authors"),
        r["publicationName"].alias("source"),
        _filled(r["doi"]).alias("doi"),
        _filled(F.coalesce(F.get(html, F.lit(0))["value"], doi_url(F.nullif(r["doi"], F.lit(""))))).alias("url"),
        year_of(r["publicationDate"]).alias("year"),
    )


def scopus_records(pages: DataFrame) -> DataFrame:
    e = F.col("e")
    rows = pages.select(F.explode(F.from_json("value", _SCOPUS)["search-results"]["entry"]).alias("e"))
    names = F.transform(e["author"], lambda a: F.concat(a["given-name"], F.lit(", "), a["surname"]))
    full_text = F.filter(e["link"], lambda x: x["@ref"] == "full-text")
    return rows.select(
        e["dc:title"].alias("title"),
        F.coalesce(e["dc:description"], F.lit("")).alias("abstract"),
        F.replace(F.coalesce(e["authkeywords"], F.lit("")), F.lit(" |"), F.lit(";")).alias("keywords"),
        _joined(F.array_distinct(names)).alias("authors"),
        e["prism:publicationName"].alias("source"),
        _filled(e["prism:doi"]).alias("doi"),
        _filled(F.coalesce(F.get(full_text, F.lit(0))["@href"], doi_url(e["prism:doi"]))).alias("url"),
        year_of(e["prism:coverDate"]).alias("year"),
    )


def science_direct_records(pages: DataFrame) -> DataFrame:
    e = F.col("e")
    rows = pages.select(
        F.explode(F.from_json("value", _SCIENCE_DIRECT)["search-results"]["entry"]).alias("e")
    )
    words = F.transform(F.split(F.coalesce(e["authkeywords"], F.lit("")), r"\|"), strip)
    return rows.select(
        e["dc:title"].alias("title"),
        e["dc:description"].alias("abstract"),
        _joined(words).alias("keywords"),
        _joined(F.transform(e["authors"]["author"], lambda a: a["$"])).alias("authors"),
        e["prism:publicationName"].alias("source"),
        _filled(e["prism:doi"]).alias("doi"),
        _filled(
            F.coalesce(F.get(e["link"], F.lit(0))["@href"], doi_url(F.lower(e["prism:doi"])))
        ).alias("url"),
        year_of(e["available-online-date"]).alias("year"),
    )


def web_of_science_records(pages: DataFrame) -> DataFrame:
    h = F.col("h")
    rows = pages.select(F.explode(F.from_json("value", _WEB_OF_SCIENCE)["hits"]).alias("h"))
    return rows.select(
        h["title"].alias("title"),
        _joined(F.transform(h["names"]["authors"], lambda a: a["display_name"])).alias("authors"),
        _joined(h["types"]).alias("document_type"),
        h["source"]["source_title"].alias("source"),
        _joined(h["keywords"]["author_keywords"]).alias("keywords"),
    )


PARSERS = {
    "springer": springer_records,
    "scopus": scopus_records,
    "science_direct": science_direct_records,
    "wos": web_of_science_records,
}


def read_responses(spark: SparkSession, folders: Mapping[str, str]) -> DataFrame:
    """Landed JSON pages of several sources as one table with ``backend``."""
    table = None
    for backend, folder in folders.items():
        pages = spark.read.text(folder, wholetext=True)
        part = PARSERS[backend](pages).withColumn("backend", F.lit(backend))
        table = part if table is None else table.unionByName(part, allowMissingColumns=True)
    return table

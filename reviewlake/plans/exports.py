"""Exports of several kinds, derived from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.plans.registry import query, table
from reviewlake.sources import bibliography as bib
from reviewlake.sources import tables as tb
from reviewlake.sources import vendors as vd


def _page(name, *fields):
    """A response page per record: JSON with one entry under ``name``."""
    entry = F.array(F.struct(*fields))
    if "." in name:
        outer, inner = name.split(".")
        return F.to_json(F.struct(F.struct(entry.alias(inner)).alias(outer))).alias("value")
    return F.to_json(F.struct(entry.alias(name))).alias("value")


def _docs(spark, folder):
    day = F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), F.col("doc_id").cast("int")), "yyyy-MM-dd")
    doi = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("10.5/AB"), "doc_id"))
    return table(spark, folder, "documents").withColumns({"day": day, "doi": doi})


def _struct(**fields):
    return F.struct(*[c.alias(n) for n, c in fields.items()])


_EXPECTED = """
    SELECT text AS title, CASE WHEN doc_id % 3 <> 0 THEN '10.5/AB' || doc_id ELSE 'N/A' END AS doi, {fields},
           CAST(year(DATE '2001-01-01' + CAST(doc_id AS INTEGER)) AS INTEGER) AS year, source
    FROM documents
"""


@query(
    _EXPECTED.format(
        fields="""text AS abstract, lang || '; ' || source AS keywords, 'A ' || lang || '; B' AS authors,
    CASE WHEN doc_id % 2 = 0 THEN 'https://example.org/' || doc_id
         WHEN doc_id % 3 <> 0 THEN 'https://doi.org/10.5/AB' || doc_id ELSE 'N/A' END AS url"""
    )
)
def springer_records(spark, folder):
    docs = _docs(spark, folder)
    page = F.concat(F.lit("https://example.org/"), "doc_id")
    link = F.when(F.col("doc_id") % 2 == 0, "html").otherwise("pdf")
    pages = docs.select(
        _page(
            "records",
            F.col("text").alias("title"),
            F.col("text").alias("abstract"),
            F.array(F.concat(F.lit(" "), "lang"), F.col("source")).alias("keyword"),
            F.array(
                _struct(creator=F.concat(F.lit("A "), "lang")), _struct(creator=F.lit(" B "))
            ).alias("creators"),
            F.col("source").alias("publicationName"),
            "doi",
            F.array(_struct(format=F.lit("pdf"), value=F.lit("x")), _struct(format=link, value=page)).alias("url"),
            F.col("day").alias("publicationDate"),
        )
    )
    return vd.springer_records(pages)


@query(
    _EXPECTED.format(
        fields="""'' AS abstract, lang || '; ' || source AS keywords, 'Ann, ' || lang || '; Bo, Y' AS authors,
    CASE WHEN doc_id % 2 = 0 THEN 'https://example.org/' || doc_id
         WHEN doc_id % 3 <> 0 THEN 'https://doi.org/10.5/AB' || doc_id ELSE 'N/A' END AS url"""
    )
)
def scopus_records(spark, folder):
    docs = _docs(spark, folder)
    page = F.concat(F.lit("https://example.org/"), "doc_id")
    kind = F.when(F.col("doc_id") % 2 == 0, "full-text").otherwise("self")
    ann = _struct(**{"given-name": F.lit("Ann"), "surname": F.col("lang")})
    bo = _struct(**{"given-name": F.lit("Bo"), "surname": F.lit("Y")})
    pages = docs.select(
        _page(
            "search-results.entry",
            F.col("text").alias("dc:title"),
            F.concat("lang", F.lit(" | "), "source").alias("authkeywords"),
            F.array(ann, bo, ann).alias("author"),
            F.col("source").alias("prism:publicationName"),
            F.col("doi").alias("prism:doi"),
            F.array(_struct(**{"@ref": kind, "@href": page})).alias("link"),
            F.col("day").alias("prism:coverDate"),
        )
    )
    return vd.scopus_records(pages)


@query(
    _EXPECTED.format(
        fields="""lang AS abstract, lang || '; ' || source AS keywords, 'Ann; ' || lang AS authors,
    CASE WHEN doc_id % 2 = 0 THEN 'https://example.org/' || doc_id
         WHEN doc_id % 3 <> 0 THEN 'https://doi.org/10.5/ab' || doc_id ELSE 'N/A' END AS url"""
    )
)
def science_direct_records(spark, folder):
    docs = _docs(spark, folder)
    page = F.concat(F.lit("https://example.org/"), "doc_id")
    link = F.when(F.col("doc_id") % 2 == 0, F.array(_struct(**{"@href": page})))
    names = F.array(_struct(**{"$": F.lit("Ann")}), _struct(**{"$": F.col("lang")}))
    pages = docs.select(
        _page(
            "search-results.entry",
            F.col("text").alias("dc:title"),
            F.col("lang").alias("dc:description"),
            F.concat("lang", F.lit(" | "), "source").alias("authkeywords"),
            _struct(author=names).alias("authors"),
            F.col("source").alias("prism:publicationName"),
            F.col("doi").alias("prism:doi"),
            link.alias("link"),
            F.col("day").alias("available-online-date"),
        )
    )
    return vd.science_direct_records(pages)


@query(
    """
    SELECT text AS title, 'Ann; ' || lang AS authors, 'Article; ' || lang AS document_type, source,
           lang || '; ' || source AS keywords FROM documents
    """
)
def web_of_science_records(spark, folder):
    pages = _docs(spark, folder).select(
        _page(
            "hits",
            F.col("text").alias("title"),
            F.array(F.lit("Article"), F.col("lang")).alias("types"),
            _struct(source_title=F.col("source")).alias("source"),
            _struct(
                authors=F.array(_struct(display_name=F.lit("Ann")), _struct(display_name=F.col("lang")))
            ).alias("names"),
            _struct(author_keywords=F.array("lang", "source")).alias("keywords"),
        )
    )
    return vd.web_of_science_records(pages)


@query(
    """
    SELECT 'The {' || p_name || '} case' AS title,
           CASE WHEN p_size % 2 = 1 THEN 'end' || p_partkey ELSE '' END AS abstract, 'Doe, J; ' || p_brand AS authors,
           p_type || '; ' || p_name AS keywords,
           CASE WHEN p_size % 2 = 0 THEN p_brand || ' Sons Ltd Letters' ELSE '' END AS source,
           CAST(1990 + p_size AS INTEGER) AS year,
           CASE WHEN p_size % 3 = 0 THEN 'N/A' ELSE '10.1/' || p_partkey END AS doi,
           CASE WHEN p_size % 3 = 0 THEN 'N/A' WHEN p_size % 3 = 1 THEN 'https://doi.org/10.1/' || p_partkey
                ELSE 'https://example.org/' || p_partkey END AS url,
           p_type AS filename
    FROM part
    """
)
def bibtex_records(spark, folder):
    size, key = F.col("p_size"), F.col("p_partkey")
    empty = F.lit("")

    def string(name, value):
        told = F.lit(value) if isinstance(value, str) else value
        return F.concat(F.lit("@string{" + name), key, F.lit(" = "), told, F.lit("}\n"))

    entry = F.concat(
        # Every row defines a chain of macros, its first one twice before and once after the entry,
        # and two macros in a circle; some entries use parentheses.
        string("pub", '"aaa"'),
        string("pub", F.concat(F.lit('"'), "p_brand", F.lit('"'))),
        string("own", F.concat(F.lit("pub"), key, F.lit(' # " Sons"'))),
        string("firm", F.concat(F.lit("OWN"), key, F.lit(' # " " # {Ltd}'))),
        string("ring", F.concat(F.lit("end"), key)),
        string("end", F.concat(F.lit("ring"), key)),
        F.when(size % 5 == 0, "@article(k").otherwise("@article{k"),
        key,
        F.lit(",\n  title = {The {"),
        "p_name",
        F.lit('} case},\n  author = "Doe, J and '),
        "p_brand",
        F.lit('",\n'),
        F.when(size % 2 == 0, F.concat(F.lit("  journal = FIRM"), key, F.lit(' # { } # "Letters",\n'))).otherwise(empty),
        F.when(size % 2 == 1, F.concat(F.lit("  abstract = end"), key, F.lit(",\n"))).otherwise(empty),
        F.when(size % 3 != 0, F.concat(F.lit("  doi={10.1/"), key, F.lit("},\n"))).otherwise(empty),
        F.when(size % 3 == 2, F.concat(F.lit("  url = {https://example.org/"), key, F.lit("},\n"))).otherwise(empty),
        F.lit("  keywords = {"),
        "p_type",
        F.lit(", "),
        "p_name",
        F.lit("},\n  year = "),
        size + 1990,
        F.when(size % 5 == 0, "\n)\n").otherwise("\n}\n"),
        string("pub", '"zzz"'),
    )
    comment = F.lit("@comment{nothing}\n")
    texts = table(spark, folder, "part").select(
        F.col("p_type").alias("filename"), F.concat(comment, entry).alias("value")
    )
    return bib.parse_bibtex(texts)


@query(
    """
    SELECT p_name AS title, p_brand AS abstract, p_type AS authors, p_type AS keywords, p_brand AS source,
           CAST(1990 + p_size AS INTEGER) AS year,
           CASE WHEN p_size % 3 = 0 THEN 'N/A' ELSE '10.1/' || p_partkey END AS doi,
           CASE WHEN p_size % 2 = 0 THEN 'N/A' ELSE 'https://example.org' END AS url, 'xplore' AS filename
    FROM part
    """
)
def mapped_export(spark, folder):
    export = table(spark, folder, "part").select(
        F.col("p_name").alias("Document Title"),
        F.col("p_brand").alias("Abstract"),
        F.col("p_type").alias("Author Keywords"),
        F.col("p_type").alias("Authors"),
        F.col("p_brand").alias("Publication Title"),
        (F.col("p_size") + 1990).cast("string").alias("Publication Year"),
        F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("10.1/"), "p_partkey")).alias("DOI"),
        F.when(F.col("p_size") % 2 != 0, "https://example.org").alias("PDF Link"),
        F.lit("xplore").alias("filename"),
    )
    return bib.normalise(export, bib.HEADERS_BY_STEM["xplore"])


@query(
    """
    SELECT doc_id, sha256(text) AS sha256,
           CASE WHEN lang = 'fr' THEN 'missing' ELSE 'changed' END AS status
    FROM documents WHERE lang IN ('fr', 'de')
    """
)
def content_integrity(spark, folder):
    docs = table(spark, folder, "documents")
    files = docs.select("doc_id", F.encode("text", "utf-8").alias("content"))
    seen = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    digests = docs.where(F.col("lang") != "fr").select("doc_id", F.sha2(seen, 256).alias("sha256"))
    return tb.stale_files(files, digests, "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_yet_labelled(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return tb.not_yet_done(docs, table(spark, folder, "labels"), "doc_id")


@query(
    """
    SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') || '-evaluator'
             || lpad(CAST(o_custkey % 12 + 1 AS VARCHAR), 2, '0') AS bundle,
           lpad(CAST(o_custkey % 30 AS VARCHAR), 4, '0') AS split
    FROM orders
    """
)
def bundle_names(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey",
        tb.evaluator_name(F.col("o_orderdate"), F.col("o_custkey") % 12).alias("bundle"),
        tb.split_name(F.col("o_custkey") % 30).alias("split"),
    )

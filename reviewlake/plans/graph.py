"""Citation snowballing: parts cite the part numbered like their supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.functions.text import normalize_doi
from reviewlake.operators import snowball as sb
from reviewlake.plans.registry import query, table
from reviewlake.scale import cut_lineage

_GRAPH = """
    edges AS (SELECT DISTINCT '10.1/' || {src} AS src, '10.1/' || {dst} AS dst FROM lineitem),
    papers AS (SELECT '10.1/' || p_partkey AS doi, p_name AS title, p_brand AS authors,
                      p_type AS source, CAST(1990 + p_size AS INTEGER) AS year FROM part WHERE p_size <> 7),
    seeds AS (SELECT DISTINCT '10.1/' || p_partkey AS doi FROM part
              WHERE p_brand = 'Brand#3'),
    banned AS (SELECT DISTINCT '10.1/' || p_partkey AS doi FROM part WHERE p_size = 11),
    known0 AS (SELECT doi FROM seeds UNION SELECT doi FROM banned),
    step1 AS (SELECT * FROM edges WHERE src IN (SELECT doi FROM seeds) AND src IN (SELECT doi FROM papers)),
    fresh1 AS (SELECT DISTINCT dst AS doi FROM step1 WHERE dst NOT IN (SELECT doi FROM known0)),
    step2 AS (SELECT * FROM edges WHERE src IN (SELECT doi FROM fresh1) AND src IN (SELECT doi FROM papers)),
    fresh2 AS (SELECT DISTINCT dst AS doi FROM step2 WHERE dst NOT IN (SELECT doi FROM known0)
               AND dst NOT IN (SELECT doi FROM fresh1)),
    links AS (SELECT * FROM (SELECT * FROM step1 UNION SELECT * FROM step2)
              WHERE src NOT IN (SELECT doi FROM banned) AND dst NOT IN (SELECT doi FROM banned)),
    found AS (SELECT papers.* FROM papers WHERE doi IN (
                SELECT doi FROM fresh1 UNION SELECT doi FROM fresh2))
"""
_RECORDS = """
    SELECT row_number() OVER (ORDER BY doi) - 1 AS cluster_id, doi, title, authors,
      CAST(NULL AS VARCHAR) AS abstract, source, 'https://doi.org/' || doi AS url, year,
      CAST(NULL AS VARCHAR) AS has_pdf, CAST(NULL AS VARCHAR) AS pdf_url,
      (SELECT count(*) FROM links WHERE dst = found.doi) AS linking_papers,
      CAST(NULL AS VARCHAR) AS include
    FROM found
"""


def _doi(c):
    return F.concat(F.lit("10.1/"), c)


def _inputs(spark, folder, src, dst):
    part = table(spark, folder, "part")
    papers = part.where(F.col("p_size") != 7).select(
        _doi("p_partkey").alias("doi"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("authors"),
        F.col("p_type").alias("source"),
        (F.col("p_size") + 1990).cast("int").alias("year"),
    )
    edges = table(spark, folder, "lineitem").select(_doi(src).alias("src"), _doi(dst).alias("dst"))
    chosen = F.col("p_brand") == "Brand#3"
    written = part.select("*", F.concat(F.lit(" HTTPS://DOI.ORG/10.1/"), "p_partkey").alias("doi"))
    seeds = sb.read_ids(written.where(chosen))
    banned = sb.read_ids(written.where(F.col("p_size") == 11))
    return papers, cut_lineage(edges.distinct()), seeds, banned


def _run(spark, folder, src, dst):
    papers, edges, seeds, banned = _inputs(spark, folder, src, dst)
    result = sb.snowball(papers, edges, seeds, banned, depth=2)
    return sb.snowball_records(papers, result)


@query("WITH " + _GRAPH.format(src="l_partkey", dst="l_suppkey") + _RECORDS)
def snowball_backward(spark, folder):
    return _run(spark, folder, "l_partkey", "l_suppkey")


@query("WITH " + _GRAPH.format(src="l_suppkey", dst="l_partkey") + _RECORDS)
def snowball_forward(spark, folder):
    return _run(spark, folder, "l_suppkey", "l_partkey")


@query("WITH " + _GRAPH.format(src="l_partkey", dst="l_suppkey") + "SELECT src, dst FROM links")
def snowball_links(spark, folder):
    papers, edges, seeds, banned = _inputs(spark, folder, "l_partkey", "l_suppkey")
    return sb.snowball(papers, edges, seeds, banned, depth=2).links.select("src", "dst")


@query(
    "WITH "
    + _GRAPH.format(src="l_suppkey", dst="l_partkey")
    + """
    SELECT dst AS doi, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS ord, src AS item
    FROM links WHERE dst IN (SELECT doi FROM found)
    """
)
def snowball_linked_ids(spark, folder):
    papers, edges, seeds, banned = _inputs(spark, folder, "l_suppkey", "l_partkey")
    return sb.linked_ids(sb.snowball(papers, edges, seeds, banned, depth=2))


@query(
    """
    SELECT DISTINCT '10.1/' || o_custkey AS doi FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY')
    """
)
def missing_inputs(spark, folder):
    seeds = table(spark, folder, "orders").select(_doi("o_custkey").alias("doi"))
    papers = table(spark, folder, "customer").where(F.col("c_mktsegment") != "MACHINERY")
    return sb.missing_inputs(papers.select(_doi("c_custkey").alias("doi")), seeds)


@query(
    """
    SELECT doi, (row_number() OVER (ORDER BY doi) - 1) // 500 AS batch FROM (
      SELECT DISTINCT '10.1/' || l_partkey AS doi FROM lineitem)
    """
)
def id_batches(spark, folder):
    return sb.id_batches(table(spark, folder, "lineitem").select(_doi("l_partkey").alias("doi")))


@query(
    """
    SELECT page_id, nullif(regexp_replace(lower(trim(raw)),
             '^(https://doi\\.org/|http://doi\\.org/|https://dx\\.doi\\.org/|http://dx\\.doi\\.org/|doi:)', ''),
             '') AS doi
    FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN ' HTTPS://DOI.ORG/' WHEN 1 THEN 'doi:'
                 WHEN 2 THEN 'http://dx.doi.org/' WHEN 3 THEN '' ELSE 'https://other.org/' END
            || CASE WHEN page_id % 7 = 0 THEN ' ' ELSE url END AS raw FROM pages)
    """
)
def normalize_doi_column(spark, folder):
    kind = F.col("page_id") % 5
    prefix = (
        F.when(kind == 0, " HTTPS://DOI.ORG/")
        .when(kind == 1, "doi:")
        .when(kind == 2, "http://dx.doi.org/")
        .when(kind == 3, "")
        .otherwise("https://other.org/")
    )
    rest = F.when(F.col("page_id") % 7 == 0, " ").otherwise(F.col("url"))
    return table(spark, folder, "pages").select(
        "page_id", normalize_doi(F.concat(prefix, rest)).alias("doi")
    )

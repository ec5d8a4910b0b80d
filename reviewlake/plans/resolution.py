"""Entity resolution queries on the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.operators import resolve as rs
from reviewlake.plans.registry import query, table
from reviewlake.plans.search import N

FIELDS = (
    rs.Field("title", "words", 0.8),
    rs.Field("source", "equal", 0.1),
    rs.Field("authors", "equal", 0.1),
)
THRESHOLD = 0.65

# A document as a publication: the whole text is the title.
RECORDS = """
    records AS (
      SELECT doc_id AS record_id, text AS title, lang AS authors, source,
        lang || ';' || upper(source) || '; ' || lang AS keywords,
        CASE WHEN n_chars % 3 = 0 THEN NULL WHEN n_chars % 3 = 1 THEN '  '
             ELSE lang || ' ' || source END AS abstract,
        CASE WHEN n_chars % 2 = 0 THEN '10.5555/' || n_chars ELSE 'N/A' END AS doi,
        CASE WHEN n_chars % 5 = 0 THEN 'N/A' WHEN n_chars % 5 < 3 THEN 'https://doi.org/10.5555/' || n_chars
             ELSE 'https://example.org/' || doc_id END AS url,
        CAST(2000 + n_chars % 25 AS INTEGER) AS year, source AS filename
      FROM documents)
"""


def records_of(spark, folder):
    n = F.col("n_chars")
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("record_id"),
        F.col("text").alias("title"),
        F.col("lang").alias("authors"),
        "source",
        F.concat("lang", F.lit(";"), F.upper("source"), F.lit("; "), "lang").alias("keywords"),
        F.when(n % 3 == 2, F.concat_ws(" ", "lang", "source"))
        .when(n % 3 == 1, F.lit("  "))
        .alias("abstract"),
        F.when(n % 2 == 0, F.concat(F.lit("10.5555/"), n)).otherwise("N/A").alias("doi"),
        F.when(n % 5 == 0, "N/A")
        .when(n % 5 < 3, F.concat(F.lit("https://doi.org/10.5555/"), n))
        .otherwise(F.concat(F.lit("https://example.org/"), "doc_id"))
        .alias("url"),
        (n % 25 + 2000).cast("int").alias("year"),
        F.col("source").alias("filename"),
    )


def _clean(c: str) -> str:
    return rf"nullif(regexp_replace(lower({c}), '^[\x22\x27 \t\n\r]+|[\x22\x27 \t\n\r]+$', '', 'g'), '')"


# Copies are equal in all compared fields; pairs are found by brute force.
VARIANTS = f"""
    {RECORDS},
    cleaned AS (SELECT record_id, {_clean("title")} AS t, {_clean("source")} AS s,
                  {_clean("authors")} AS a FROM records),
    sets AS (SELECT record_id, s, a, list_sort(list_distinct(list_filter(
               string_split_regex(coalesce(t, ''), '{N}+'), lambda x: x <> ''))) AS words FROM cleaned),
    keyed AS (SELECT record_id, min(record_id) OVER (
                PARTITION BY s, a, array_to_string(words, ' ')) AS first_id
              FROM sets JOIN cleaned USING (record_id, s, a))
"""
PAIRS = f"""
    {VARIANTS},
    v AS (SELECT sets.* FROM sets JOIN keyed USING (record_id) WHERE record_id = first_id),
    words AS (SELECT record_id, len(words) AS n, unnest(words) AS word FROM v),
    common AS (SELECT x.record_id AS l, y.record_id AS r, count(*) AS c, any_value(x.n) AS ln,
                 any_value(y.n) AS rn
               FROM words x JOIN words y ON x.word = y.word AND x.record_id < y.record_id
               GROUP BY x.record_id, y.record_id),
    jac AS (SELECT l, r, CAST(c AS DOUBLE) / (ln + rn - c) AS j FROM common),
    pairs AS (
      SELECT l AS left_id, r AS right_id,
        (0.8 * j + 0.1 * CAST(x.s = y.s AS INTEGER) + 0.1 * CAST(x.a = y.a AS INTEGER)) AS score
      FROM jac JOIN v x ON x.record_id = l JOIN v y ON y.record_id = r
      WHERE score >= {THRESHOLD})
"""
CLUSTERS = f"""
    {PAIRS},
    links AS MATERIALIZED (
      SELECT left_id AS x, right_id AS y FROM pairs UNION SELECT right_id, left_id FROM pairs
      UNION SELECT record_id, first_id FROM keyed UNION SELECT first_id, record_id FROM keyed),
    reach(x, y) AS (
      SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
    comp AS (SELECT x AS record_id, min(y) AS root FROM reach GROUP BY x),
    numbered AS (SELECT record_id, dense_rank() OVER (ORDER BY root) - 1 AS cluster_id FROM comp),
    bags AS (SELECT record_id, cluster_id, list_distinct(list_filter(string_split_regex(lower(
               concat_ws(' ', t, s, a)), '{N}+'), lambda x: x <> '')) AS words
             FROM cleaned JOIN numbered USING (record_id)),
    sizes AS (SELECT cluster_id, count(*) AS members, sum(len(words)) AS total FROM bags GROUP BY 1),
    tokens AS (SELECT record_id, cluster_id, unnest(words) AS word FROM bags),
    freq AS (SELECT cluster_id, word, count(*) AS f FROM tokens GROUP BY ALL),
    conf AS (SELECT record_id, cluster_id,
               CAST(2 * sum(f) AS DOUBLE) / (count(*) * any_value(members) + any_value(total)) AS confidence
             FROM tokens JOIN freq USING (cluster_id, word) JOIN sizes USING (cluster_id)
             GROUP BY record_id, cluster_id)
"""


@query(f"WITH {VARIANTS} SELECT record_id AS src, first_id AS dst FROM keyed WHERE record_id <> first_id")
def dedup_identity(spark, folder):
    table_ = rs.comparable(records_of(spark, folder), FIELDS, "title")
    return rs.identity_links(table_, FIELDS)


def _pairs(spark, folder):
    table_ = rs.comparable(records_of(spark, folder), FIELDS, "title")
    same = rs.identity_groups(table_, FIELDS)
    return rs.similar_pairs(table_, FIELDS, "title", None, THRESHOLD, same)


@query(f"WITH {PAIRS} SELECT left_id, right_id, round(score, 6) AS score FROM pairs")
def dedup_pairs(spark, folder):
    return _pairs(spark, folder).withColumn("score", F.round("score", 6))


@query(
    f"""
    WITH {PAIRS} SELECT left_id, right_id, round(score, 6) AS score FROM pairs
    ORDER BY round(abs(score - 0.8), 9), left_id, right_id LIMIT 25
    """
)
def label_candidates(spark, folder):
    found = rs.label_candidates(_pairs(spark, folder), 25, 0.8)
    return found.withColumn("score", F.round("score", 6))


# Pages as publications, and again as another export has them: a letter of the
# title is missing, and some titles, sources and DOIs.
_WEB = """
    web AS (SELECT page_id, url, nullif(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1),
        '[^ -~]', '', 'g'), '') AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
        regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host,
        replace(regexp_extract(url, '^[a-z]+://[^/]+/([^?]*)', 1), '/', ';') AS path FROM pages),
    web_records AS (
      SELECT 2 * page_id AS record_id, title, host AS authors, path AS keywords, lang AS source,
        CASE WHEN page_id % 3 = 0 THEN 'https://doi.org/10.7/P' || page_id END AS doi FROM web
      UNION ALL SELECT 2 * page_id + 1,
        CASE WHEN page_id % 7 > 0 THEN substr(title, 1, page_id % length(title))
          || substr(title, page_id % length(title) + 2) END,
        upper(host), path, CASE WHEN page_id % 5 > 0 THEN lang END,
        CASE WHEN page_id % 2 > 0 THEN 'doi:10.7/p' || page_id END FROM web)
"""


def web_records(spark, folder):
    id_, title = F.col("page_id"), F.col("title")
    page = table(spark, folder, "pages").select(
        "page_id",
        F.nullif(
            F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "[^ -~]", ""), F.lit("")
        ).alias("title"),
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"),
        F.replace(F.regexp_extract("url", "^[a-z]+://[^/]+/([^?]*)", 1), F.lit("/"), F.lit(";")).alias("path"),
    )
    first = page.select(
        (2 * id_).alias("record_id"),
        "title",
        F.col("host").alias("authors"),
        F.col("path").alias("keywords"),
        F.col("lang").alias("source"),
        F.when(id_ % 3 == 0, F.concat(F.lit("https://doi.org/10.7/P"), id_)).alias("doi"),
    )
    at = id_ % F.length(title)
    fewer = F.concat(F.substr(title, F.lit(1), at.cast("int")), F.substr(title, (at + 2).cast("int")))
    second = page.select(
        (2 * id_ + 1).alias("record_id"),
        F.when(id_ % 7 > 0, fewer).alias("title"),
        F.upper("host").alias("authors"),
        F.col("path").alias("keywords"),
        F.when(id_ % 5 > 0, F.col("lang")).alias("source"),
        F.when(id_ % 2 > 0, F.concat(F.lit("doi:10.7/p"), id_)).alias("doi"),
    )
    return first.unionByName(second)


def _edits(c: str) -> str:
    return f"1 - levenshtein(x.{c}, y.{c}) / greatest(length(x.{c}), length(y.{c}))::DOUBLE"


# All pairs are scored, none is left out.
_WEB_PAIRS = f"""
    {_WEB},
    values_ AS (SELECT record_id, {_clean("title")} AS title, {_clean("authors")} AS authors,
        {_clean("source")} AS source, list_distinct(list_filter(string_split_regex({_clean("keywords")}, '{N}+'),
          lambda w: w <> '')) AS keywords,
        regexp_replace(lower(doi), '^(https://doi.org/|doi:)', '') AS doi FROM web_records),
    scores AS (SELECT x.record_id AS left_id, y.record_id AS right_id,
        {_edits("title")} AS title, {_edits("authors")} AS authors, {_edits("source")} AS source,
        CASE WHEN len(x.keywords) > 0 AND len(y.keywords) > 0
          THEN len(list_intersect(x.keywords, y.keywords))::DOUBLE
          / len(list_distinct(list_concat(x.keywords, y.keywords))) END AS keywords,
        CASE WHEN x.doi IS NOT NULL AND y.doi IS NOT NULL THEN (x.doi = y.doi)::INT::DOUBLE END AS doi
      FROM values_ x JOIN values_ y ON x.record_id < y.record_id),
    weighed AS (SELECT left_id, right_id, (coalesce(0.4 * title, 0) + coalesce(0.2 * authors, 0)
        + coalesce(0.1 * keywords, 0) + coalesce(0.1 * source, 0) + coalesce(0.2 * doi, 0))
        / (CASE WHEN title IS NULL THEN 0 ELSE 0.4 END + CASE WHEN authors IS NULL THEN 0 ELSE 0.2 END
          + CASE WHEN keywords IS NULL THEN 0 ELSE 0.1 END + CASE WHEN source IS NULL THEN 0 ELSE 0.1 END
          + CASE WHEN doi IS NULL THEN 0 ELSE 0.2 END) AS score FROM scores)
"""


@query(f"WITH {_WEB_PAIRS} SELECT left_id, right_id, round(score, 6) AS score FROM weighed WHERE score >= 0.85")
def dedup_all_fields(spark, folder):
    """Pairs by all compared fields, without a gate on any of them."""
    table_ = rs.comparable(web_records(spark, folder), rs.DEFAULT_FIELDS, "title")
    found = rs.similar_pairs(table_, rs.DEFAULT_FIELDS, "title", None, 0.85)
    return found.withColumn("score", F.round("score", 6))


def _resolved(spark, folder):
    return rs.resolve(records_of(spark, folder), FIELDS, "title", None, THRESHOLD)


@query(
    f"""
    WITH RECURSIVE {CLUSTERS}
    SELECT record_id, CAST(cluster_id AS BIGINT) AS cluster_id,
           round(coalesce(confidence, 1.0), 6) AS confidence
    FROM numbered LEFT JOIN conf USING (record_id, cluster_id)
    """
)
def dedup_clusters(spark, folder):
    return _resolved(spark, folder).select(
        "record_id", "cluster_id", F.round("confidence", 6).alias("confidence")
    )


MEMBERS = f"""
    {CLUSTERS},
    m AS (SELECT records.*, cluster_id, coalesce(confidence, 1.0) AS confidence
          FROM records JOIN numbered USING (record_id) LEFT JOIN conf USING (record_id, cluster_id)),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id
               ORDER BY confidence DESC, record_id) AS rn FROM m) WHERE rn = 1)
"""


@query(
    f"""
    WITH RECURSIVE {MEMBERS},
    dois AS (SELECT * FROM (SELECT cluster_id, doi, row_number() OVER (PARTITION BY cluster_id
               ORDER BY length(doi) DESC, record_id) AS rn FROM m) WHERE rn = 1),
    urls AS (SELECT * FROM (SELECT cluster_id, url, row_number() OVER (PARTITION BY cluster_id
               ORDER BY CASE WHEN url = 'N/A' THEN 0 WHEN contains(url, 'doi.org') THEN 1 ELSE 2 END DESC,
                 record_id) AS rn FROM m) WHERE rn = 1)
    SELECT CAST(cluster_id AS BIGINT) AS cluster_id,
      (SELECT count(*) FROM m WHERE m.cluster_id = best.cluster_id) AS members, title, authors, source,
      CASE WHEN trim(coalesce(abstract, '')) <> '' THEN abstract ELSE '' END AS abstract,
      dois.doi, urls.url, year, CAST(NULL AS VARCHAR) AS include
    FROM best JOIN dois USING (cluster_id) JOIN urls USING (cluster_id)
    """
)
def golden_record(spark, folder):
    return rs.golden_records(_resolved(spark, folder))


@query(
    f"""
    WITH RECURSIVE {MEMBERS},
    words_ AS (SELECT cluster_id, record_id, generate_subscripts(ks, 1) AS spot, unnest(ks) AS k FROM (
               SELECT cluster_id, record_id, list_transform(string_split(keywords, ';'),
                 lambda x: lower(trim(x))) AS ks FROM m)),
    items AS (
      SELECT cluster_id, 'provenance' AS kind, record_id * 1000 AS place,
        '(' || filename || ',' || record_id || ')' AS item FROM m
      UNION ALL SELECT cluster_id, 'keywords', min(record_id * 1000 + spot), k FROM words_ GROUP BY cluster_id, k
      UNION ALL SELECT m.cluster_id, 'abstract', min(m.record_id * 1000), m.abstract
        FROM m JOIN best USING (cluster_id)
        WHERE trim(m.abstract) <> '' AND trim(coalesce(best.abstract, '')) = ''
        GROUP BY m.cluster_id, m.abstract)
    SELECT CAST(cluster_id AS BIGINT) AS cluster_id, kind,
      row_number() OVER (PARTITION BY cluster_id, kind ORDER BY place) - 1 AS ord, item FROM items
    """
)
def golden_lists(spark, folder):
    return rs.golden_lists(_resolved(spark, folder))

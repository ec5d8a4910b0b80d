"""Search, filter and retrieval-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.functions.text import comparison_key
from reviewlake.operators import predicates as p
from reviewlake.operators.retrieval import search_quality as quality_of
from reviewlake.plans.registry import query, table
from reviewlake.sources.vendors import common_values

# DuckDB's \w and \b are ASCII only; these classes are the Unicode ones.
W = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
N = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"


def _near(a: str, b: str, n: int) -> str:
    return rf"(^|{N}){a}(?:{N}+{W}+){{0,{n}}}{N}+{b}($|{N})"


@query(
    """
    SELECT doc_id, lang, source FROM documents
    WHERE (contains(lower(text), 'thtion') OR contains(lower(text), 'attion')
           OR contains(lower(source), 'src1'))
      AND NOT contains(lower(text), 'erble')
      AND lang LIKE '%e%'
    """
)
def search_boolean(spark, folder):
    docs = table(spark, folder, "documents")
    clause = p.all_of(
        p.any_of(p.term("thtion"), p.term("ATTION"), p.term("src1", "source", "venue")),
        p.negate(p.term("erble")),
        p.term("e", "lang"),
        p.term("ignored", "no_such_field"),
    ).in_fields("text")
    return docs.where(clause.on(docs)).select("doc_id", "lang", "source")


@query(
    rf"""
    SELECT doc_id FROM documents
    WHERE regexp_matches(text, 'th{W}*ble{W}?s', 'is')
       OR regexp_matches(text, '(and|the)\s(of|with).+hablees', 'is')
    """
)
def search_wildcard(spark, folder):
    docs = table(spark, folder, "documents")
    clause = p.any_of(
        p.term("th*ble?s"),
        *[p.term(f"{a} {b}+hablees") for a in ("and", "the") for b in ("of", "with")],
    ).in_fields("text")
    return docs.where(clause.on(docs)).select("doc_id")


@query(
    r"""
    SELECT doc_id FROM documents
    WHERE regexp_matches(text, 'on[aeiou]{2,3}[^.]{0,20}tion\.', 'is')
      AND lang IN ('en', 'de')
    """
)
def search_regex(spark, folder):
    docs = table(spark, folder, "documents")
    clause = p.all_of(
        p.regex(r"on[aeiou]{2,3}[^.]{0,20}tion\.", "text"), p.languages("en", "de", field="lang")
    )
    return docs.where(clause.on(docs)).select("doc_id")


@query(
    f"""
    SELECT doc_id FROM documents
    WHERE regexp_matches(text, '{_near("the", f"th{W}*ing", 3)}', 'is')
       OR regexp_matches(text, '{_near(f"th{W}*ing", "the", 3)}', 'is')
    """
)
def search_near(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.where(p.near("the", "th*ing", 3, "text").on(docs)).select("doc_id")


@query(
    f"""
    SELECT doc_id FROM (
      SELECT doc_id, unnest(string_split_regex(lower(text), '{N}+')) AS word FROM documents)
    WHERE levenshtein(word, 'thanedblee') <= 1
    GROUP BY doc_id
    """
)
def search_fuzzy(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.where(p.approx("thanedblee", "text", max_edits=1).on(docs)).select("doc_id")


@query(
    """
    SELECT o_orderkey, o_orderpriority FROM orders
    WHERE (o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01')
       OR o_orderdate < TIMESTAMP '1995-02-11'
       OR o_orderdate >= TIMESTAMP '2000-06-01'
    """
)
def date_between_years(spark, folder):
    orders = table(spark, folder, "orders")
    clause = (
        p.between("o_orderdate", "1996", "1997")
        | p.before("o_orderdate", "1995-02-10")
        | p.after("o_orderdate", "2000-06-01")
    )
    return orders.where(clause.on(orders)).select("o_orderkey", "o_orderpriority")


@query(
    """
    SELECT doc_id, lang, source FROM documents
    WHERE lang IN ('fr', 'de') AND (source = 'src1' OR source = 'src7')
      AND contains(lower(text), 'en')
    """
)
def filter_fields(spark, folder):
    docs = table(spark, folder, "documents")
    clause = p.all_of(
        p.languages("fr", "de", field="lang"),
        p.any_of(p.exact("src1"), p.exact("src7")).in_fields("source"),
        p.doc_types(),
        p.term("en", "text"),
    )
    return docs.where(clause.on(docs)).select("doc_id", "lang", "source")


@query(
    """
    SELECT p_partkey, year FROM (
      SELECT p_partkey, p_name AS title, p_brand AS abstract, p_type AS keywords,
             1990 + p_size AS year FROM part)
    WHERE (contains(lower(title), 'ring') OR contains(lower(abstract), 'ring')
           OR contains(lower(keywords), 'ring') OR contains(lower(title), '#1')
           OR contains(lower(abstract), '#1'))
      AND year BETWEEN 1995 AND 2020
      AND (contains(lower(keywords), 'small') OR contains(lower(keywords), 'promo'))
      AND keywords IN ('SMALL', 'PROMO', 'LARGE')
    """
)
def builder_predicates(spark, folder):
    records = table(spark, folder, "part").select(
        "p_partkey",
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("abstract"),
        F.col("p_type").alias("keywords"),
        (F.col("p_size") + 1990).alias("year"),
    )
    clause = p.all_of(
        p.any_of(p.title_abs_keys("ring"), p.title_abs("#1")),
        p.year_range(1995, 2020),
        p.keywords("small", "promo"),
        p.subject_areas("SMALL", "PROMO", "LARGE", field="keywords"),
        p.languages(),
    )
    return records.where(clause.on(records)).select("p_partkey", "year")


@query(
    """
    SELECT priority, CAST(count(*) AS BIGINT) AS n FROM (
      SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high'
             WHEN '3-MEDIUM' THEN 'medium' END AS priority FROM orders)
    GROUP BY priority
    """
)
def value_mapping(spark, folder):
    words = {
        "shop": {"priority": {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM"}}
    }
    orders = table(spark, folder, "orders").withColumn("backend", F.lit("shop"))
    mapped = common_values(orders, "priority", "o_orderpriority", words, output="priority")
    return mapped.groupBy("priority").agg(F.count("*").alias("n"))


@query(
    """
    SELECT c_custkey,
           lower(trim(c_name)) || '_' || lower(trim(c_mktsegment)) || '_' AS key
    FROM customer
    """
)
def comparison_keys(spark, folder):
    customers = table(spark, folder, "customer")
    key = comparison_key(["c_name", "c_mktsegment", "absent"], customers.columns)
    return customers.select("c_custkey", key.alias("key"))


_HITS = "contains(lower(text), 'ing') AND NOT contains(lower(text), 'erble')"
_SCORES = """
    tp, fn, fp,
    round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision,
    round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall,
    round(CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1,
    round(CASE WHEN tp + fp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp + fn) END, 6) AS jaccard,
    round(CASE WHEN tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS dice
"""
_ROUNDED = ("precision", "recall", "f1", "jaccard", "dice")


def _rounded(df):
    return df.drop("columns").withColumns({c: F.round(c, 6) for c in _ROUNDED})


def _retrieved(docs):
    clause = p.all_of(p.term("ing"), p.negate(p.term("erble"))).in_fields("text")
    return docs.where(clause.on(docs)).select("doc_id")


@query(
    f"""
    WITH j AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
         r AS (SELECT DISTINCT doc_id FROM documents WHERE {_HITS}),
         c AS (SELECT (SELECT count(*) FROM j JOIN r USING (doc_id)) AS tp,
                      (SELECT count(*) FROM j ANTI JOIN r USING (doc_id)) AS fn,
                      (SELECT count(*) FROM r ANTI JOIN j USING (doc_id)) AS fp)
    SELECT {_SCORES} FROM c
    """
)
def search_quality(spark, folder):
    docs = table(spark, folder, "documents")
    good = table(spark, folder, "labels").where(F.col("quality") == 1).select("doc_id")
    return _rounded(quality_of(good, _retrieved(docs), ["doc_id"]))


@query(
    f"""
    WITH j AS (SELECT DISTINCT lang, doc_id FROM labels JOIN documents USING (doc_id)
               WHERE quality = 1),
         r AS (SELECT DISTINCT doc_id, 1 AS hit FROM documents WHERE {_HITS}),
         c AS (SELECT lang, count(hit) AS tp, count(*) - count(hit) AS fn,
                      (SELECT count(*) FROM r) - count(hit) AS fp
               FROM j LEFT JOIN r USING (doc_id) GROUP BY lang)
    SELECT lang, {_SCORES} FROM c
    """
)
def search_quality_multi(spark, folder):
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").where(F.col("quality") == 1)
    judged = labels.join(docs.select("doc_id", "lang"), "doc_id").select("lang", "doc_id")
    return _rounded(quality_of(judged, _retrieved(docs), ["doc_id"], judgment="lang"))


@query(
    """
    WITH a AS (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en'),
         b AS (SELECT DISTINCT doc_id FROM labels)
    SELECT (SELECT count(*) FROM a SEMI JOIN b USING (doc_id)) AS common,
           (SELECT count(*) FROM a ANTI JOIN b USING (doc_id)) AS only_left,
           (SELECT count(*) FROM b ANTI JOIN a USING (doc_id)) AS only_right
    """
)
def set_sizes(spark, folder):
    a = table(spark, folder, "documents").where(F.col("lang") == "en").select("doc_id", F.lit(1).alias("l"))
    b = table(spark, folder, "labels").select("doc_id").distinct().withColumn("r", F.lit(1))
    return a.join(b, "doc_id", "full").agg(
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common"),
        F.count_if(F.col("r").isNull()).alias("only_left"),
        F.count_if(F.col("l").isNull()).alias("only_right"),
    )

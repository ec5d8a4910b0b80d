"""Queries that write tables to the shared work folder and read them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.operators import layout as ly
from reviewlake.operators import predicates as p
from reviewlake.plans.registry import query, table
from reviewlake.scale import work_folder
from reviewlake.sources import bibliography as bib
from reviewlake.sources import tables as tb


@query(
    """
    SELECT p_name AS title, p_brand || ', "' || p_type || '"' AS abstract, p_type AS authors, p_type AS keywords,
      p_brand AS source, CAST(1990 + p_size AS INTEGER) AS year,
      CASE WHEN p_size % 3 = 0 THEN 'N/A' ELSE '10.1/' || p_partkey END AS doi, 'N/A' AS url
    FROM part
    """
)
def csv_export(spark, folder):
    """An export in the columns of its kind, written as CSV with quotes and commas."""
    path = f"{work_folder(spark)}/export.csv"
    export = table(spark, folder, "part").select(
        F.col("p_name").alias("Article Title"),
        F.concat("p_brand", F.lit(', "'), "p_type", F.lit('"')).alias("Abstract"),
        F.col("p_type").alias("Author Keywords"),
        F.col("p_type").alias("Author Full Names"),
        F.col("p_brand").alias("Source Title"),
        (F.col("p_size") + 1990).alias("Publication Year"),
        F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("10.1/"), "p_partkey")).alias("DOI"),
        F.lit(None).cast("string").alias("DOI Link"),
    )
    export.write.csv(path, header=True, quote='"', escape='"')
    return bib.read_csv(spark, path, bib.WEB_OF_SCIENCE_HEADERS).drop("filename")


@query(
    """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN 'odd' ELSE 'even' END AS rater
    FROM lineitem
    """
)
def rater_files(spark, folder):
    """Files of two raters, one of them CSV, tagged with their names."""
    path = work_folder(spark)
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    odd = F.col("l_linenumber") % 2 == 1
    lines.where(odd).write.csv(f"{path}/odd.csv", header=True)
    lines.where(~odd).write.parquet(f"{path}/even.parquet")
    both = bib.read_raters(spark, [f"{path}/odd.csv", f"{path}/even.parquet"], "l_orderkey")
    return both.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in lines.schema], "rater")


@query(
    """
    WITH d AS (SELECT doc_id, lang, source AS backend, doc_id % 28 < 14 AND lang = 'en' AS again,
        CAST(date_trunc('week', DATE '2001-01-01' + CAST(doc_id % 28 AS INTEGER)) AS DATE) AS week
      FROM documents)
    SELECT doc_id, backend, CAST(strftime(week, '%Y%m%d') AS INTEGER) AS week, 2 AS run FROM d WHERE again
    UNION ALL
    SELECT doc_id, backend, CAST(strftime(week, '%Y%m%d') AS INTEGER), 1 FROM d
    WHERE NOT EXISTS (SELECT 1 FROM d o WHERE o.again AND o.week = d.week AND o.backend = d.backend)
    """
)
def weekly_tables(spark, folder):
    """A second run replaces the weeks and backends it has rows for, and no others."""
    path = work_folder(spark)
    docs = table(spark, folder, "documents")
    day = F.col("doc_id") % 28
    found = docs.select(
        "doc_id",
        "lang",
        F.col("source").alias("backend"),
        F.date_add(F.lit("2001-01-01").cast("date"), day.cast("int")).alias("day"),
    )
    again = found.where((day < 14) & (F.col("lang") == "en"))
    for number, rows in enumerate((found, again), 1):
        tb.write_by_backend(rows.withColumn("run", F.lit(number)), path, F.col("day"))
    return spark.read.parquet(path).select("doc_id", "backend", F.col("week").cast("int").alias("week"), "run")


@query(
    """
    SELECT doc_id, 'short' AS name FROM documents WHERE n_chars < 500
    UNION ALL SELECT doc_id, 'english' FROM documents WHERE lang = 'en'
    """
)
def named_tables(spark, folder):
    """A named table is replaced by the next one of its name; others stay."""
    path = work_folder(spark)
    docs = table(spark, folder, "documents")
    tb.write_named({"short": docs.where(F.col("n_chars") < 500), "english": docs}, path)
    tb.write_named({"english": docs.where(F.col("lang") == "en")}, path)
    named = {name: tb.read_named(spark, path, name).select("doc_id") for name in ("short", "english")}
    return bib.union_tagged(named, "name")


@query("SELECT doc_id, CAST(doc_id % 4 + 1 AS INTEGER) AS split FROM documents")
def bundle_files(spark, folder):
    """One folder per split of the documents."""
    path = work_folder(spark)
    docs = table(spark, folder, "documents").select("doc_id")
    tb.write_bundles(docs.withColumn("split", tb.split_name(F.col("doc_id") % 4 + 1)), path, "split")
    return spark.read.parquet(path).select("doc_id", F.col("split").cast("int").alias("split"))


@query(
    """
    SELECT doc_id FROM documents
    WHERE contains(lower(text), 'the') AND NOT contains(lower(lang), 'en')
    """
)
def strict_and_loose(spark, folder):
    docs = table(spark, folder, "documents")
    clause = p.all_of(p.strict_match("the", "text"), ~p.loose_match("EN", "lang"))
    return docs.where(clause.on(docs)).select("doc_id")


@query("SELECT conv_id, turn FROM conversations WHERE role <> 'assistant'")
def supported_boxes(spark, folder):
    """Boxes of types that carry text; the answers of an assistant play the figures."""
    kind = F.when(F.col("role") == "user", "Title").when(F.col("role") == "assistant", "Figure").otherwise("List")
    boxes = table(spark, folder, "conversations").select("conv_id", "turn", kind.alias("type"))
    return ly.supported_boxes(boxes).select("conv_id", "turn")

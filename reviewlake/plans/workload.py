"""Reviewer assignment and screening queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.operators import assign as asg
from reviewlake.operators import screening as sc
from reviewlake.plans.registry import query, table
from reviewlake.scale import work_folder
from reviewlake.streaming import patches as pt

_INDEXED = "(SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS j FROM documents)"


@query(
    f"""
    SELECT doc_id, j AS study_index, CAST((j * 3 + t) % 7 AS INTEGER) AS evaluator,
           0.0::DOUBLE AS rigor, 0.0::DOUBLE AS relevance
    FROM {_INDEXED}, range(3) r(t)
    """
)
def assign_n_by_k(spark, folder):
    studies = table(spark, folder, "documents").select("doc_id")
    return asg.assign_reviewers(studies, "doc_id", 7, 3, ["rigor", "relevance"])


@query(
    f"""
    SELECT CAST(e AS INTEGER) AS evaluator, count(j) AS "load"
    FROM range(11) r(e) LEFT JOIN (
      SELECT j, (j * 4 + t) % 11 AS e FROM {_INDEXED}, range(4) s(t)) USING (e) GROUP BY e
    """
)
def assign_loads(spark, folder):
    studies = table(spark, folder, "documents").select("doc_id")
    return asg.reviewer_loads(asg.assign_reviewers(studies, "doc_id", 11, 4), 11)


@query(
    """
    SELECT doc_id, CAST(ntile(6) OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS INTEGER) AS split_no
    FROM documents
    """
)
def split_ntile(spark, folder):
    records = table(spark, folder, "documents").select("doc_id")
    return asg.split_bundles(records, 6, "doc_id", digest=F.md5(F.col("doc_id").cast("string")))


# Events as a screening sheet: a row per event, the type as the decision cell.
_SHEET = """
    sheet AS (SELECT event_id, CASE WHEN value < 1 THEN ' ' ELSE props END AS title,
      CASE WHEN value < 1 THEN NULL WHEN event_type = 'click' THEN 'include'
           WHEN event_type = 'view' THEN ' Exclude ' WHEN event_type = 'error' THEN ''
           WHEN event_type = 'signup' AND value > 60 THEN 'maybe' END AS decision FROM events)
"""


def _sheet(spark, folder):
    value, kind = F.col("value"), F.col("event_type")
    return table(spark, folder, "events").select(
        "event_id",
        F.when(value < 1, " ").otherwise(F.col("props")).alias("title"),
        F.when(value < 1, None)
        .when(kind == "click", "include")
        .when(kind == "view", " Exclude ")
        .when(kind == "error", "")
        .when((kind == "signup") & (value > 60), "maybe")
        .alias("decision"),
    )


@query(
    f"""
    WITH {_SHEET}
    SELECT 'blank_record_row' AS code, event_id AS row, CAST(NULL AS VARCHAR) AS "column",
           CAST(NULL AS VARCHAR) AS value
    FROM sheet WHERE trim(title) = '' AND coalesce(trim(decision), '') = '' AND event_id <
      (SELECT max(event_id) FROM sheet WHERE trim(title) <> '' OR trim(decision) <> '')
    UNION ALL
    SELECT 'invalid_decision', event_id, 'decision', decision FROM sheet
    WHERE coalesce(lower(trim(decision)), '') NOT IN ('', 'include', 'exclude')
    """
)
def screen_validate(spark, folder):
    return sc.record_violations(_sheet(spark, folder), "event_id", "decision")


# Events as decision patches on customers; the customer key is the record.
_PATCHES = """
    patches AS (SELECT event_id AS seq, user_id AS record_index, ts,
      CASE event_type WHEN 'click' THEN 'included' WHEN 'error' THEN 'undecided'
           WHEN 'signup' THEN 'later' ELSE 'excluded' END AS decision,
      CASE WHEN event_type = 'view' THEN [' Off Topic', 'k' || json_extract_string(props, '$.k'), 'off topic ', ' ']
           ELSE [] END AS reasons FROM events),
    good AS (SELECT * FROM patches WHERE decision IN ('included', 'undecided', 'excluded')
             AND NOT (decision = 'excluded' AND len(reasons) = 0)),
    latest AS (SELECT * FROM (SELECT *, row_number() OVER (
                 PARTITION BY record_index ORDER BY ts DESC, seq DESC) AS rn FROM good) WHERE rn = 1)
"""
_CUSTOMERS = "customer WHERE c_mktsegment <> 'MACHINERY'"


def patches_of(events):
    kind = F.col("event_type")
    key = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    reasons = F.array(F.lit(" Off Topic"), key, F.lit("off topic "), F.lit(" "))
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("record_index"),
        "ts",
        F.when(kind == "click", "included")
        .when(kind == "error", "undecided")
        .when(kind == "signup", "later")
        .otherwise("excluded")
        .alias("decision"),
        F.when(kind == "view", reasons)
        .otherwise(F.array().cast("array<string>"))
        .alias("exclusion_reasons"),
    )


def base_of(spark, folder):
    return _records(table(spark, folder, "customer"))


def part_of_base(spark, folder):
    """The records without a fifth of the customers, whose patches are then unknown."""
    return _records(table(spark, folder, "customer").where(F.col("c_mktsegment") != "MACHINERY"))


def _records(customers):
    return customers.select(
        F.col("c_custkey").alias("record_index"),
        F.when(F.col("c_acctbal") > 9000, "include").alias("include"),
        F.lit(None).cast("string").alias("exclude_reasons"),
    )


_PATCHED = f"""
    WITH {_PATCHES}
    SELECT c_custkey AS record_index,
      CASE WHEN decision IS NULL THEN CASE WHEN c_acctbal > 9000 THEN 'include' END
           WHEN decision = 'included' THEN 'include' WHEN decision = 'excluded' THEN 'exclude' ELSE '' END
        AS include,
      CASE WHEN decision IS NULL THEN NULL
           WHEN decision = 'excluded' THEN 'off topic;' || trim(reasons[2]) ELSE '' END AS exclude_reasons
    FROM customer LEFT JOIN latest ON record_index = c_custkey
"""


@query(_PATCHED)
def screen_patch(spark, folder):
    patches = patches_of(table(spark, folder, "events"))
    return sc.apply_patches(base_of(spark, folder), patches)


@query(_PATCHED)
def screen_patch_stream(spark, folder):
    """The same decisions, read as a stream and reduced batch by batch."""
    schema = table(spark, folder, "events").schema
    # A stream reads folders or patterns, not single files.
    events = spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet")
    out = work_folder(spark)
    run = pt.stream_patches(patches_of(events), out, f"{out}/state")
    run.awaitTermination()
    return pt.apply_stored(base_of(spark, folder), spark.read.parquet(f"{out}/accepted"))


@query(
    f"""
    WITH {_PATCHES}
    SELECT code, count(*) AS n, min(seq) AS first_seq FROM (
      SELECT seq, CASE WHEN decision NOT IN ('included', 'undecided', 'excluded') THEN 'invalid_decision'
        WHEN decision = 'excluded' AND len(reasons) = 0 THEN 'missing_reason'
        WHEN record_index NOT IN (SELECT c_custkey FROM {_CUSTOMERS}) THEN 'unknown_record' END AS code
      FROM patches) WHERE code IS NOT NULL GROUP BY code
    """
)
def screen_rejects(spark, folder):
    patches = patches_of(table(spark, folder, "events"))
    refused = sc.rejected_patches(patches, part_of_base(spark, folder))
    return refused.groupBy("code").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query(
    f"""
    WITH {_PATCHES}
    SELECT seq, record_index, code FROM (
      SELECT seq, record_index, CASE WHEN decision NOT IN ('included', 'undecided', 'excluded') THEN 'invalid_decision'
        WHEN decision = 'excluded' AND len(reasons) = 0 THEN 'missing_reason'
        WHEN record_index NOT IN (SELECT c_custkey FROM {_CUSTOMERS}) THEN 'unknown_record' END AS code
      FROM patches) WHERE code IS NOT NULL
    """
)
def screen_rejects_stream(spark, folder):
    """Every refused patch of the stream, those on absent customers among them."""
    schema = table(spark, folder, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet")
    out = work_folder(spark)
    known = part_of_base(spark, folder).select("record_index")
    pt.stream_patches(patches_of(events), out, f"{out}/state", known=known).awaitTermination()
    return spark.read.parquet(f"{out}/refused").select("seq", "record_index", "code")


_SCREENED = """
    (SELECT doc_id, lang, CASE quality WHEN 1 THEN 'include' WHEN 0 THEN ' ' END AS decision
     FROM documents LEFT JOIN labels USING (doc_id))
"""


def _screened(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    verdict = F.when(F.col("quality") == 1, "include").when(F.col("quality") == 0, " ")
    return docs.join(table(spark, folder, "labels"), "doc_id", "left").select(
        "doc_id", "lang", verdict.alias("decision")
    )


@query(
    f"""
    SELECT lang, count(*) AS record_count,
           count(*) FILTER (WHERE coalesce(trim(decision), '') = '') AS unfilled_record_count,
           count(*) FILTER (WHERE coalesce(trim(decision), '') = '') = 0 AS complete
    FROM {_SCREENED} GROUP BY lang
    """
)
def screen_progress(spark, folder):
    return sc.progress(_screened(spark, folder), "decision", "lang")


@query(
    f"""
    WITH s AS (SELECT doc_id, CASE WHEN coalesce(trim(decision), '') = '' THEN doc_id END AS open
               FROM {_SCREENED})
    SELECT doc_id, CASE WHEN doc_id > 0 THEN doc_id - 1 END AS previous_index,
           CASE WHEN doc_id + 1 < (SELECT count(*) FROM s) THEN doc_id + 1 END AS next_index,
           min(open) OVER () AS first_undecided_index,
           min(open) OVER (ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
             AS next_undecided_index,
           min(open) OVER () IS NULL AS complete
    FROM s
    """
)
def screen_navigate(spark, folder):
    return sc.navigation(_screened(spark, folder), "doc_id", "decision").drop("lang", "decision")


_EVIDENCE = """
    e AS (SELECT p_partkey, p_name, p_brand, p_type, p_size,
      CASE p_size % 4 WHEN 0 THEN ' Include' WHEN 1 THEN 'exclude' WHEN 2 THEN '' END AS verdict,
      CASE p_size % 3 WHEN 0 THEN 'not ' || lower(p_type) || ', too small; ' WHEN 1 THEN ' ' END AS why,
      CASE p_size % 2 WHEN 0 THEN 'yes' ELSE 'off' END AS pdf FROM part)
"""


def _evidence(spark, folder):
    size = F.col("p_size")
    raw = table(spark, folder, "part").select(
        "p_partkey",
        F.col("p_name").alias("title"),
        F.concat("p_brand", F.lit("; "), "p_type", F.lit(";")).alias("people"),
        F.concat(F.lit("10.1/"), "p_partkey").alias("doi"),
        F.lit("nan").alias("abstract"),
        F.replace("p_name", F.lit(" "), F.lit("; ")).alias("keywords"),
        (size + 1970).alias("publication_date"),
        F.when(size % 2 == 0, "yes").otherwise("off").alias("has_pdf"),
        F.when(size % 4 == 0, " Include").when(size % 4 == 1, "exclude").when(size % 4 == 2, "").alias("include"),
        F.when(size % 3 == 0, F.concat(F.lit("not "), F.lower("p_type"), F.lit(", too small; ")))
        .when(size % 3 == 1, " ")
        .alias("exclude_reason"),
    )
    return sc.screening_records(raw, "p_partkey", mappings={"authors": "people"})


@query(
    f"""
    WITH {_EVIDENCE}
    SELECT p_partkey AS record_index,
      CASE lower(trim(coalesce(verdict, ''))) WHEN 'include' THEN 'included' WHEN 'exclude' THEN 'excluded'
           ELSE 'undecided' END AS decision,
      CASE WHEN p_size % 3 = 0 THEN trim(split_part(why, ';', 1)) ELSE '' END AS reasons,
      (lower(trim(coalesce(verdict, ''))) = 'include' OR p_size % 3 <> 0) AS include,
      p_name AS title, p_brand || '|' || p_type AS authors, replace(p_name, ' ', '|') AS keywords,
      (1970 + p_size) || '-01-01' AS published, pdf = 'yes' AS has_pdf,
      CAST(NULL AS VARCHAR) AS abstract, '10.1/' || p_partkey AS doi
    FROM e
    """
)
def screening_evidence(spark, folder):
    return _evidence(spark, folder).select(
        "record_index",
        "decision",
        F.array_join("exclude_reasons", ";").alias("reasons"),
        "include",
        "title",
        F.array_join("authors", "|").alias("authors"),
        F.array_join("keywords", "|").alias("keywords"),
        F.date_format("publication_date", "yyyy-MM-dd").alias("published"),
        "has_pdf",
        "abstract",
        "doi",
    )


@query(
    f"""
    WITH {_EVIDENCE}
    SELECT p_partkey AS record_index,
      CASE WHEN p_size % 3 = 0 THEN 'not ' || lower(p_type) || '|too small' ELSE '' END AS reasons,
      p_size % 3 <> 0 AS include, (1970 + p_size) || '-01-01' AS published_at,
      '<not specified>' AS publication_venue, 'https://dx.doi.org/10.1/' || p_partkey AS doi_link,
      CASE WHEN p_size % 3 <> 0 THEN 'include' ELSE 'exclude' END AS selection_status
    FROM e
    """
)
def screening_response(spark, folder):
    return sc.evidence_response(_evidence(spark, folder)).select(
        "record_index",
        F.array_join("exclude_reasons", "|").alias("reasons"),
        "include",
        "published_at",
        "publication_venue",
        "doi_link",
        "selection_status",
    )

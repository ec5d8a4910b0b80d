"""URL filters: a temporal join of captures with a dated list.

List entries say from which day a key (a domain, a host or a host with its first
folder) is blocked, allowed or no longer listed. Entries of one key become
validity intervals; a capture is judged by the entries that were active on the
day it was fetched, the most specific key first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.llm.registry import query, table
from reviewlake.scale import lookup

# Most specific first.
KINDS = ("path", "host", "domain")
ACTIONS = ("allow", "block", "remove")
# Labels that, before a country's two letters, are part of a public suffix: names are
# registered below them.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "gv", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or",
                "org", "plc", "sch")


def host_of(url: Column) -> Column:
    """The lower-case host of a URL without user, port and final dot; null without one.

    An address in brackets keeps them.
    """
    host = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)"
    host = F.lower(F.regexp_extract(url, host, 1))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def domain_of(host: Column, second_level: tuple[str, ...] = SECOND_LEVEL) -> Column:
    """The registered domain: a public suffix and the label before it.

    A suffix is the last label, or the last two if they are one of ``second_level``
    and a country's two letters. Addresses are kept whole; a host that is a suffix
    itself is its own domain.
    """
    suffix = "|".join(second_level)
    name = F.regexp_extract(host, rf"(?:[^.]+\.)?(?:(?:{suffix})\.[a-z][a-z]|[^.]+)$", 0)
    return F.when(host.rlike(r"^\[|^[0-9]+(\.[0-9]+){3}$"), host).otherwise(name)


def folder_of(url: Column) -> Column:
    """The first folder of the path, without slashes; null if the path has none."""
    folder = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)/", 1)
    return F.when(folder != "", folder)


def url_keys(url: Column) -> Column:
    """The keys of a URL, one of each kind that it has."""
    host, folder = host_of(url), folder_of(url)
    named = [
        F.concat(F.lit("path:"), host, F.lit("/"), folder),
        F.concat(F.lit("host:"), host),
        F.concat(F.lit("domain:"), domain_of(host)),
    ]
    return F.array_compact(
        F.array(*[F.when(k.isNotNull(), F.struct(k.alias("key"), F.lit(i).alias("kind"))) for i, k in enumerate(named)])
    )


def intervals(entries: DataFrame) -> DataFrame:
    """``key, action, valid_from, valid_to``: each entry until the next one of its key.

    ``entries (key, action, day)``. Of entries with the same key and day the
    last action by name counts, repeated ones count once; ``valid_to`` is the
    first day it is no longer in force, null if it still is. Entries with a
    null key, action or day are left out, and so are stretches without listing.
    """
    whole = entries.where(F.col("key").isNotNull() & F.col("action").isNotNull() & F.col("day").isNotNull())
    daily = whole.groupBy("key", "day").agg(F.max("action").alias("action"))
    later = F.lead("day").over(Window.partitionBy("key").orderBy("day"))
    dated = daily.select("key", "action", F.col("day").alias("valid_from"), later.alias("valid_to"))
    return dated.where(F.col("action") != "remove")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``page_id, fetched, verdict, matched, listed``: the entry that decides, per capture.

    ``captures (page_id, url, fetched)``. The verdict is ``blocked`` or
    ``allowed`` by the most specific key with an entry active on that day,
    ``unlisted`` without one or without a host or day. One row per capture row:
    repeated ones are counted and come out as often; an empty list leaves all
    unlisted, and further columns of either table are not read.
    """
    exploded = captures.select(
        "page_id", "url", "fetched", F.inline_outer(url_keys(F.col("url")))
    )
    # Keys of one capture day are judged once, however many captures share them.
    known = F.col("key").isNotNull() & F.col("fetched").isNotNull()
    asked = exploded.where(known).groupBy("key", "fetched").agg(F.count("*").alias("rows"))
    span = intervals(entries)
    active = (F.col("fetched") >= F.col("valid_from")) & (
        F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))
    )
    judged = asked.join(span, "key").where(active).select("key", "fetched", "rows", "action", "valid_from")
    # One host may hold a third of the captures.
    found = lookup(exploded, judged, ["key", "fetched"], "rows", "page_id")
    hit = F.when(F.col("action").isNotNull(), F.struct("kind", "key", "action", "valid_from"))
    urls = found.groupBy("page_id", "url", "fetched").agg(
        F.min(hit).alias("hit"),
        # Repeated captures: every row brings each of its keys once.
        (F.count("*") / F.greatest(F.countDistinct("key"), F.lit(1))).cast("int").alias("copies"),
    )
    verdict = F.when(F.col("hit.action") == "block", "blocked").when(F.col("hit.action") == "allow", "allowed")
    return urls.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(
        "page_id",
        "fetched",
        F.coalesce(verdict, F.lit("unlisted")).alias("verdict"),
        F.col("hit.key").alias("matched"),
        F.col("hit.valid_from").alias("listed"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a day of fetching that follows from their id, within two years."""
    day = F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.col("page_id") * 7, F.lit(730)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched"))


def list_of(pages: DataFrame) -> DataFrame:
    """A dated list over the keys of the pages: three entries for two of five keys."""
    keys = pages.select(F.inline(url_keys(F.col("url")))).select("key").distinct()
    code = F.conv(F.substring(F.md5("key"), 1, 7), 16, 10).cast("long")
    listed = keys.withColumn("code", code).where(F.pmod("code", F.lit(5)) < 2)
    number = F.explode(F.sequence(F.lit(0), F.lit(2)))
    return listed.select("key", "code", number.alias("k")).select(
        "key",
        F.element_at(
            F.array(*[F.lit(a) for a in ACTIONS]), (1 + F.pmod(F.col("code") + 2 * F.col("k") + 1, F.lit(3))).cast("int")
        ).alias("action"),
        F.date_add(
            F.lit("2022-11-01").cast("date"), F.pmod(F.col("code") * (F.col("k") + 1), F.lit(790)).cast("int")
        ).alias("day"),
    )


@query(
    r"""
    WITH urls AS (
        SELECT page_id, url, DATE '2023-01-01' + (((page_id * 7) % 730 + 730) % 730)::INT AS fetched,
               nullif(regexp_replace(lower(regexp_extract(url,
                   '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)', 1)), '\.+$', ''), '') AS host,
               nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)/', 1), '') AS folder
        FROM pages
    ), keyed AS (
        SELECT page_id, fetched, 0 AS kind, 'path:' || host || '/' || folder AS key FROM urls
        UNION ALL SELECT page_id, fetched, 1, 'host:' || host FROM urls
        UNION ALL SELECT page_id, fetched, 2, 'domain:' || CASE
            WHEN regexp_matches(host, '^\[|^[0-9]+(\.[0-9]+){3}$') THEN host
            ELSE regexp_extract(host, '([^.]+\.)?((SECOND_LEVEL)\.[a-z][a-z]|[^.]+)$') END FROM urls
    ), coded AS (
        SELECT key, ('0x' || substr(md5(key), 1, 7))::BIGINT AS code
        FROM (SELECT DISTINCT key FROM keyed WHERE key IS NOT NULL)
    ), entries AS (
        SELECT key, max(['allow', 'block', 'remove'][1 + ((code + 2 * k + 1) % 3)::INT]) AS action,
               DATE '2022-11-01' + ((code * (k + 1)) % 790)::INT AS day
        FROM coded, range(3) AS t(k) WHERE code % 5 < 2 GROUP BY key, day
    ), spans AS (
        SELECT key, action, day, lead(day) OVER (PARTITION BY key ORDER BY day) AS until FROM entries
    ), hits AS (
        SELECT page_id, min_by({'key': keyed.key, 'action': action, 'day': day}, kind) AS hit
        FROM keyed JOIN spans ON keyed.key = spans.key AND fetched >= day AND (until IS NULL OR fetched < until)
        WHERE action <> 'remove' GROUP BY page_id
    )
    SELECT page_id, fetched,
           CASE hit.action WHEN 'block' THEN 'blocked' WHEN 'allow' THEN 'allowed' ELSE 'unlisted' END AS verdict,
           hit.key AS matched, hit.day AS listed
    FROM urls LEFT JOIN hits USING (page_id)
    """.replace("SECOND_LEVEL", "|".join(SECOND_LEVEL))
)
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return filter_urls(captures_of(pages), list_of(pages))

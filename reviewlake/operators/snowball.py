"""Citation snowballing: depth-bounded breadth-first search with exclusions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import doi_url, normalize_doi
from reviewlake.scale import (
    cut_lineage,
    heavy_keys,
    joined_items,
    members,
    ordered_items,
    range_index,
)

# Columns of a discovered paper and the citation lists to follow.
DETAIL_COLUMNS = (
    "doi",
    "title",
    "authors",
    "abstract",
    "source",
    "url",
    "year",
    "has_pdf",
    "pdf_url",
)
RELATIONS = {"backward": "references", "forward": "citations"}
LINKED_IDS = "referencing_paper_ids"
LINK_COUNT = "linking_papers"
BATCH_SIZE = 500
# Up to so many ids are looked up without a shuffle of the links.
FEW_IDS = 1 << 18


def read_ids(df: DataFrame, id_column: str = "doi") -> DataFrame:
    """Distinct normalised ids of one column; blanks are dropped."""
    if id_column not in df.columns:
        raise ValueError(f"column {id_column!r} was not found")
    ids = df.select(normalize_doi(id_column).alias("doi"))
    return ids.where(F.col("doi").isNotNull()).distinct()


def citation_edges(papers: DataFrame, direction: str = "backward") -> DataFrame:
    """Distinct ``(src, dst)`` pairs from the citation list of each paper."""
    edges = papers.select(
        normalize_doi("doi").alias("src"),
        F.explode(F.col(RELATIONS[direction])).alias("dst"),
    ).select("src", normalize_doi("dst").alias("dst"))
    return edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()


@dataclass(frozen=True)
class Discovery:
    """What a snowball run found: ids with their level, and the links to them."""

    found: DataFrame  # (doi, level)
    links: DataFrame  # (src, dst), distinct


def _among(
    links: DataFrame, ids: DataFrame, key: str, heavy: DataFrame, spread: str, inside: bool = True
) -> DataFrame:
    """:func:`members`, by broadcast where the ids are a bounded number of rows."""
    if ids.limit(FEW_IDS + 1).count() > FEW_IDS:
        return members(links, ids, key, heavy, spread, inside)
    return links.join(F.broadcast(ids.select(key)), key, "left_semi" if inside else "left_anti").select(*links.columns)


def snowball(
    papers: DataFrame,
    edges: DataFrame,
    seeds: DataFrame,
    excluded: DataFrame | None = None,
    depth: int = 1,
) -> Discovery:
    """Follow ``edges (src, dst)`` from the seeds for ``depth`` levels.

    Only the papers found last are expanded, each once, so the links of the
    levels never overlap. Links to papers known before are kept; ids without a
    paper row count as visited and are not reported.
    """
    known = papers.select(normalize_doi("doi").alias("doi")).distinct()
    banned = (excluded if excluded is not None else seeds.limit(0)).select("doi").distinct()
    visited = seeds.select("doi").unionByName(banned).distinct()
    frontier = seeds.select("doi").distinct().join(known, "doi", "left_semi")
    sources, targets = heavy_keys(edges, "src"), heavy_keys(edges, "dst")
    citing = cut_lineage(edges.select("src").distinct())
    found, links = None, None
    for level in range(1, depth + 1):
        # Ids without a link of their own lead nowhere.
        ids = cut_lineage(citing.join(frontier.select(F.col("doi").alias("src")), "src", "left_semi"))
        # Excluded papers count as visited, so links to them lead nowhere.
        step = _among(edges, ids, "src", sources, "dst")
        step = cut_lineage(
            _among(step, banned.withColumnRenamed("doi", "dst"), "dst", targets, "src", inside=False)
        )
        kept = step
        if level == 1:
            # Later frontiers hold no excluded paper.
            kept = _among(
                step, banned.withColumnRenamed("doi", "src"), "src", sources, "dst", inside=False
            )
        links = kept if links is None else links.unionByName(kept)
        fresh = cut_lineage(
            step.select(F.col("dst").alias("doi")).distinct().join(visited, "doi", "left_anti")
        )
        visited = visited.unionByName(fresh)
        frontier = fresh.join(known, "doi", "left_semi")
        reached = frontier.withColumn("level", F.lit(level))
        found = reached if found is None else found.unionByName(reached)
        if fresh.isEmpty():
            break
    return Discovery(found, links)


def linked_ids(result: Discovery) -> DataFrame:
    """``(doi, ord, item)``: the linking ids of each paper, sorted, one row each."""
    found = result.found.select(F.col("doi").alias("dst"))
    links = members(result.links, found, "dst", heavy_keys(result.links, "dst"), "src")
    placed = ordered_items(links.select("dst", "src"), ["dst"], ["src"])
    return placed.select(F.col("dst").alias("doi"), "ord", F.col("src").alias("item"))


def snowball_records(papers: DataFrame, result: Discovery, count_column: str = LINK_COUNT) -> DataFrame:
    """Result table in DOI order: index, details, number of links, empty decision.

    One row per paper. The linking ids themselves are a table of their own,
    :func:`linked_ids`, since a paper may have any number of them.
    """
    if count_column in DETAIL_COLUMNS:
        raise ValueError(f"linked ids column {count_column!r} conflicts with an output column")
    details = papers.withColumn("doi", normalize_doi("doi")).join(
        result.found.select("doi"), "doi", "left_semi"
    )
    absent = {c: F.lit(None).cast("string") for c in DETAIL_COLUMNS if c not in details.columns}
    details = details.withColumns(absent).select(*DETAIL_COLUMNS)
    if dict(details.dtypes)["authors"].startswith("array"):
        details = details.withColumn("authors", F.array_join("authors", ";"))
    details = details.withColumns(
        {"authors": F.coalesce("authors", F.lit("")), "url": doi_url("doi")}
    )
    ids = range_index(details.select("doi"), ["doi"], "cluster_id")
    counts = result.links.groupBy(F.col("dst").alias("doi")).agg(F.count("*").alias(count_column))
    return (
        ids.join(details, "doi")
        .join(counts, "doi", "left")
        .select(
            "cluster_id",
            *DETAIL_COLUMNS,
            F.coalesce(count_column, F.lit(0)).alias(count_column),
            F.lit(None).cast("string").alias("include"),
        )
    )


def snowball_table(papers: DataFrame, result: Discovery, linked_ids_column: str = LINKED_IDS) -> DataFrame:
    """The result table with the linking ids ``;``-joined, where they fit one value."""
    if linked_ids_column in DETAIL_COLUMNS:
        raise ValueError(f"linked ids column {linked_ids_column!r} conflicts with an output column")
    lists = joined_items(linked_ids(result), ["doi"], ";", linked_ids_column)
    return (
        snowball_records(papers, result)
        .join(lists, "doi", "left")
        .select(
            "cluster_id",
            *DETAIL_COLUMNS,
            F.coalesce(linked_ids_column, F.lit("")).alias(linked_ids_column),
            "include",
        )
    )


def id_batches(ids: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """``(doi, batch)``: sorted ids in batches of a fixed size, for outside calls."""
    placed = range_index(ids.select("doi").distinct(), ["doi"], "place")
    return placed.select("doi", F.floor(F.col("place") / size).alias("batch"))


def missing_inputs(papers: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seed ids that have no paper row."""
    known = papers.select(normalize_doi("doi").alias("doi"))
    return seeds.select("doi").distinct().join(known, "doi", "left_anti")

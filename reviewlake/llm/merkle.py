"""A Merkle manifest of a dataset, by lag and lead windows.

Rows are leaves; every three consecutive nodes of a group have a parent, the
digest of theirs, until one node remains. The rows of a group are numbered and
placed in blocks of ``3**STEPS`` leaves, so no run of three crosses a block of
any of its levels and a group of any size is spread over many tasks. In a block
the node of a level stands in the row of its first leaf: on level ``l`` its
siblings are ``lag`` and ``lead`` columns at the fixed offsets ``3**l`` and
``2 * 3**l``, masked by the node's slot in its run and the length of that run,
and the rows of first children hash the parent. A running window gives each
leaf the siblings of its ancestors. The blocks' top nodes are the leaves of the
next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.llm.registry import query, table
from reviewlake.scale import cut_lineage, lookup, ordered_items, range_index

ARITY = 3
# Levels of a block: 2 187 leaves.
STEPS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SIDES = "array<struct<before:string,after:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(values: list[Column]) -> Column:
    """The digest of a row: each value with its length, so no two rows read the same."""
    parts = []
    for value in values:
        told = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told), F.lit("-")))
    return digest(F.concat(*parts))


def _block_levels(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``block``, the block's ``top`` and the ``path`` inside it.

    ``path`` holds, from the node up, the digests before and after its
    ancestors in their runs.
    """
    own = [c for c in nodes.columns if c not in ("grp", "idx", "n", "digest")]
    size = ARITY**STEPS
    block = F.floor(F.col("idx") / size).cast("long")
    rows = nodes.withColumn("block", block).withColumnRenamed("digest", "d0")
    here = Window.partitionBy("grp", "block").orderBy("idx")
    none = F.lit("")
    for level in range(STEPS):
        stride = ARITY**level
        d, place = F.col(f"d{level}"), F.floor(F.col("idx") / stride)
        # Nodes of the group on this level; a single one is the group's root.
        count = F.ceil(F.col("n") / stride)
        first = F.col("idx") % stride == 0
        slot = place % ARITY
        run = F.least(F.lit(ARITY), count - (place - slot))
        shared = first & (count > 1)
        rows = rows.withColumns(
            {f"lag{k}": F.lag(d, k * stride).over(here) for k in (1, 2)}
            | {f"lead{k}": F.lead(d, k * stride).over(here) for k in (1, 2)}
        )
        before = F.concat(
            F.when(slot >= 2, F.col("lag2")).otherwise(none), F.when(slot >= 1, F.col("lag1")).otherwise(none)
        )
        after = F.concat(
            F.when(slot + 1 < run, F.col("lead1")).otherwise(none),
            F.when(slot + 2 < run, F.col("lead2")).otherwise(none),
        )
        rows = rows.withColumn(f"s{level}", F.when(shared, F.struct(before.alias("before"), after.alias("after"))))
        parent = F.when(shared, digest(F.concat(d, F.col(f"s{level}.after")))).otherwise(d)
        opens = F.col("idx") % (stride * ARITY) == 0
        rows = rows.withColumn(f"d{level + 1}", F.when(opens, parent)).drop("lag1", "lag2", "lead1", "lead2")
    sofar = here.rowsBetween(Window.unboundedPreceding, 0)
    whole = here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = []
    for level in range(STEPS):
        # The last first row at or before a leaf is that of its ancestor.
        opens = F.col("idx") % ARITY**level == 0
        steps.append(F.last(F.when(opens, F.struct(F.col(f"s{level}").alias("s"))), ignorenulls=True).over(sofar)["s"])
    return rows.select(
        "grp",
        "idx",
        "n",
        "block",
        F.col("d0").alias("digest"),
        F.first(f"d{STEPS}").over(whole).alias("top"),
        F.array_compact(F.array(*steps)).alias("path"),
        *own,
    )


def trees(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with their ``block`` and the ``path`` in it, and ``(grp, block, root, up)``.

    ``nodes`` has ``grp, idx, n, digest`` and columns of its own, which stay:
    ``idx`` numbers the ``n`` leaves of a group from 0. A leaf's siblings, from
    the leaf up to below the root, are its ``path`` and the ``up`` of its block.
    Only the second table, a row a block, is kept; the paths of leaves are many
    times as long as these and are worked out where they are read. A group of
    one leaf is its own root.
    """
    size = ARITY**STEPS
    placed = _block_levels(nodes)
    tops = cut_lineage(
        placed.where(F.col("idx") % size == 0).select(
            "grp",
            F.col("block").alias("idx"),
            F.ceil(F.col("n") / size).cast("long").alias("n"),
            F.col("top").alias("digest"),
        )
    )
    if tops.where("n > 1").isEmpty():
        above = F.array().cast(_SIDES).alias("up")
        return placed, tops.select("grp", F.col("idx").alias("block"), F.col("digest").alias("root"), above)
    return placed, cut_lineage(with_root(*trees(tops)).select("grp", F.col("idx").alias("block"), "root", F.col("path").alias("up")))


def with_root(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """The leaves of :func:`trees` with the columns of their block and the whole ``path``."""
    # A block has at most 3**STEPS rows, so no key of this join is hot; leaves are dealt by it already.
    joined = placed.join(blocks, ["grp", "block"])
    return joined.withColumn("path", F.concat("path", "up").cast(_SIDES)).drop("up")


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda d, s: digest(F.concat(s["before"], d, s["after"])))


def manifest(rows: DataFrame) -> DataFrame:
    """``(id, leaf, subroot, root, path)`` and all other columns of ``rows``.

    ``rows`` has ``id`` (leaves ascend by it, null first; equal ids by their
    digest), ``source`` and ``leaf``. A source, null ones together, is a tree
    of its own; the subroots, ordered by source (null first, bytewise), are the
    leaves of the last tree. Equal rows are leaves of their own; an empty table
    gives no rows.
    """
    extra = [c for c in rows.columns if c not in ("id", "source", "leaf")]
    # A null source sorts before all others and is equal to itself.
    grp = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    known = rows.select("id", "leaf", *extra, grp.alias("grp"), F.monotonically_increasing_id().alias("tie"))
    order = ["grp", "id", "leaf", "tie"]
    kept = F.struct("id", *extra).alias("kept")
    placed = range_index(known.select(*order, kept), order, "place").drop("id", "tie")
    sizes = placed.groupBy("grp").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    found = lookup(placed, sizes.withColumn("n", F.col("rows")), ["grp"], "rows", "place", how="inner")
    idx = (F.col("place") - F.col("first")).alias("idx")
    leaves, blocks = trees(cut_lineage(found.select("grp", idx, "n", F.col("leaf").alias("digest"), "kept")))
    blocks = blocks.withColumnRenamed("root", "subroot")
    subroots = blocks.where("block = 0").select(F.lit("").alias("all"), "grp", F.col("subroot").alias("digest"))
    ranked = ordered_items(subroots, ["all"], ["grp"], "idx").drop("n", "_n")
    number = ranked.groupBy("all").agg(F.count("*").alias("rows")).withColumn("n", F.col("rows"))
    ranked = cut_lineage(lookup(ranked, number, ["all"], "rows", "idx"))
    top = with_root(*trees(ranked.select(F.col("all").alias("grp"), "idx", "n", "digest", F.col("grp").alias("own"))))
    counts = blocks.groupBy("grp").agg(F.count("*").alias("blocks"))
    ends = counts.join(top.select(F.col("own").alias("grp"), "root", F.col("path").alias("above")), "grp")
    blocks = lookup(blocks, ends, ["grp"], "blocks", "block", how="inner")
    blocks = cut_lineage(blocks.withColumn("up", F.concat("up", "above")).drop("above"))
    whole = with_root(leaves, blocks)
    return whole.select("kept.id", F.col("digest").alias("leaf"), *[F.col("kept")[c].alias(c) for c in extra], "subroot", "root", "path")


def verify(leaves: DataFrame, seen: str) -> DataFrame:
    """Add ``folded_root`` and ``verified`` of the leaf digests in column ``seen``."""
    folded = leaves.withColumn("folded_root", fold(F.col(seen), F.col("path")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """``id, source, leaf`` of documents, and ``seen``: the leaf after tampering.

    Tampering deletes the line feeds of the texts whose id has an even CRC-32.
    Null values have a mark of their own; extra columns are no part of a leaf.
    """
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1
    cleaned = F.when(F.coalesce(odd, F.lit(True)), F.col("text")).otherwise(F.replace("text", F.lit("\n"), F.lit("")))
    values = [F.col(c) for c in FIELDS]
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("source").cast("string").alias("source"),
        leaf(values).alias("leaf"),
        leaf([*values[:-1], cleaned]).alias("seen"),
    )


def _levels_sql(kind: str, key: str, count: int) -> str:
    """Levels 0 … count of trees as tables ``kind0`` …, each with siblings of its nodes."""
    parts = []
    for i in range(count):
        parts.append(f"""
    {kind}{i}s AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS m,
        coalesce(string_agg(d, '') OVER (PARTITION BY {key}, idx // 3 ORDER BY idx
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
        coalesce(string_agg(d, '') OVER (PARTITION BY {key}, idx // 3 ORDER BY idx
          ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {kind}{i}),
    {kind}{i + 1} AS (SELECT {key}, idx // 3 AS idx,
        CASE WHEN any_value(m) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY idx)) END AS d
      FROM {kind}{i}s GROUP BY {key}, idx // 3)""")
    return ",".join(parts)


# Levels that the SQL goes through; trees with fewer end earlier.
_DEEP, _TOP = 12, 6
# CRC-32 of the decimal digits ``i``, bit by bit; a byte is eight numbers, seven of them zero.
_CRC = """list_reduce(list_transform(list_concat([4294967295], flatten(list_transform(range(length(i)),
        lambda k: [ord(i[k + 1]), 0, 0, 0, 0, 0, 0, 0]))), lambda y: y::BIGINT),
      lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)))"""


def _enc(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"


_HEAD = " || ".join(_enc(c) for c in FIELDS[:-1])
_SQL = f"""
    WITH texts AS (SELECT *, CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END AS seen_text FROM (
        SELECT *, (xor({_CRC}, 4294967295) & 1) = 0 AS tampered
        FROM (SELECT *, doc_id::VARCHAR AS i FROM documents))),
    hashed AS (SELECT doc_id, source, sha256({_HEAD} || {_enc("text")}) AS leaf,
        sha256({_HEAD} || {_enc("seen_text")}) AS seen FROM texts),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM hashed),
    a0 AS (SELECT source, idx, leaf AS d FROM leaves), {_levels_sql("a", "source", _DEEP)},
    subroots AS (SELECT source, d AS subroot, row_number() OVER (
        ORDER BY source IS NOT NULL, encode(source)) - 1 AS sub FROM a{_DEEP}),
    b0 AS (SELECT 0 AS g, sub AS idx, subroot AS d FROM subroots), {_levels_sql("b", "g", _TOP)},
    f0 AS (SELECT leaves.*, sub, subroot, '' AS path, seen AS folded FROM leaves
        JOIN subroots ON leaves.source IS NOT DISTINCT FROM subroots.source){{folds}}
    SELECT doc_id, leaf, subroot, (SELECT d FROM b{_TOP}) AS root, sha256(path) AS proof_sha256,
        folded AS folded_root, folded = (SELECT d FROM b{_TOP}) AS verified FROM f{_DEEP + _TOP}
"""


def _folds_sql() -> str:
    parts = []
    for i in range(_DEEP + _TOP):
        low = i < _DEEP
        name, place = (f"a{i}s", f"f.idx // {3**i}") if low else (f"b{i - _DEEP}s", f"f.sub // {3 ** (i - _DEEP)}")
        same = "AND f.source IS NOT DISTINCT FROM s.source" if low else ""
        parts.append(f""",
    f{i + 1} AS (SELECT f.* EXCLUDE (path, folded),
        CASE WHEN m = 1 THEN path ELSE path || before || after END AS path,
        CASE WHEN m = 1 THEN folded ELSE sha256(before || folded || after) END AS folded
      FROM f{i} f JOIN {name} s ON s.idx = {place} {same})""")
    return "".join(parts)


@query(_SQL.replace("{folds}", _folds_sql()))
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    leaves = manifest(document_leaves(table(spark, folder, "documents")))
    return verify(leaves, "seen").select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        proof(F.col("path")).alias("proof_sha256"),
        "folded_root",
        "verified",
    )

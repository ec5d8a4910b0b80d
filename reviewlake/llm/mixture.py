"""Mixing sources to target weights by hierarchical budgeting.

Documents are leaves of a tree domain > language > source. The token budget
goes down the tree by weight. No child gets more than it can give, which is
its tokens times ``max_epochs``; what it cannot give goes to its siblings by
their weights, and only what all siblings together cannot give goes to the
siblings of an ancestor. A leaf's tokens are whole epochs first and then the
prefix of one more epoch in seeded random order.

Counts and cuts are integers, so the result does not depend on partitioning.
The rows of a leaf are never gathered: token sums per slice of the hash order
find the slice of the cut, and only its rows are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.llm.registry import query, table
from reviewlake.scale import cut_lineage

LEVELS = ("domain", "language", "source")
# The order of an epoch is cut in 2**SLICE_BITS slices per leaf.
SLICE_BITS = 16
MAX_EPOCHS, SEED = 4, 42
# Most leaves whose plans, a few numbers each, are broadcast; salts beyond it.
BROADCAST_LEAVES, SALTS = 50_000, 64
# The share of the corpus' tokens the mixture has.
BUDGET_SHARE = 0.5


def tokens(text: Column) -> Column:
    """Number of words between white space; 0 for a null or empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source: its number modulo four, or ``other`` without one."""
    number = F.regexp_extract(source, r"(\d+)$", 1)
    return F.when(F.coalesce(number, F.lit("")) == "", "other").otherwise(
        F.concat(F.lit("domain"), F.pmod(F.crc32(number.cast("binary")), F.lit(4)).cast("string"))
    )


def leaf_columns() -> dict[str, Column]:
    """Domain, language and source of a document; null names the branch ``unknown``."""
    return {
        "domain": domain_of(F.col("source")),
        "language": F.coalesce("lang", F.lit("unknown")),
        "source": F.coalesce("source", F.lit("unknown")),
    }


def default_weight(level: str) -> Column:
    """Relative weights for every possible name: fixed by a rule, from 1 to 4."""
    if level == "language":
        return F.when(F.col("language") == "en", 4).when(F.col("language") == "unknown", 1).otherwise(2).cast("long")
    return (1 + F.pmod(F.crc32(F.col(level).cast("binary")), F.lit(3))).cast("long")


def share_out(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Give each parent's ``budget`` to its children by weight, up to their capacity.

    ``nodes`` has one row per child with ``capacity``, ``weight`` and the
    parent's ``budget``, which is at most the sum of capacities. Children are
    taken in the order of capacity per weight: while the next one cannot take
    its share of what is left, it is full. The others share the rest by weight,
    rounded down; what rounding leaves goes, one token each, to the first of
    them by name. Children of weight 0 get what the others cannot take, as far
    as their capacity allows.
    """
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight"))
    order = Window.partitionBy(*parent).orderBy(ratio.asc_nulls_last(), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    free = whole.orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    exact = "decimal(38,0)"
    weighted = (
        nodes.withColumn("_before", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("_ahead", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_weights", F.sum("weight").over(whole))
        # With all children up to this one full, would its share be more than it has?
        .withColumn(
            "_full",
            (F.col("weight") > 0)
            & (
                F.col("capacity").cast(exact) * (F.col("_weights") - F.col("_ahead")).cast("decimal(18,0)")
                <= (F.col("budget") - F.col("_before")).cast(exact) * F.col("weight").cast("decimal(18,0)")
            ),
        )
    )
    filled = (
        weighted.withColumn("_taken", F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0)).over(whole))
        .withColumn("_open", F.when(F.col("_full"), 0).otherwise(F.col("weight")))
        .withColumn("_sum_open", F.sum("_open").over(whole))
        .withColumn("_rest", F.greatest(F.col("budget") - F.col("_taken"), F.lit(0)))
        .withColumn(
            "_floor",
            F.when(F.col("_full"), F.col("capacity")).when(
                F.col("_open") > 0,
                F.floor(
                    (F.col("_rest").cast(exact) * F.col("_open").cast("decimal(18,0)"))
                    / F.col("_sum_open").cast("decimal(18,0)")
                ).cast("long"),
            ).otherwise(0),
        )
        .withColumn("_left", F.col("budget") - F.sum("_floor").over(whole))
        .withColumn("_place", F.sum(F.when(F.col("_open") > 0, 1).otherwise(0)).over(free))
        .withColumn(
            "_given",
            F.col("_floor")
            + F.when((F.col("_open") > 0) & (F.col("_sum_open") > 0) & (F.col("_place") <= F.col("_left")), 1).otherwise(0),
        )
        .withColumn("_short", F.col("budget") - F.sum("_given").over(whole))
        .withColumn("_spare", F.when(F.col("weight") == 0, F.col("capacity")).otherwise(0))
        .withColumn("_spent", F.sum("_spare").over(free) - F.col("_spare"))
        .withColumn(
            "given",
            (F.col("_given") + F.greatest(F.least(F.col("_short") - F.col("_spent"), F.col("_spare")), F.lit(0))).cast("long"),
        )
    )
    return filled.drop("budget", *[c for c in filled.columns if c.startswith("_")]).withColumnRenamed("given", "budget")


def leaf_budgets(
    leaves: DataFrame, budget: Column, max_epochs: int = MAX_EPOCHS, weight=default_weight
) -> DataFrame:
    """``domain, language, source, tokens, budget`` for ``leaves`` with their ``tokens``.

    ``budget`` is an aggregate over all leaves; it is at most what all can give.
    """
    capacity = F.sum("tokens") * F.lit(max_epochs)
    # One number: the budget of the root.
    top = leaves.agg(F.least(F.coalesce(budget, F.lit(0)).cast("long"), F.coalesce(capacity, F.lit(0)))).first()[0]
    path: list[str] = []
    given = None
    for level in LEVELS:
        parent, path = path, [*path, level]
        sums = leaves.groupBy(*path).agg(capacity.cast("long").alias("capacity")).withColumn("weight", weight(level))
        nodes = sums.join(given, parent) if parent else sums.withColumn("budget", F.lit(int(top)).cast("long"))
        given = share_out(nodes, parent, level).select(*path, "budget")
    return leaves.join(given, path)


def _with_plans(rows: DataFrame, plans: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows with the plan of their leaf, whatever share of the rows a leaf has.

    Up to ``BROADCAST_LEAVES`` plans are broadcast, so the texts stay where they
    are. More are joined by a shuffle under salts that spread every leaf.
    """
    if plans.count() <= BROADCAST_LEAVES:
        return rows.join(F.broadcast(plans), names)
    salt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS))
    spread = plans.withColumn("__mix_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("__mix_salt", salt).join(spread, [*names, "__mix_salt"]).drop("__mix_salt")


def _order(seed: int) -> Column:
    """Place of a row in the last epoch: a non-negative 63-bit hash of id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 1)


def mix(
    docs: DataFrame, share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, weight=default_weight
) -> DataFrame:
    """Every chosen row once, with how often it is used.

    Adds ``mix_domain``, ``mix_epochs`` (whole epochs and, where the row is in
    the prefix, one more) and ``mix_tokens`` (tokens of one use). The budget is
    ``share`` of all tokens. The prefix of a leaf holds the rows whose running
    sum of tokens in the order of the epoch is within what is left; equal rows
    are in it together or not at all. Rows without tokens are used like others
    of their place; a leaf without tokens gets no budget and no rows. Columns
    of ``docs`` that have the name of an added one are replaced; any other
    names are allowed. An empty table gives no rows.
    """
    docs = docs.drop("mix_domain", "mix_epochs", "mix_tokens")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    leaf = leaf_columns()
    keys = [c.alias(f"__mix_{k}") for k, c in leaf.items()]
    names = [f"__mix_{k}" for k in leaf]
    rows = docs.select("doc_id", "text", *keys).withColumn("_order", _order(seed)).withColumn(
        "_slice", F.shiftright("_order", 63 - SLICE_BITS)
    )
    sums = cut_lineage(rows.groupBy(*names, "_slice").agg(F.sum(tokens(F.col("text"))).alias("tokens")))
    leaves = sums.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    leaves = cut_lineage(leaves.select(*[F.col(n).alias(n.removeprefix("__mix_")) for n in names], "tokens"))
    total = F.floor(F.sum("tokens").cast("decimal(38,0)") * F.lit(int(share * 1_000_000)) / 1_000_000)
    plans = leaf_budgets(leaves, total, max_epochs, weight).where(F.col("budget") > 0)
    plans = plans.select(
        *[F.col(n.removeprefix("__mix_")).alias(n) for n in names],
        F.expr("budget div tokens").alias("_whole"),
        (F.col("budget") % F.col("tokens")).alias("_rest"),
    )
    # The slice in which the running sum passes what is left of the budget.
    inside = Window.partitionBy(*names).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        sums.withColumn("_before", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(plans, names)
        .where((F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("tokens") > F.col("_rest")))
        .groupBy(*names)
        .agg(F.min(F.struct("_slice", "_before")).alias("_cut"))
    )
    plans = cut_lineage(
        plans.join(cuts, names, "left").select(
            *names, "_whole", "_rest", F.col("_cut._slice").alias("_cut_slice"), F.col("_cut._before").alias("_before")
        )
    )
    edge = (
        _with_plans(rows, plans, names)
        .where(F.col("_slice") == F.col("_cut_slice"))
        .select(*names, "_order", "_before", "_rest", tokens(F.col("text")).alias("tokens"))
    )
    running = Window.partitionBy(*names).orderBy("_order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        edge.withColumn("_sum", F.col("_before") + F.sum("tokens").over(running))
        .where(F.col("_sum") <= F.col("_rest"))
        .groupBy(*names)
        .agg(F.max("_order").alias("_last"))
    )
    plans = cut_lineage(plans.join(last, names, "left"))
    at, slice_ = _order(seed), F.shiftright(_order(seed), 63 - SLICE_BITS)
    in_prefix = (slice_ < F.col("_cut_slice")) | (at <= F.coalesce("_last", F.lit(-1)))
    # Rows travel as one value, so no column of theirs meets one of the plans.
    marked = _with_plans(docs.select("doc_id", "text", *keys, F.struct(*columns).alias("__mix_row")), plans, names)
    chosen = marked.withColumn("mix_epochs", F.col("_whole") + F.coalesce(in_prefix, F.lit(False)).cast("long"))
    return chosen.where(F.col("mix_epochs") > 0).select(
        *[F.col("__mix_row").getField(c).alias(c) for c in docs.columns],
        F.col("__mix_domain").alias("mix_domain"),
        "mix_epochs",
        tokens(F.col("text")).alias("mix_tokens"),
    )


@query()
def op1_source_mixture(spark: SparkSession, folder: str) -> DataFrame:
    chosen = mix(table(spark, folder, "documents"))
    return chosen.select("doc_id", "mix_domain", "lang", "source", "mix_epochs", "mix_tokens")

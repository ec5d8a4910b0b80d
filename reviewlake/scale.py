"""Building blocks that keep every operator free of one-task groups.

The rule behind all of them: a key may hold a third of the table. So rows are
ranked, chained and concatenated in slices of bounded size, and only one small
summary row per slice ever meets the others.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

# Rows that share a slice of 2**SLICE_BITS consecutive integer positions.
SLICE_BITS = 16
# So many keys, those with most rows, are joined by broadcast; any other key
# then has less than one thousandth of the rows.
HEAVY_KEYS = 1_000
# Rows of heavy keys go through a shuffle under so many salts.
SALTS = 4_096
# Most rows a table of criteria may have; it is written by hand.
CONFIG_ROWS = 10_000


def _checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    A folder is made here only in local mode and only when none is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="reviewlake-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so a lost executor costs no recomputation."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def work_folder(spark: SparkSession) -> str:
    """A new name in the shared folder for tables of one run."""
    return f"{_checkpoint_folder(spark)}/reviewlake-{uuid.uuid4().hex}"


def config_rows(df: DataFrame, what: str, limit: int = CONFIG_ROWS) -> list[Row]:
    """Read a table that must be small by its nature; refuse a larger one."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


def _salted(df: DataFrame, heavy: Column, keys: Sequence[str], spread: str) -> DataFrame:
    """Salt 0 for light rows, a spread-out one that matches nothing for the others.

    The others are rows of heavy keys and rows without a key.
    """
    salt = 1 + F.pmod(F.xxhash64(spread), F.lit(SALTS))
    for key in keys:
        heavy = heavy | F.col(key).isNull()
    return df.withColumn("_salt", F.when(heavy, salt).otherwise(F.lit(0).cast("long")))


def lookup(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    weight: str,
    spread: str,
    how: str = "left",
    large: bool = False,
) -> DataFrame:
    """Add the columns of a table with unique keys, however skewed ``df`` is.

    ``weight`` is the number of rows a key has in ``df``. The heaviest keys, a
    fixed number of rows, are broadcast; the others are joined by a shuffle,
    which the rows of heavy keys pass evenly spread by the column ``spread``.
    ``large`` says that the table is so even where Spark takes it for a small one.
    """
    keys = list(keys)
    values = [c for c in table.columns if c not in {*keys, weight}]
    # Reading the weight on both sides lets Spark reuse one aggregation.
    weighed = table.where(F.col(weight) > 0)
    top = weighed.orderBy(F.desc(weight), *keys).limit(HEAVY_KEYS)
    heavy = F.broadcast(top.select(*keys, F.struct(*values).alias("_heavy")))
    # A salt that the optimizer can't tell is zero, or rows would be dealt by the keys alone.
    unsalted = F.least(F.col(weight).cast("long"), F.lit(0).cast("long"))
    light = weighed.select(*keys, unsalted.alias("_salt"), F.struct(*values).alias("_light"))
    light = light.hint("merge") if large else light
    marked = _salted(df.join(heavy, keys, "left"), F.col("_heavy").isNotNull(), keys, spread)
    joined = marked.join(light, [*keys, "_salt"], "left").withColumn(
        "_found", F.coalesce("_heavy", "_light")
    )
    if how == "inner":
        joined = joined.where(F.col("_found").isNotNull())
    return joined.select(*df.columns, *[F.col("_found")[v].alias(v) for v in values])


def heavy_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys with most rows, a fixed number of them."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    return cut_lineage(counts.orderBy(F.desc("_n"), key).limit(HEAVY_KEYS).select(key))


def members(
    df: DataFrame, ids: DataFrame, key: str, heavy: DataFrame, spread: str, inside: bool = True
) -> DataFrame:
    """Rows whose key is (or is not) among unique ids, however skewed ``df`` is.

    ``heavy`` comes from :func:`heavy_keys`; its rows are decided by broadcast.
    """
    yes = F.lit(True)
    known = F.broadcast(
        heavy.join(ids.select(F.col(key), yes.alias("_in")), key, "left").select(
            key, yes.alias("_heavy"), "_in"
        )
    )
    # Always zero, but not for the optimizer; see :func:`lookup`.
    unsalted = F.pmod(F.xxhash64(key), F.lit(1).cast("long"))
    light = ids.select(key, unsalted.alias("_salt"), yes.alias("_light"))
    marked = _salted(df.join(known, key, "left"), F.col("_heavy").isNotNull(), [key], spread)
    joined = marked.join(light, [key, "_salt"], "left")
    found = F.coalesce("_in", "_light")
    return joined.where(found.isNotNull() if inside else found.isNull()).select(*df.columns)


def slice_of(position: Column | str) -> Column:
    """The slice of an integer position; keeps the order of positions."""
    col = F.col(position) if isinstance(position, str) else position
    return F.shiftright(col.cast("long"), SLICE_BITS)


def _running_before(value: str, keys: Sequence[str], order: str) -> Column:
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def id_index(df: DataFrame, id_col: str, name: str = "row_index") -> DataFrame:
    """Dense 0-based rank of a unique integer id, without a global sort.

    Ids are counted per slice; a two-level running sum over the slice counts
    gives each slice its first rank. A slice has at most 2**16 ids however the
    ids are spread, and rows move once, by slice.
    """
    counts = (
        df.select(slice_of(id_col).alias("_slice"))
        .groupBy("_slice")
        .agg(F.count("*").alias("_n"))
        .withColumn("_top", F.shiftright("_slice", 24))
    )
    tops = counts.groupBy("_top").agg(F.sum("_n").alias("_n"))
    tops = tops.select("_top", _running_before("_n", [], "_top").alias("_top_start"))
    starts = (
        counts.withColumn("_within", _running_before("_n", ["_top"], "_slice"))
        .join(tops, "_top")
        .select("_slice", (F.col("_top_start") + F.col("_within")).alias("_start"))
    )
    window = Window.partitionBy("_slice").orderBy(id_col)
    return (
        df.withColumn("_slice", slice_of(id_col))
        .withColumn(name, F.row_number().over(window) - 1)
        .join(starts, "_slice")
        .withColumn(name, (F.col(name) + F.col("_start")).cast("long"))
        .drop("_slice", "_start")
    )


def hash_index(df: DataFrame, digest: Column, id_col: str, name: str = "row_index") -> DataFrame:
    """Dense 0-based rank in the order of a hex digest of a unique id.

    The first four hex digits spread the rows evenly over 65 536 slices.
    """
    hashed = df.withColumn("_digest", digest).withColumn("_slice", F.substring("_digest", 1, 4))
    starts = hashed.groupBy("_slice").agg(F.count("*").alias("_n"))
    starts = starts.select("_slice", _running_before("_n", [], "_slice").alias("_start"))
    window = Window.partitionBy("_slice").orderBy("_digest", id_col)
    return (
        hashed.withColumn(name, F.row_number().over(window) - 1)
        .join(starts, "_slice")
        .withColumn(name, (F.col(name) + F.col("_start")).cast("long"))
        .drop("_slice", "_start", "_digest")
    )


def range_index(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """Dense 0-based rank in the order of any columns that identify the row.

    The range shuffle is checkpointed, because the slice number of a row has to
    be the same when counting and when ranking.
    """
    placed = cut_lineage(
        df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id())
    )
    starts = placed.groupBy("_slice").agg(F.count("*").alias("_n"))
    starts = starts.select("_slice", _running_before("_n", [], "_slice").alias("_start"))
    window = Window.partitionBy("_slice").orderBy(*order)
    return (
        placed.withColumn(name, F.row_number().over(window) - 1)
        .join(starts, "_slice")
        .withColumn(name, (F.col(name) + F.col("_start")).cast("long"))
        .drop("_slice", "_start")
    )


def ordered_items(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "ord"
) -> DataFrame:
    """Number the rows of each key from 0 in the order of other columns.

    Rows are ranged over all tasks by key and order together, which identify a
    row, so one key may hold any share of them.
    """
    placed = range_index(df, [*keys, *order], "_place")
    firsts = placed.groupBy(*keys).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    return (
        lookup(placed, firsts, keys, "_n", "_place", how="inner")
        .withColumn(name, F.col("_place") - F.col("_first"))
        .drop("_place", "_first")
    )


def joined_items(
    items: DataFrame,
    keys: Sequence[str],
    separator: str,
    name: str,
    value: str = "item",
    order: str = "ord",
) -> DataFrame:
    """One text per key: its items in order, joined.

    For callers who know that the lists of their keys fit one value. The table
    of items is the form without that bound, and what the operators return.
    """
    ordered = F.array_sort(F.collect_list(F.struct(order, value)))
    texts = F.transform(ordered, lambda i: i[value])
    return items.groupBy(*keys).agg(F.array_join(texts, separator).alias(name))


def neighbours(
    df: DataFrame, keys: Sequence[str], position: str, value: str, before: str, last: str
) -> DataFrame:
    """Add the value of the row before, and whether no row follows, inside each key.

    Rows meet inside slices of the position; one row per slice carries its last
    value over to the next slice.
    """
    sliced = df.withColumn("_slice", slice_of(position))
    inside = Window.partitionBy(*keys, "_slice").orderBy(position)
    across = Window.partitionBy(*keys).orderBy("_slice")
    ends = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.max_by(value, position).alias("_end"))
        .select(
            *keys,
            "_slice",
            F.lag("_end").over(across).alias("_carried"),
            F.lead("_slice").over(across).isNull().alias("_final"),
        )
    )
    return (
        sliced.withColumn("_opens", F.row_number().over(inside) == 1)
        .withColumn("_previous", F.lag(value).over(inside))
        .withColumn("_closes", F.lead(position).over(inside).isNull())
        .join(ends, [*keys, "_slice"])
        .withColumn(before, F.when(F.col("_opens"), F.col("_carried")).otherwise(F.col("_previous")))
        .withColumn(last, F.col("_closes") & F.col("_final"))
        .drop("_slice", "_opens", "_previous", "_closes", "_carried", "_final")
    )


def runs(df: DataFrame, keys: Sequence[str], position: str, value: str, name: str) -> DataFrame:
    """Mark runs of equal neighbours: ``name`` is the position the run starts at.

    Neighbours are compared inside slices of the position; one summary row per
    slice carries the open run over to the next slice of the same key.
    """
    sliced = df.withColumn("_slice", slice_of(position))
    inside = Window.partitionBy(*keys, "_slice").orderBy(position)
    marked = sliced.withColumn("_rank", F.row_number().over(inside)).withColumn(
        "_starts",
        F.when(
            (F.col("_rank") > 1) & ~F.lag(value).over(inside).eqNullSafe(F.col(value)),
            F.col(position),
        ),
    )
    across = Window.partitionBy(*keys).orderBy("_slice")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        marked.groupBy(*keys, "_slice")
        .agg(
            F.min(position).alias("_first_position"),
            F.min_by(F.struct(F.col(value)), F.col(position)).alias("_first"),
            F.max_by(F.struct(F.col(value)), F.col(position)).alias("_last"),
            F.max("_starts").alias("_last_start"),
        )
        .withColumn("_before", F.lag("_last").over(across))
        .withColumn(
            "_opens",
            F.when(
                F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col("_first")),
                F.col("_first_position"),
            ),
        )
        .withColumn(
            "_carried",
            F.last(F.coalesce("_last_start", "_opens"), ignorenulls=True).over(earlier),
        )
        .select(*keys, "_slice", F.coalesce("_opens", "_carried").alias("_open"))
    )
    return (
        marked.join(summary, [*keys, "_slice"])
        .withColumn(
            name,
            F.coalesce(
                F.last("_starts", ignorenulls=True).over(
                    inside.rowsBetween(Window.unboundedPreceding, 0)
                ),
                F.col("_open"),
            ),
        )
        .drop("_slice", "_rank", "_starts", "_open")
    )


def next_marked(
    df: DataFrame, keys: Sequence[str], position: str, mark: Column, name: str
) -> DataFrame:
    """Position of the next marked row after each row of the same key."""
    sliced = df.withColumn("_slice", slice_of(position)).withColumn(
        "_marked", F.when(mark, F.col(position))
    )
    across = (
        Window.partitionBy(*keys).orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)
    )
    later = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.min("_marked").alias("_first"))
        .select(*keys, "_slice", F.min("_first").over(across).alias("_later"))
    )
    inside = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(position)
        .rowsBetween(1, Window.unboundedFollowing)
    )
    return (
        sliced.withColumn(name, F.min("_marked").over(inside))
        .join(later, [*keys, "_slice"])
        .withColumn(name, F.coalesce(name, "_later"))
        .drop("_slice", "_marked", "_later")
    )

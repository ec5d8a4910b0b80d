"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives a vector a long string of bits (signs of random projections)
and keeps the strings of a block in a sorted array. A query descends each tree
to its longest prefix match, at whatever length that is; then all trees ascend
together, one bit a step, until the ranges under the common prefix length hold
enough candidates. Only those are compared exactly.

Vectors are dealt to blocks of bounded size by a hash of their id, each block
being a forest of its own; the stated queries visit every block, and a query's
block results are merged. Equal vectors are one candidate with their smallest
ids, so a vector that many rows share costs no more than another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.llm.registry import query, table
from reviewlake.scale import cut_lineage

NEAREST = 20
TREES, STRING_BITS = 32, 24
# Candidates a query wants of a block, as a share of its vectors. In 64
# dimensions without structure this finds about 0.96 of the true neighbours.
CANDIDATES = 0.5
BLOCK_ROWS = 4_096
QUERY_ROWS = 2_048
SEED = 42


def valid(vector: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _planes(dimensions: int) -> np.ndarray:
    # One more dimension makes all vectors equally long (see _hash_strings).
    return np.random.default_rng(SEED).standard_normal((dimensions + 1, TREES * STRING_BITS)).astype(np.float32)


def _hash_strings(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Bit strings of each vector and tree as numbers, first bit highest.

    Vectors of different length get one more component that makes all as long
    as the longest, so large inner products mean small angles.
    """
    rest = np.sqrt(np.maximum(longest**2 - (vectors.astype(np.float64) ** 2).sum(axis=1), 0))
    whole = np.concatenate([vectors, rest[:, None]], axis=1).astype(np.float32)
    bits = (whole @ _planes(vectors.shape[1]) > 0).reshape(len(vectors), TREES, STRING_BITS)
    return bits.astype(np.int64) @ (1 << np.arange(STRING_BITS - 1, -1, -1))


class Forest:
    """The sorted strings of one block of vectors."""

    def __init__(self, vectors: np.ndarray, longest: float):
        self.longest = longest
        strings = _hash_strings(vectors, longest)
        self.order = np.argsort(strings, axis=0, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=0)

    def candidates(self, queries: np.ndarray, wanted: int) -> list[np.ndarray]:
        """For each query the block rows found, ascending until there are ``wanted``.

        Rows are counted once per tree that holds them while ascending, as in
        one list per tree; the result names each once. At the root every row is
        a candidate.
        """
        # A query has no extra component; it is longer or shorter, not turned.
        whole = np.concatenate([queries, np.zeros((len(queries), 1), queries.dtype)], axis=1).astype(np.float32)
        bits = (whole @ _planes(queries.shape[1]) > 0).reshape(len(queries), TREES, STRING_BITS)
        strings = bits.astype(np.int64) @ (1 << np.arange(STRING_BITS - 1, -1, -1))
        n = len(self.sorted)
        low = np.zeros((len(queries), TREES), np.int64)
        high = np.full((len(queries), TREES), n)
        open_ = np.arange(len(queries))
        # Descend: the longest prefix that some string of the tree shares.
        depth = np.zeros((len(queries), TREES), np.int64)
        for tree in range(TREES):
            at = np.searchsorted(self.sorted[:, tree], strings[:, tree])
            best = np.zeros(len(queries), np.int64)
            for near in (np.maximum(at - 1, 0), np.minimum(at, n - 1)):
                differ = self.sorted[near, tree] ^ strings[:, tree]
                length = STRING_BITS - np.ceil(np.log2(differ + 1)).astype(np.int64)
                best = np.maximum(best, length)
            depth[:, tree] = best
        # Ascend all trees together from the deepest match.
        level = depth.max(axis=1)
        found: list[np.ndarray | None] = [None] * len(queries)
        for step in range(STRING_BITS, -1, -1):
            here = open_[level[open_] >= step]
            if len(here) == 0:
                continue
            shift = STRING_BITS - step
            first = (strings[here] >> shift) << shift
            for tree in range(TREES):
                deep = depth[here, tree] >= step
                low[here, tree] = np.where(deep, np.searchsorted(self.sorted[:, tree], first[:, tree]), 0)
                high[here, tree] = np.where(
                    deep, np.searchsorted(self.sorted[:, tree], first[:, tree] + (1 << shift)), 0
                )
            # Rows of several trees overlap: the sum is an upper bound.
            enough = here[(high[here] - low[here]).sum(axis=1) >= wanted] if step else here
            closed = []
            for q in enough:
                hit = np.zeros(n, bool)
                for tree in range(TREES):
                    hit[self.order[low[q, tree] : high[q, tree], tree]] = True
                if step == 0 or hit.sum() >= wanted:
                    found[q] = np.flatnonzero(hit)
                    closed.append(q)
            open_ = np.setdiff1d(open_, closed, assume_unique=True)
        return found


def search_block(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, longest: float, nearest: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, id, score)`` of the nearest candidates of each query in a block."""
    forest = Forest(vectors, longest)
    exact, asked = vectors.astype(np.float64), queries.astype(np.float64)
    out_q, out_id, out_score = [], [], []
    found = forest.candidates(queries, min(len(vectors), max(4 * nearest, int(CANDIDATES * len(vectors)))))
    for q, rows in enumerate(found):
        score = exact[rows] @ asked[q]
        best = np.lexsort((ids[rows], -score))[:nearest] if len(rows) <= 4 * nearest else None
        if best is None:
            # Ties at the edge all stay for the sort.
            edge = np.partition(score, len(score) - nearest)[len(score) - nearest]
            close = np.flatnonzero(score >= edge)
            best = close[np.lexsort((ids[rows[close]], -score[close]))[:nearest]]
        out_q.append(np.full(len(best), query_ids[q]))
        out_id.append(ids[rows[best]])
        out_score.append(score[best])
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_score)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.cast(pa.large_list(pa.float64()))
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, nearest: int = NEAREST, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's nearest found vectors.

    Nearness is the largest inner product in double precision, ties to the
    smaller id; a query is not its own neighbour. Vectors that are null, empty,
    zero or hold null or non-finite components, and rows without an id, take no
    part; vectors of another number of components are not comparable and only
    meet their own kind. Repeated rows of an id count once.
    """
    rows = vectors.where(valid(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), is_query.alias("asked")
    ).withColumn("size", F.size("embedding"))
    spread = F.xxhash64("vec_id")
    # One class per different vector; its nearest + 1 smallest ids are all that can be returned.
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    smallest = rows.select("embedding", "vec_id").distinct().withColumn("n", rank).where(F.col("n") <= nearest + 1)
    classes = cut_lineage(
        smallest.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .join(rows.groupBy("embedding").agg(F.max("asked").alias("asked"), F.first("size").alias("size")), "embedding")
        .withColumn("class", F.col("ids")[0])
    )
    counts = classes.groupBy("size").agg(
        F.count("*").alias("n"),
        F.sum(F.col("asked").cast("long")).alias("q"),
        F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).alias("longest"),
    )
    # One row per number of components.
    sizes = [tuple(r) for r in counts.collect()]
    found = None
    for size, n, q, longest in sizes:
        part = _search(classes.where(F.col("size") == size), n, q or 0, float(longest), nearest, block_rows)
        found = part if found is None else found.unionByName(part)
    schema = "query_id long, rank int, vec_id long, score double"
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    # The best classes of each asked class, itself among them, become ids.
    own = classes.where("asked").select(
        F.col("class").alias("query"),
        F.col("class"),
        F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x).alias("score"),
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    best = found.where(F.col("query") != F.col("class")).withColumn("n", F.row_number().over(order))
    best = best.where(F.col("n") <= nearest).drop("n").unionByName(own)
    members = best.join(classes.select("class", "ids"), "class").select(
        "query", "score", F.explode("ids").alias("vec_id")
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = members.withColumn("n", F.row_number().over(order)).where(F.col("n") <= nearest + 1)
    lists = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
    asked = rows.where("asked").select("vec_id", "embedding").distinct()
    asked = asked.join(classes.select("embedding", F.col("class").alias("query")), "embedding")
    answers = asked.select(F.col("vec_id").alias("query_id"), "query").join(lists, "query")
    others = F.slice(F.filter("near", lambda e: e["vec_id"] != F.col("query_id")), 1, nearest)
    return answers.select("query_id", F.posexplode(others).alias("place", "e")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), "e.vec_id", "e.score"
    )


def _search(classes: DataFrame, n: int, q: int, longest: float, nearest: int, block_rows: int) -> DataFrame:
    """``(query, class, score)`` from every block of classes for every block of queries."""
    blocks, shares = -(-n // block_rows), max(1, -(-q // QUERY_ROWS))
    block = F.pmod(F.xxhash64("class", F.lit(1)), F.lit(blocks)).cast("int")
    share = F.pmod(F.xxhash64("class", F.lit(2)), F.lit(shares)).cast("int")
    stored = classes.select(
        "class", "embedding", F.lit(False).alias("query"), block.alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"),
    )
    asked = classes.where("asked").select(
        "class", "embedding", F.lit(True).alias("query"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), share.alias("share"),
    )

    def searched(key: tuple, cell: pa.Table) -> pa.Table:
        mask = cell.column("query").to_numpy(zero_copy_only=False).astype(bool)
        matrix = _matrix(cell.column("embedding").combine_chunks())
        ids = cell.column("class").to_numpy()
        order = np.argsort(ids, kind="stable")
        mask, matrix, ids = mask[order], matrix[order], ids[order]
        if mask.all() or not mask.any():
            got = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        else:
            got = search_block(matrix[mask], ids[mask], matrix[~mask], ids[~mask], longest, nearest + 1)
        return pa.table({"query": pa.array(got[0]), "class": pa.array(got[1]), "score": pa.array(got[2])})

    both = stored.unionByName(asked)
    return both.groupBy("block", "share").applyInArrow(searched, "query long, class long, score double")


@query()
def op7_prefix_forest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return nearest_neighbours(vectors, F.pmod(F.col("vec_id"), F.lit(20)) == 0)

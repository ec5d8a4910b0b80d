"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``BITS_APART`` bits are linked; components of links are the
groups. The 64 bits are dealt to m partitions, correlated bits together, and
partition i gets a threshold t_i >= -1 with ``sum(t_i) = BITS_APART - m + 1``.
Two linked fingerprints are then within t_i bits in some partition i: each
fingerprint is stored under its partition keys and probes every key within t_i
of its own. The thresholds are chosen by dynamic programming over the estimated
numbers of probes and candidates, from exact key counts of all fingerprints,
and m by the same estimate, so keys grow longer as the table grows.

Equal fingerprints are one candidate whatever their number of documents. A key
with many fingerprints is cut into blocks, and every two blocks meet in a cell
of their own; a cell is compared in numpy and gives only links to the lowest
fingerprint of each component inside it, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.components import connected_components
from reviewlake.llm.registry import query, table
from reviewlake.scale import cut_lineage

BITS, BITS_APART, SHINGLE, SEED = 64, 3, 3, 42
# Fingerprints of one key that are compared in one cell.
BLOCK_ROWS = 2_048
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SIGN = 1 << 63


def fingerprint_of(text: str | None) -> int:
    """The 64-bit SimHash of a text; 0 for a null text or one without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n = len(words)
    if n < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, n)
        end = np.cumsum(size + 1) - 1
        digest = xxhash.xxh64_intdigest
        starts, ends = (end - size)[: n - SHINGLE + 1].tolist(), end[SHINGLE - 1 :].tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends)]
    bytes_ = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(bytes_), 4096):
        ones += np.unpackbits(bytes_[at : at + 4096], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column) -> Column:
    """The SimHash of a text as a signed 64-bit number."""

    @F.arrow_udf("long")
    def hashed(texts: pa.Array) -> pa.Array:
        got = np.fromiter((fingerprint_of(t.as_py()) for t in texts), np.uint64, len(texts))
        return pa.array(got.view(np.int64))

    return hashed(text)


def _as_bits(fingerprints: np.ndarray) -> np.ndarray:
    return np.unpackbits(
        fingerprints.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
    )


def bit_correlation(fingerprints: DataFrame) -> np.ndarray:
    """Absolute correlation of all bits over all fingerprints, 64 × 64."""

    def counted(batches):
        total = np.zeros((BITS + 1, BITS + 1))
        for batch in batches:
            bits = _as_bits(batch.column("f").to_numpy()).astype(np.float32)
            ones = np.concatenate([bits, np.ones((len(bits), 1), np.float32)], axis=1)
            total += ones.T @ ones
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells), pa.array(total.ravel()[cells])], ["cell", "n"]
        )

    rows = (
        fingerprints.select("f").mapInArrow(counted, "cell long, n double")
        .groupBy("cell").agg(F.sum("n").alias("n")).collect()
    )
    total = np.zeros((BITS + 1) ** 2)
    for r in rows:
        total[r["cell"]] = r["n"]
    total = total.reshape(BITS + 1, BITS + 1)
    n = max(total[-1, -1], 1.0)
    mean, both = total[-1, :-1] / n, total[:-1, :-1] / n
    covariance = both - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.outer(np.diag(covariance), np.diag(covariance)), 1e-12))
    return np.abs(covariance) / spread


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bits to m partitions of nearly equal size, correlated bits together.

    Each partition starts with the free bit of the lowest number and takes the
    free bit with the largest correlation to its members until it is full.
    """
    free, groups = list(range(BITS)), []
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        group = [free.pop(0)]
        while len(group) < size:
            pull = correlation[np.ix_(group, free)].sum(axis=0)
            group.append(free.pop(int(pull.argmax())))
        groups.append(sorted(group))
    return groups


def _key(bits: Sequence[int]) -> Column:
    """A partition's bits of the column ``f``, the others zero: the key of a fingerprint."""
    mask = sum(1 << b for b in bits)
    return F.col("f").bitwiseAND(F.lit(mask - (1 << 64) if mask >= _SIGN else mask))


def key_squares(fingerprints: DataFrame, groups: list[list[int]]) -> list[float]:
    """Per partition, the sum over its keys of the squared number of fingerprints."""
    keys = F.array(*[F.struct(F.lit(i).alias("part"), _key(g).alias("key")) for i, g in enumerate(groups)])
    rows = (
        fingerprints.select(F.inline(keys))
        .groupBy("part", "key").agg(F.count("*").cast("double").alias("n"))
        .groupBy("part").agg(F.sum(F.col("n") * F.col("n")).alias("squares"))
        .collect()
    )
    found = {r["part"]: r["squares"] for r in rows}
    return [found.get(i, 0.0) for i in range(len(groups))]


def allot(sizes: Sequence[int], squares: Sequence[float], n: float) -> tuple[float, list[int]]:
    """``(cost, thresholds)`` of the cheapest allotment, by dynamic programming.

    The cost of threshold t in a partition of w bits is its rows, stored and
    probing, and its candidates: those with an equal key as counted, those
    1 … t bits away as if keys were spread evenly. -1 leaves a partition out.
    """
    total = BITS_APART - len(sizes) + 1

    def cost(i: int, t: int) -> float:
        if t < 0:
            return 0.0
        w = sizes[i]
        near = sum(comb(w, k) for k in range(1, t + 1))
        return n * (2 + near) + squares[i] / 2 + n * n * near / 2.0**w / 2

    # Sums of thresholds so far, from -i up; each keeps its cheapest choice.
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(len(sizes)):
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (so_far, chosen) in best.items():
            for t in range(-1, BITS_APART + 1):
                value = (so_far + cost(i, t), [*chosen, t])
                if spent + t not in step or value < step[spent + t]:
                    step[spent + t] = value
        best = step
    return best[total]


def plan(fingerprints: DataFrame, choices: Sequence[int] = (2, 3, 4)) -> list[tuple[list[int], int]]:
    """``(bits, threshold)`` of each partition that is used."""
    correlation = bit_correlation(fingerprints)
    n = float(fingerprints.count())
    found = []
    for m in choices:
        groups = group_bits(correlation, m)
        cost, thresholds = allot([len(g) for g in groups], key_squares(fingerprints, groups), n)
        found.append((cost, m, list(zip(groups, thresholds))))
    return [(g, t) for g, t in min(found)[2] if t >= 0]


def _masks(bits: Sequence[int], threshold: int) -> list[int]:
    """Signed masks that flip 1 … threshold of the bits."""
    out = []
    for k in range(1, threshold + 1):
        for chosen in combinations(bits, k):
            mask = sum(1 << b for b in chosen)
            out.append(mask - (1 << 64) if mask >= _SIGN else mask)
    return out


def cells(fingerprints: DataFrame, parts: list[tuple[list[int], int]], block: int) -> DataFrame:
    """``(part, key, cell, block, f, probe)``: who meets whom.

    A fingerprint is stored under its own key of each partition and probes the
    higher ones of the keys within the threshold; lower ones probe it.
    """

    def entry(part: int, key: Column, probe: bool) -> Column:
        return F.struct(F.lit(part).alias("part"), key.alias("key"), F.lit(probe).alias("probe"))

    def near(part: int, own: Column, masks: list[int]) -> Column:
        flipped = F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: own.bitwiseXOR(m))
        return F.transform(F.filter(flipped, lambda k: k > own), lambda k: entry(part, k, True))

    entries = []
    for i, (bits, threshold) in enumerate(parts):
        own, masks = _key(bits), _masks(bits, threshold)
        entries.append(F.array(entry(i, own, False)))
        if masks:
            entries.append(near(i, own, masks))
    rows = fingerprints.select("f", F.inline(F.concat(*entries)))
    # Keys with more rows than a block; what has no stored row there is dropped below.
    large = (
        rows.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > block)
        .select("part", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    placed = rows.join(large, ["part", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn(
        "block", F.pmod(F.xxhash64("f"), F.col("blocks").cast("long")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return placed.withColumn("other", other).select(
        "part",
        "key",
        (F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).alias("cell"),
        "f",
        "probe",
    )


def _star(f: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each fingerprint of a cell to the lowest of its component there."""
    # One of the two has to be stored under this key.
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= BITS_APART
    near &= ~(probe[:, None] & probe[None, :])
    np.fill_diagonal(near, True)
    label = np.arange(len(f))
    while True:
        lower = np.where(near, label[None, :], len(f)).min(axis=1)
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    linked = label != np.arange(len(f))
    return f[linked], f[label[linked]]


def _sorted_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows sorted by (part, key, cell); a cell may run over several batches."""
    rest: list[np.ndarray] = []

    def run(rows: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(rows)))
        high, low = [], []
        pairs = first[size == 2]
        if len(pairs):
            a, b = rows[pairs, 3].view(np.uint64), rows[pairs + 1, 3].view(np.uint64)
            near = (np.bitwise_count(a ^ b) <= BITS_APART) & ~((rows[pairs, 4] & rows[pairs + 1, 4]) > 0)
            high.append(np.maximum(a, b)[near]), low.append(np.minimum(a, b)[near])
        for at, n in zip(first[size > 2], size[size > 2]):
            part = rows[at : at + n]
            if part[:, 4].all():
                continue
            order = np.argsort(part[:, 3].view(np.uint64), kind="stable")
            h, l = _star(part[order, 3].view(np.uint64), part[order, 4] > 0)
            high.append(h), low.append(l)
        empty = np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([empty, *x]).astype(np.uint64).view(np.int64)) for x in (high, low)],
            ["src", "dst"],
        )

    for batch in batches:
        rows = np.stack(
            [batch.column(c).cast(pa.int64()).to_numpy() for c in ("part", "key", "cell", "f", "probe")], axis=1
        )
        if len(rows) == 0:
            continue
        # The last cell of a batch may go on in the next one.
        same = (rows[:, :3] == rows[-1, :3]).all(axis=1)
        cut = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut == 0 and rest and (rest[-1][-1, :3] == rows[0, :3]).all():
            rest.append(rows)
            continue
        yield run(np.concatenate([*rest, rows[:cut]]))
        rest = [rows[cut:]]
    if rest:
        yield run(np.concatenate(rest))


def links(fingerprints: DataFrame, block: int = BLOCK_ROWS, choices: Sequence[int] = (2, 3, 4)) -> DataFrame:
    """``(src, dst)`` links of distinct fingerprints ``f`` that keep all components."""
    met = cells(fingerprints, plan(fingerprints, choices), block)
    numbers = met.withColumn("probe", F.col("probe").cast("int"))
    placed = numbers.repartition("part", "key", "cell").sortWithinPartitions("part", "key", "cell")
    return placed.mapInArrow(_sorted_links, "src long, dst long").distinct()


def groups(docs: DataFrame, block: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(rows, components)``: every row's fingerprint, and each fingerprint's group.

    ``rows (doc_id, digest, f)`` has one row per document row, ``digest`` being
    a hash of the text; ``components (f, component_id)`` has the smallest
    doc_id of the group, null if none of its documents has an id.
    """
    rows = cut_lineage(
        docs.select("doc_id", F.xxhash64("text").alias("digest"), fingerprint(F.col("text")).alias("f"))
    )
    firsts = cut_lineage(rows.groupBy("f").agg(F.min("doc_id").alias("first")))
    joined = cut_lineage(connected_components(links(firsts.select("f"), block)))
    placed = firsts.join(joined.select(F.col("id").alias("f"), "component"), "f", "left")
    placed = placed.withColumn("component", F.coalesce("component", "f"))
    lowest = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows, placed.join(lowest, "component").select("f", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Null and empty texts have fingerprint zero and are linked like any other;
    repeated rows are members of one group; other columns are not read.
    """
    rows, components = groups(docs)
    return rows.join(components, "f").select(
        "doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group: the one with the smallest id, columns unchanged.

    Of several rows with that id the one with the smallest text hash stays, of
    equal rows one. A group without any id keeps the row with the smallest text
    hash. Null and empty texts are one group; columns may have any names, and an
    empty table gives an empty one.
    """
    rows, components = groups(docs)
    known = rows.join(components, "f")
    # The lowest fingerprint stands for the group.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    group = F.coalesce(F.col("component_id"), F.col("f"))
    key = [F.col("component_id").isNull().alias("unnamed"), group.alias("group")]
    kept = known.groupBy(*key).agg(F.min(place).alias("p")).select("p.doc_id", "p.digest")
    counts = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("copies"))
    marked = cut_lineage(
        kept.alias("k").join(
            counts.alias("c"),
            F.col("k.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("k.digest") == F.col("c.digest")),
        ).select("k.doc_id", "k.digest", "copies")
    )
    # Rows travel as one value, so no column of theirs meets one of the ids.
    whole = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def chosen(ids: DataFrame) -> DataFrame:
        same = F.col("r.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("r.digest") == F.col("i.digest"))
        kept = whole.alias("r").join(ids.alias("i"), same, "left_semi")
        return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])

    repeated = marked.where(F.col("copies") > 1)
    single = chosen(marked.where(F.col("copies") == 1))
    if repeated.isEmpty():
        return single
    return single.unionByName(chosen(repeated).dropDuplicates(["doc_id", "text"]))


@query()
def op10_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))

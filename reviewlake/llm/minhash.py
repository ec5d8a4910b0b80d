"""Document fingerprints by MinHash, and the near-duplicates they find.

A text's shingles are its runs of ``SHINGLE`` lower-cased words (of a shorter
text: all its words). Each of ``PERMUTATIONS`` universal functions
``a x + b mod 2**64`` with odd ``a`` permutes the 64-bit shingle hashes; the
fingerprint keeps 16 bits of the smallest value under each. Equal positions of
two fingerprints estimate the Jaccard index of their shingle sets.

Near-duplicates: a fingerprint is cut into bands of ``BAND_ROWS`` positions, and
texts with an equal band meet in Spark. Their Jaccard index is then computed
from all shingles of both texts. With 25 bands of five rows a pair at Jaccard
0.8 shares a band with probability 0.99995. A bucket is not expanded into
pairs: its texts are compared with the lowest of them, and buckets with the same
lowest text are one group. Where that leaves texts of a group unlinked, its texts
meet in cells of bounded size, and numpy counts the shared shingles of all of a
cell's pairs at once. So every pair of a bucket is compared, in one class
already, or ruled out by the numbers of their shingles, and only links that join
two classes become rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.llm import bytetext
from reviewlake.llm.components import connected_components
from reviewlake.llm.registry import query, table
from reviewlake.scale import cut_lineage, lookup, work_folder

SHINGLE, PERMUTATIONS, SEED = 5, 128, 42
BAND_ROWS, JACCARD = 5, 0.8
BANDS = PERMUTATIONS // BAND_ROWS
# Texts of a group, and shingles of theirs, that share a block; two blocks meet in a cell.
SLOT, SLOT_SHINGLES = 512, 1 << 19
# Shingles that are columns of one matrix, and the share of a cell's texts that makes one a column.
COLUMNS, DENSE = 1_024, 64
# Pairs of one centre that are verified in one place.
PAIRS_PLACE = 512
# Buckets of text keys that are broadcast to thin out the scan for texts.
THINNING = 1 << 20
# Rows that a task works on at a time.
SLICE_ROWS = 256
# Hex digits of a position of a fingerprint, and of the key of a text.
_DIGITS, _KEY = 4, 32

_draw = np.random.default_rng(SEED)
_A = _draw.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _draw.integers(0, 1 << 64, PERMUTATIONS, np.uint64)


def shingles(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(texts, hashes, text of each)`` of consecutive texts; null counts as empty."""
    for data, offsets in bytetext.pieces(column):
        start, end, row = bytetext.spans(bytetext.lower_ascii(data), offsets, bytetext.WHITE)
        n = len(offsets) - 1
        words = np.bincount(row, minlength=n)
        hashed = bytetext.span_hashes(bytetext.lower_ascii(data), start, end)
        found, of = [], []
        for size in range(1, SHINGLE + 1):
            wanted = words >= SHINGLE if size == SHINGLE else words == size
            if wanted.any():
                first, value = bytetext.windows(hashed, row, size)
                chosen = wanted[row[first]]
                found.append(value[chosen]), of.append(row[first][chosen])
        hashes = np.concatenate([np.zeros(0, np.uint64), *found])
        rows = np.concatenate([np.zeros(0, np.int64), *of])
        order = np.argsort(rows, kind="stable")
        yield n, hashes[order], rows[order]


def signatures(texts: list[str | None] | pa.Array) -> np.ndarray:
    """One row of ``PERMUTATIONS`` 16-bit numbers per text; all ones without words."""
    return sketches(texts)[0]


def sketches(texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The signatures, and how many different shingles each text has."""
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    out, counts = [np.zeros((0, PERMUTATIONS), np.uint16)], [np.zeros(0, np.int64)]
    for n, hashes, rows in shingles(column):
        signed = np.full((n, PERMUTATIONS), 0xFFFF, np.uint16)
        if len(hashes):
            begins = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            for p in range(PERMUTATIONS):
                least = np.minimum.reduceat(hashes * _A[p] + _B[p], begins)
                # The high bits of a minimum are nearly all zero.
                signed[rows[begins], p] = (least & np.uint64(0xFFFF)).astype(np.uint16)
        out.append(signed)
        order = np.lexsort((hashes, rows))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1])
        counts.append(np.bincount(rows[order][new], minlength=n))
    return np.concatenate(out), np.concatenate(counts)


def as_text(signed: np.ndarray) -> list[str]:
    """Fingerprints as hex digits, four a position."""
    return [row.tobytes().hex() for row in signed.astype(">u2")]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal positions, an estimate of the Jaccard index."""
    return (a == b).mean(axis=1)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for n, hashes, rows in shingles(column):
        edges = np.searchsorted(rows, np.arange(n + 1))
        for i in range(n):
            yield np.unique(hashes[edges[i] : edges[i + 1]])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard index of two shingle sets; 0 where both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that texts are turned into other forms a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def text_key(text: Column) -> Column:
    """What tells different texts apart: half of their SHA-256; null counts as empty."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, _KEY)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the start of the following one."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


_FACTS = (
    "edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def _facts(texts: list[str], signed: np.ndarray, following: list[str], next_signed: np.ndarray) -> list:
    """The columns ``_FACTS`` of texts next to the ones that follow them."""
    changed = [edited(a, b) for a, b in zip(texts, following)]
    changed_signed = signatures(changed)
    return [
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array(as_text(signed), pa.string()),
        pa.array(as_text(changed_signed), pa.string()),
        pa.array(likeness(signed, changed_signed), pa.float64()),
        pa.array(likeness(signed, next_signed), pa.float64()),
    ]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts of all rows of a sorted task but the last, whose next row is in another task.

    The first and the last row leave their texts for it, as roles 1 and 2.
    """
    place = TaskContext.get().partitionId()

    def batch(role: int, ids: list, texts: list[str], counts: np.ndarray, facts: list, whole: bool) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([role] * n, pa.int32()),
                pa.array([place] * n, pa.int32()),
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest()[:_KEY] for t in texts], pa.string()),
                pa.array(counts),
                pa.array(texts if whole else [None] * n, pa.string()),
                *facts,
            ],
            ["role", "place", "doc_id", "n_chars", "t", "n_shingles", "text", *[c.split()[0] for c in _FACTS.split(", ")]],
        )

    def alone(role: int, row_id, text: str, count: np.ndarray, signed: np.ndarray) -> pa.RecordBatch:
        empty = [pa.nulls(1, pa.string()), *[pa.nulls(1, pa.float64())] * 2]
        facts = [empty[0], pa.array(as_text(signed), pa.string()), empty[0], *empty[1:]]
        return batch(role, [row_id], [text], count, facts, True)

    ids: list = []
    texts: list[str] = []
    signed, counts = np.zeros((0, PERMUTATIONS), np.uint16), np.zeros(0, np.int64)
    for rows in _slices(batches):
        opens = not texts
        ids += rows.column("doc_id").to_pylist()
        texts += [t or "" for t in rows.column("text").to_pylist()]
        sketched = sketches(rows.column("text"))
        signed, counts = np.concatenate([signed, sketched[0]]), np.concatenate([counts, sketched[1]])
        if opens:
            yield alone(1, ids[0], texts[0], counts[:1], signed[:1])
        if len(texts) > 1:
            yield batch(0, ids[:-1], texts[:-1], counts[:-1], _facts(texts[:-1], signed[:-1], texts[1:], signed[1:]), False)
        ids, texts, signed, counts = ids[-1:], texts[-1:], signed[-1:], counts[-1:]
    if texts:
        yield alone(2, ids[0], texts[0], counts, signed)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts of rows whose following text comes with them."""
    for rows in _slices(batches):
        texts, following = rows.column("text").to_pylist(), rows.column("following").to_pylist()
        facts = _facts(texts, signatures(texts), following, signatures(following))
        kept = [rows.column(c) for c in ("doc_id", "n_chars", "t", "n_shingles")]
        yield pa.RecordBatch.from_arrays(
            [*kept, *facts], ["doc_id", "n_chars", "t", "n_shingles", *[c.split()[0] for c in _FACTS.split(", ")]]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, t, n_shingles``, fingerprints and likenesses of every row.

    ``t`` is the key of the text. The next document is the next one by doc_id
    (null ids first, rows with one id by the hash of their text), after the last
    the first; of a single row it is the row itself. Texts move once, ranged by
    doc_id, and only the last row of a task needs a text of another task. Null
    texts count as empty; equal rows are rows of their own; other columns are
    not read; an empty table gives no rows.
    """
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The last column splits rows that are equal in all; their order does not matter.
    order = ["doc_id", "_hash", "_row"]
    ranged = (
        rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
        .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    )
    kept = "role int, place int, doc_id long, n_chars long, t string, n_shingles long, text string"
    ranged.mapInArrow(_in_order, f"{kept}, {_FACTS}").write.option("compression", "zstd").parquet(folder)
    done = spark.read.parquet(folder)
    # One row a task from here on.
    firsts = done.where("role = 1").select("place", F.col("text").alias("following"))
    following = F.lead("place").over(Window.orderBy("place"))
    wrapped = F.coalesce(following, F.min("place").over(Window.partitionBy()))
    then = firsts.select("place", wrapped.alias("then"))
    lasts = (
        done.where("role = 2").select("place", "doc_id", "n_chars", "t", "n_shingles", "text")
        .join(then, "place")
        .join(firsts.withColumnRenamed("place", "then"), "then")
    )
    schema = f"doc_id long, n_chars long, t string, n_shingles long, {_FACTS}"
    across = lasts.select("doc_id", "n_chars", "t", "n_shingles", "text", "following").mapInArrow(_across, schema)
    return done.where("role = 0").drop("role", "place", "text").unionByName(across)


def band_rows(texts: DataFrame) -> DataFrame:
    """``(key, u, k)``: the bands of each text's fingerprint, as keys of buckets.

    ``u`` is the text's number and ``k`` its number of shingles.
    """
    width = BAND_ROWS * _DIGITS // 2
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(i, F.substr("signed", i * width + 1, F.lit(width))),
    )
    return texts.select(F.explode(bands).alias("key"), "u", "k")


def _possible(members: DataFrame, least: float) -> DataFrame:
    """``(a, b)``: the lowest text of a group and each other text whose number of shingles allows the Jaccard index."""
    sizes = F.least("k", "y.k") >= F.greatest("k", "y.k") * least - 1e-9
    return members.where(sizes & (F.col("u") != F.col("y.u"))).select(F.col("y.u").alias("a"), F.col("u").alias("b"))


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many numbers each two of some sets of distinct numbers share, for ``[i, j]`` with i < j.

    Frequent numbers are counted as products of 0-1 matrices, the others, which
    few sets hold, by their places in the list of all numbers in order.
    """
    n = len(sets)
    counts = np.zeros((n, n), np.int32)
    values = np.concatenate([np.zeros(0, np.uint64), *sets])
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    begins = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
    held = np.diff(np.r_[begins, len(values)])
    frequent = held * DENSE >= n
    column = np.cumsum(frequent) - 1
    many = np.repeat(frequent & (held > 1), held)
    columns, of = np.repeat(column, held)[many], row[many]
    for at in range(0, int(columns[-1]) + 1 if len(columns) else 0, COLUMNS):
        first, last = np.searchsorted(columns, [at, at + COLUMNS])
        ones = np.zeros((n, COLUMNS), np.float32)
        ones[of[first:last], columns[first:last] - at] = 1
        counts += (ones @ ones.T).astype(np.int32)
    few = np.repeat(~frequent & (held > 1), held)
    values, row = values[few], row[few]
    for apart in range(1, int(held[~frequent].max(initial=1))):
        same = np.flatnonzero(values[apart:] == values[:-apart])
        np.add.at(counts, (row[same], row[same + apart]), 1)
    return np.triu(counts, 1)


def joining(
    sets: list[np.ndarray], keys: list[np.ndarray], classes: np.ndarray, sides: np.ndarray, least: float
) -> list[tuple[int, int]]:
    """Links between classes, of the lowest one to each other that sets join it to.

    Two sets join their classes when they share a key and reach Jaccard
    ``least`` and, where there are two sides, are on different ones.
    """
    size = np.array([len(s) for s in sets])
    both = shared_counts(sets)
    linked = both / np.maximum(size[:, None] + size - both, 1) >= least - 1e-12
    linked &= classes[:, None] != classes
    if (sides != sides[0]).any():
        linked &= sides[:, None] != sides
    if not linked.any():
        return []
    linked &= shared_counts(keys) > 0
    # Classes are numbered in order, so the lowest number stands for all that are joined.
    names, own = np.unique(classes, return_inverse=True)
    label = own.copy()
    for i in np.flatnonzero(linked.any(axis=1)):
        joined = np.unique(np.append(label[linked[i]], label[i]))
        label[np.isin(label, joined)] = joined[0]
    return sorted({(int(names[to]), int(names[of])) for of, to in zip(own, label) if of != to})


def _in_cells(members: DataFrame, links: DataFrame) -> DataFrame:
    """Rows ``(y, p, q, u, c, slot, keys)``: where the texts of a group meet that has unlinked ones.

    ``members (y, u, k, keys)`` are the groups, ``links (a, b)`` those of their
    lowest texts; ``c`` is the lowest text of a linked one, else the text itself.
    A small group is one cell. Of others the linked texts and the rest are dealt
    out to blocks; each block of the rest meets itself and every other block.
    """
    linked = links.select(F.col("a").alias("y"), F.col("b").alias("u"), F.lit(True).alias("linked"))
    classed = members.withColumn("y", F.col("y.u")).join(linked, ["y", "u"], "left")
    state = cut_lineage(classed.select("y", "u", "k", F.when(F.col("linked"), F.col("y")).otherwise(F.col("u")).alias("c"), "keys"))
    inside = F.col("c") == F.col("y")
    groups = state.groupBy("y").agg(
        F.count("*").alias("n"), F.sum("k").alias("w"),
        F.count(F.when(inside, 1)).alias("n_in"), F.sum(F.when(inside, F.col("k"))).alias("w_in"),
    )

    def blocks(n: Column, w: Column) -> Column:
        return F.ceil(F.greatest(n / SLOT, w / SLOT_SHINGLES, F.lit(1))).cast("int")

    # With two rows all pairs are compared.
    several = groups.where((F.col("n") > F.col("n_in")) & (F.col("n") > 2))
    whole = (F.col("n") <= 2 * SLOT) & (F.col("w") <= 2 * SLOT_SHINGLES)
    cut = several.select(
        "y", "n", whole.alias("whole"),
        blocks(F.col("n_in"), F.col("w_in")).alias("inner"),
        blocks(F.col("n") - F.col("n_in"), F.col("w") - F.col("w_in")).alias("outer"),
    )
    dealt = F.xxhash64("u")
    slot = F.when(inside, F.col("outer") + F.pmod(dealt, "inner")).otherwise(F.pmod(dealt, "outer"))
    last = F.when(inside, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    opened = lookup(state, cut, ["y"], "n", "u", how="inner").select(
        "y", "u", "c", "keys",
        F.when(F.col("whole"), 0).otherwise(slot).cast("int").alias("slot"),
        F.explode(F.sequence(F.lit(0), F.when(F.col("whole"), 0).otherwise(last))).alias("other"),
    )
    return opened.select("y", F.least("slot", "other").alias("p"), F.greatest("slot", "other").alias("q"), "u", "c", "slot", "keys")


def joined_classes(cells: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """Links ``(a, b)`` of text numbers that join the classes of texts in one cell.

    ``found (u, text)`` has the texts; they are turned into shingles once.
    """

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [own.tobytes() for own in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("u"), pa.array(sets, pa.binary())], ["u", "shingles"])

    def links(rows: pa.Table) -> pa.Table:
        sets = [np.frombuffer(v.as_py(), np.uint64) for v in rows.column("shingles")]
        keys = [np.array(v, np.int64).view(np.uint64) for v in rows.column("keys").to_pylist()]
        classes, sides = rows.column("c").to_numpy(), rows.column("slot").to_numpy()
        ends = np.array(joining(sets, keys, classes, sides, least), np.int64).reshape(-1, 2)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    met = cells.join(found.mapInArrow(as_sets, "u long, shingles binary"), "u")
    return met.groupBy("y", "p", "q").applyInArrow(links, "a long, b long")


def held_texts(needed: DataFrame, docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(u, text)`` of the text numbers ``needed (u)``, in the shared folder.

    ``texts (u, t, id)`` names a row that holds each text. The scan for the texts
    is thinned out by a broadcast of at most ``THINNING`` numbers.
    """
    thin = F.pmod(F.xxhash64("id", "t"), F.lit(THINNING)).alias("_thin")
    wanted = cut_lineage(needed.join(texts, "u").select("u", "t", thin))
    rows = docs.select("text", text_key(F.col("text")).alias("t"), F.col("doc_id").cast("long").alias("id"))
    thinned = rows.select("t", "text", thin).join(F.broadcast(wanted.select("_thin").distinct()), "_thin", "left_semi")
    return cut_texts(thinned.join(wanted.select("u", "t"), "t").dropDuplicates(["t"]).select("u", "text"))


def verified(pairs: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """The pairs ``(a, b)`` of text numbers whose shingle sets reach Jaccard ``least``.

    ``found (u, text)`` has the texts. A centre of many pairs is sent to a place
    for each ``PAIRS_PLACE`` of them.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    numbered = lookup(pairs, counts.withColumn("of", F.col("n")), ["a"], "n", "b").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.floor((F.col("of") - 1) / PAIRS_PLACE) + 1).alias("at")
    )
    places = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PAIRS_PLACE)))
    none = F.lit(None).cast("long").alias("b")
    left = counts.select("a", places.alias("at")).join(found.withColumnRenamed("u", "a"), "a")
    right = numbered.join(found.withColumnRenamed("u", "b"), "b")
    # The centre's text comes once a place, before the texts it is compared with.
    rows = left.select("a", "at", none, "text").unionByName(right.select("a", "at", "b", "text"))
    placed = rows.repartition("a", "at").sortWithinPartitions("a", "at", F.col("b").asc_nulls_first())

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for batch in _slices(batches):
            firsts, others = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            kept = []
            for a, b, own in zip(firsts, others, shingle_sets(batch.column("text"))):
                if b is None:
                    centre = own
                elif jaccard(centre, own) >= least - 1e-12:
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], ["a", "b"]
            )

    return placed.mapInArrow(passed, "a long, b long")


def cut_texts(texts: DataFrame) -> DataFrame:
    """Texts written compressed to the shared folder and read again."""
    folder = work_folder(texts.sparkSession)
    texts.write.option("compression", "zstd").parquet(folder)
    return texts.sparkSession.read.parquet(folder)


def classes(marked: DataFrame, docs: DataFrame, least: float = JACCARD) -> DataFrame:
    """``(t, class_id)`` of every text: the smallest doc_id of its near-duplicates.

    ``marked (doc_id, t, fingerprint, n_shingles)`` has a row per row of
    ``docs``. Texts are near-duplicates when a chain of pairs that share a band
    and reach Jaccard ``least`` joins them; equal texts always are. Null ids
    count only where a class has no other; its class_id is null then.
    """
    texts = cut_texts(
        marked.withColumn("signed", F.unhex("fingerprint")).groupBy("t")
        .agg(F.min("doc_id").alias("id"), F.first("signed").alias("signed"), F.first("n_shingles").alias("k"))
        .withColumn("u", F.monotonically_increasing_id())
    )
    named = texts.select("u", "t", "id")
    keyed = band_rows(texts.where("k > 0"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    rows = cut_lineage(lookup(keyed, sizes.withColumn("size", F.col("n")), ["key"], "n", "u", how="inner"))
    # The lowest text of a bucket stands for it; a text is in a group once, with its buckets there.
    lowest = rows.groupBy("key").agg(F.max("size").alias("n"), F.min(F.struct("u", "k")).alias("y"))
    grouped = lookup(rows.drop("size"), lowest, ["key"], "n", "u", how="inner").groupBy("y", "u", "k")
    members = cut_lineage(grouped.agg(F.collect_list("key").alias("keys")))
    found = held_texts(members.select("u").distinct(), docs, named)
    # First everything is compared with the lowest text of its group.
    links = cut_lineage(verified(_possible(members, least), found, least))
    # Then the texts that it leaves apart are compared with all of the group.
    links = links.unionByName(joined_classes(_in_cells(members, links), found, least))
    parts = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    joined = named.join(parts.withColumnRenamed("id", "u"), "u", "left").withColumn("component", F.coalesce("component", "u"))
    lowest = joined.groupBy("component").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    return lookup(joined, lowest, ["component"], "n", "t").select("t", "class_id")


def near_duplicates(docs: DataFrame, least: float = JACCARD) -> DataFrame:
    """Every row of ``docs (doc_id, text)`` with fingerprints, likenesses and ``class_id``.

    See :func:`fingerprints` and :func:`classes`. A class is named by its
    smallest doc_id, a document without near-duplicates by its own.
    """
    marked = fingerprints(docs)
    found = classes(marked.select("doc_id", "t", "fingerprint", "n_shingles"), docs, least)
    copies = marked.groupBy("t").agg(F.count("*").alias("n"))
    # Fingerprints move as bytes, half as long as their digits.
    prints = ["fingerprint", "edited_fingerprint"]
    packed = marked.withColumns({c: F.unhex(c) for c in prints})
    done = lookup(packed, found.join(copies, "t"), ["t"], "n", "doc_id").drop("t", "n_shingles")
    return done.withColumns({c: F.lower(F.hex(c)) for c in prints})


@query()
def op11_minhash_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))

"""Compression of vectors to codes of codebook entries, with norm-of-sum bounds.

Vectors become whole numbers and are cut into equal parts, each with a codebook
of its own. Rounds of assignment and averaging fit the codebooks in exact whole
numbers. A pass over the rows computes, for each part, the exact distance to
its present entry; the other entries stand in groups with one lower bound each:
the smallest distance to the group when it was last scanned (in the group of
the row's own entry: to any other), and that round's number, the stamp. All codebooks since the first are kept, so a bound is
lowered by the net displacement of the group's entries between its stamp and
now, ``max ||c(now) - c(stamp)||``, which is never more than the sum of their
moves. A group is scanned again, exactly, only where its bound does not exceed
the present distance.

The driver holds codebooks only, at most ``ENTRIES`` times the number of
components for each round; tasks add up sums per part and entry, and Spark adds
those up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.registry import query, table
from reviewlake.scale import cut_lineage, lookup

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Entries that share a lower bound.
GROUP = 32
# Rows that are compared at a time, for memory.
CHUNK = 4_096
# Whole numbers up to this are subtracted, squared and added without overflow.
LARGEST = 1 << 27
# Bounds are kept as rounded numbers; this much is given away for it.
_SLACK = 1e-5


def whole_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``(vec_id, label, v)`` of the rows whose vector has finite numbers only.

    ``v`` is ``floor(1024 x)`` of each component. Empty vectors are dropped as
    null ones are.
    """
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).where(~bad)
    scaled = F.transform(column, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return kept.select("vec_id", "label", scaled.alias("v"))


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exactly."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    # Sums of squares below 2**53 are exact in double precision.
    if 4 * most * most * max(x.shape[1], 1) < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(x), len(entries)), np.int64)
    for j, entry in enumerate(entries):
        out[:, j] = ((x - entry) ** 2).sum(axis=1)
    return out


def _own_squares(x: np.ndarray, entries: np.ndarray, code: np.ndarray) -> np.ndarray:
    return ((x - entries[code]) ** 2).sum(axis=1)


class State:
    """What is known of a part's rows: entry, lower bound of each group, its stamp."""

    def __init__(self, code: np.ndarray, bound: np.ndarray, stamp: np.ndarray):
        self.code, self.bound, self.stamp = code, bound, stamp

    @classmethod
    def new(cls, rows: int, groups: int) -> State:
        # A bound below zero is no bound, so the first pass scans everything.
        return cls(
            np.zeros(rows, np.int64), np.full((rows, groups), -1.0, np.float32), np.zeros((rows, groups), np.int8)
        )


def net_moves(history: np.ndarray) -> np.ndarray:
    """``[stamp, group]``: how far the group's entries are from where they were then."""
    moved = np.sqrt(((history[-1][None] - history).astype(np.float64) ** 2).sum(axis=2))
    starts = np.arange(0, history.shape[1], GROUP)
    return np.maximum.reduceat(moved, starts, axis=1) if history.shape[1] else moved[:, :0]


def assign(x: np.ndarray, history: np.ndarray, state: State) -> tuple[State, np.ndarray, int]:
    """Nearest entries of one part's rows: ``(state, squared distances, distances computed)``.

    ``history`` holds the codebooks ``[round, entry, component]``, the last one
    being the present one. Ties go to the lower entry.
    """
    now, entries = len(history) - 1, history[-1]
    groups = -(-len(entries) // GROUP)
    code, bound, stamp = state.code.copy(), state.bound.copy(), state.stamp.copy()
    best = _own_squares(x, entries, code)
    worked = len(x)
    if len(x) == 0:
        return State(code, bound, stamp), best, 0
    lowered = bound - net_moves(history)[stamp, np.arange(groups)[None, :]]
    present = np.sqrt(best.astype(np.float64))
    # An entry at the present distance may still have the lower number.
    open_ = lowered <= (present * (1 + _SLACK) + _SLACK)[:, None]
    second = np.full(bound.shape, np.inf)
    for g in range(groups):
        rows = np.flatnonzero(open_[:, g])
        first = g * GROUP
        chosen = entries[first : first + GROUP]
        for at in range(0, len(rows), CHUNK):
            some = rows[at : at + CHUNK]
            found = _squares(x[some], chosen)
            worked += found.size
            nearest = found.argmin(axis=1)
            least = found[np.arange(len(some)), nearest]
            number = nearest + first
            wins = (least < best[some]) | ((least == best[some]) & (number < code[some]))
            best[some[wins]], code[some[wins]] = least[wins], number[wins]
            # Rounded down, so that it stays a lower bound in single precision.
            bound[some, g] = np.sqrt(least.astype(np.float64)) * (1 - _SLACK)
            stamp[some, g] = now
            if len(chosen) > 1:
                second[some, g] = np.sqrt(np.partition(found, 1, axis=1)[:, 1].astype(np.float64)) * (1 - _SLACK)
    # The bound of the group a row's entry is in leaves that entry out.
    row, old, new = np.arange(len(x)), state.code // GROUP, code // GROUP
    scanned = open_[row, new]
    bound[row[scanned], new[scanned]] = second[row[scanned], new[scanned]]
    left = (old != new) & ~open_[row, old]
    back = np.minimum(lowered[row, old], present) * (1 - _SLACK)
    bound[row[left], old[left]], stamp[row[left], old[left]] = back[left], now
    return State(code, bound, stamp), best, worked


def _widths(length: int) -> list[slice]:
    """The equal parts of a vector; the last ones are shorter where they do not divide it."""
    edges = [-(-length * i // PARTS) for i in range(PARTS + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != length * len(column):
        raise ValueError(f"vectors of other lengths than {length}")
    return flat.astype(np.int64).reshape(-1, length)


def _pass(rows: DataFrame, history: list[np.ndarray], length: int, first: bool) -> DataFrame:
    """One assignment of all rows: ``(vec_id, label, v, code, bound, stamp, error)``."""
    books = [np.stack([h[:, part] for h in history]) for part in _widths(length)]
    groups = -(-len(history[0]) // GROUP)

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            x = _matrix(batch.column("v"), length)
            if not first:
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, PARTS)
                bound = np.frombuffer(b"".join(batch.column("bound").to_pylist()), np.float32)
                stamp = np.frombuffer(b"".join(batch.column("stamp").to_pylist()), np.int8)
                bound, stamp = bound.reshape(n, PARTS, groups), stamp.reshape(n, PARTS, groups)
            states, errors = [], np.zeros(n, np.int64)
            for p, part in enumerate(_widths(length)):
                known = (
                    State.new(n, groups)
                    if first
                    else State(code[:, p].astype(np.int64), bound[:, p], stamp[:, p])
                )
                state, best, _ = assign(x[:, part], books[p], known)
                states.append(state)
                errors += best
            codes = np.stack([s.code for s in states], axis=1).astype(np.uint8)
            bounds = np.stack([s.bound for s in states], axis=1).astype(np.float32)
            stamps = np.stack([s.stamp for s in states], axis=1).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    batch.column("v"),
                    *[pa.array([row.tobytes() for row in a], pa.binary()) for a in (codes, bounds, stamps)],
                    pa.array(errors),
                ],
                ["vec_id", "label", "v", "code", "bound", "stamp", "error"],
            )

    kinds = dict(rows.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<bigint>, code binary, bound binary, stamp binary, error long"
    return rows.mapInArrow(worked, schema)


def _sums(rows: DataFrame, length: int, entries: int) -> DataFrame:
    """``(part, entry, n, total)``: count and componentwise sum of each entry's parts."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths = _widths(length)
        counts = np.zeros((PARTS, entries), np.int64)
        totals = [np.zeros((entries, w.stop - w.start), np.int64) for w in widths]
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            x = _matrix(batch.column("v"), length)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, PARTS)
            for p, part in enumerate(widths):
                counts[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(totals[p], code[:, p], x[:, part])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part.astype(np.int32)),
                pa.array(entry.astype(np.int32)),
                pa.array(counts[part, entry]),
                pa.array([totals[p][e].tolist() for p, e in zip(part, entry)], pa.list_(pa.int64())),
            ],
            ["part", "entry", "n", "total"],
        )

    partial = rows.select("v", "code").mapInArrow(added, "part int, entry int, n long, total array<bigint>")
    each = partial.select("part", "entry", "n", F.posexplode("total").alias("at", "value"))
    return each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))


def fit(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, label, code, error)`` of whole vectors ``(vec_id, label, v)``, and the codebooks.

    The codebooks are ``[entry, component]``: entry ``i`` of every part starts
    as the part of the row with the ``i``-th smallest vec_id (equal ids by
    their numbers, null ids first); with fewer rows there are fewer entries.
    Vectors of different lengths, or with numbers beyond ``LARGEST``, raise an error.
    """
    start = [r["v"] for r in rows.orderBy("vec_id", "v").limit(ENTRIES).collect()]
    length = len(start[0]) if start else 0
    if any(len(v) != length for v in start):
        raise ValueError(f"a vector has another length than {length}")
    beyond = F.exists("v", lambda x: F.abs(x) > LARGEST)
    checked = F.when((F.size("v") == length) & ~beyond, F.col("v")).otherwise(
        F.raise_error(F.lit(f"a vector has another length than {length}, or numbers beyond {LARGEST}")).cast("array<bigint>")
    )
    state = rows.withColumn("v", checked)
    history = [np.array(start, np.int64).reshape(len(start), length)]
    widths = _widths(length)
    for number in range(ROUNDS + 1):
        state = cut_lineage(_pass(state, history, length, number == 0))
        if number == ROUNDS:
            break
        book = history[-1].copy()
        for r in _sums(state, length, len(book)).collect():  # a row for each number of the codebooks
            book[r["entry"], widths[r["part"]].start + r["at"]] = r["value"] // r["n"]
        history.append(book)
    return state.select("vec_id", "label", "code", "error"), history[-1]


def codebooks_digest(book: np.ndarray) -> str:
    """SHA-256 of all numbers, by part, entry and position, joined by commas."""
    numbers = [str(n) for part in _widths(book.shape[1]) for entry in book[:, part] for n in entry]
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def compress(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every kept vector.

    Vectors that are null, empty or hold null or non-finite numbers are
    dropped; of an empty table nothing comes back. Null labels count as one
    label, a null vec_id is an id before all others; repeated rows are rows of
    their own; other columns are not read.
    """
    coded, book = fit(whole_vectors(vectors))
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-"))
    keyed = coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", label.alias("key"))
    sums = keyed.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    spread = keyed.withColumn("spread", F.xxhash64("vec_id", "code"))
    return lookup(spread, sums, ["key"], "n", "spread").select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(book)).alias("codebooks_sha256")
    )


def _rounds_sql() -> str:
    """The rounds in SQL over parts ``x (vec_id, part, p)`` and codebooks ``c0 (part, entry, p)``."""
    out = []
    for i in range(ROUNDS + 1):
        out.append(f"""
    a{i} AS (SELECT vec_id, part, any_value(x.p) AS p, min(({{distance}}) * 1000 + entry) AS best
      FROM x JOIN c{i} c USING (part) GROUP BY vec_id, part)""".replace("{distance}", _DISTANCE))
        if i < ROUNDS:
            out.append(f"""
    n{i} AS (SELECT part, entry, list(value ORDER BY spot) AS p FROM (
      SELECT part, best % 1000 AS entry, spot, (sum(v) - (((sum(v) % count(*)) + count(*)) % count(*))) // count(*) AS value
      FROM (SELECT part, best, unnest(p) AS v, generate_subscripts(p, 1) AS spot FROM a{i})
      GROUP BY part, best % 1000, spot) GROUP BY part, entry),
    c{i + 1} AS (SELECT part, entry, coalesce(n{i}.p, c{i}.p) AS p FROM c{i} LEFT JOIN n{i} USING (part, entry))""")
    return ",".join(out)


_DISTANCE = "list_sum(list_transform(list_zip(x.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
_SQL = f"""
    WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda y: floor(y::DOUBLE * {SCALE})::BIGINT) AS v
      FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
    x AS (SELECT vec_id, label, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS p
      FROM kept, range({PARTS}) r(part)),
    c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, p FROM x
      QUALIFY entry < {ENTRIES}), {_rounds_sql()},
    done AS (SELECT vec_id, string_agg(lower(lpad(to_hex(best % 1000), 2, '0')), '' ORDER BY part) AS code,
        sum(best // 1000)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id),
    books AS (SELECT sha256(string_agg(n, ',' ORDER BY part, entry)) AS h FROM (
        SELECT part, entry, array_to_string(p, ',') AS n FROM c{ROUNDS}))
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
        (SELECT h FROM books) AS codebooks_sha256 FROM done JOIN kept USING (vec_id)
"""


@query(_SQL)
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return compress(table(spark, folder, "embeddings"))

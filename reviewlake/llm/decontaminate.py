"""Benchmark decontamination by edit distance: CGK embedding, bit sampling, verification.

A document is contaminated by an item if one of its passages is within
``floor(n · EDITS)`` word edits of the item's ``n`` words. Letters are compared
without ASCII case, punctuation only separates words.

1. Windows. If at most k edits lie between an item and a passage, some run of
   ``ceil((n - k) / (k + 1))`` item words is intact (pigeonhole). Runs of that
   many words, four at most, are looked up at every word of every document; a
   hit at word p of item offset o proposes the windows of n words that start
   within k words of p - o. No passage is lost here.
2. CGK. A random walk copies the current word and moves on or not by a random
   bit of (step, word); n words become a string whose Hamming distance follows
   their edit distance. Sampled positions of it are hashed; a document and an
   item stay a candidate if one of their windows shares the item's bucket in
   one of ``REPEATS`` independent walks.
3. All windows of a candidate are verified by the exact edit distance between
   the item and its best passage there.

A window misses in all repeats with probability ``(1 - a**SAMPLED)**REPEATS``
where ``a`` is the share of walk positions that agree; with a = 0.45, as measured at the
limit of edits, that is below 1 %, and a passage has 2k + 1 windows to be found by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import bytetext as bt
from reviewlake.llm.registry import query, table

EDITS = 0.2
REPEATS, SAMPLED = 24, 2
LONGEST_GRAM = 4
# An item block is held by every task; a longer benchmark is searched in several.
BLOCK_CHARS = 4_000_000
_SEED = 20_011


def _edits(n: np.ndarray | int) -> np.ndarray | int:
    return (n * int(EDITS * 100)) // 100


@dataclass(frozen=True)
class Gram:
    size: int
    keys: np.ndarray  # sorted hashes of the runs
    first: np.ndarray  # per key, where its postings start; one more at the end
    item: np.ndarray
    offset: np.ndarray
    sieve: np.ndarray  # which leading 20 bits occur


@dataclass(frozen=True)
class Index:
    """A block of benchmark items, ready to be searched for."""

    ids: list
    words: list[np.ndarray]  # hashes of each item's words
    grams: list[Gram]
    sampled: np.ndarray  # items × repeats × SAMPLED walk positions
    buckets: np.ndarray  # items × repeats


def _walk(
    words: np.ndarray, start: np.ndarray, length: np.ndarray, stop: np.ndarray,
    sampled: np.ndarray, repeat: int,
) -> np.ndarray:
    """The bucket of each window in one repeat.

    A window is ``length`` words from ``start``; words at or past ``stop``, or
    past its length, read as a pad that equals itself only.
    """
    at = np.zeros(len(start), np.int64)
    bucket = np.zeros(len(start), np.uint64)
    seed = np.uint64((_SEED + repeat) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1))
    for step in range(int(sampled.max(initial=-1)) + 1):
        place = start + at
        inside = (at < length) & (place < stop)
        symbol = np.where(inside, words[np.minimum(place, len(words) - 1)], np.uint64(0))
        for k in range(SAMPLED):
            here = sampled[:, k] == step
            bucket[here] = bt.mix(bucket[here] * np.uint64(31) + symbol[here] + np.uint64(k + 1))
        move = bt.mix(symbol ^ (seed + np.uint64(step))) & np.uint64(1)
        at += move.astype(np.int64)
    return bucket


def _item_words(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for data, offsets in bt.pieces(pa.array(texts, pa.string())):
        low = bt.lower_ascii(data)
        start, end, row = bt.spans(low, offsets, bt.NOT_WORD)
        hashes = bt.span_hashes(low, start, end)
        out.extend(np.split(hashes, np.cumsum(np.bincount(row, minlength=len(offsets) - 1))[:-1]))
    return out


def build_index(items: list[tuple[object, str | None]]) -> Index:
    """Index ``(id, text)`` items; items without words match nothing and are left out."""
    words = _item_words([text for _, text in items])
    kept = [i for i, w in enumerate(words) if len(w)]
    ids, words = [items[i][0] for i in kept], [words[i] for i in kept]
    postings: dict[int, list] = {}
    for i, w in enumerate(words):
        n, k = len(w), int(_edits(len(w)))
        size = min(LONGEST_GRAM, -(-(n - k) // (k + 1)))
        first, hashes = bt.windows(w, np.zeros(n, np.int64), size)
        postings.setdefault(size, []).append((hashes, np.full(len(first), i), first))
    grams = []
    for size, parts in sorted(postings.items()):
        hashes, item, offset = (np.concatenate(p) for p in zip(*parts))
        order = np.argsort(hashes, kind="stable")
        keys, first = np.unique(hashes[order], return_index=True)
        sieve = np.zeros(1 << 20, bool)
        sieve[(keys >> np.uint64(44)).astype(np.int64)] = True
        grams.append(Gram(size, keys, np.append(first, len(hashes)), item[order], offset[order], sieve))
    random = np.random.default_rng(_SEED)
    length = np.array([len(w) for w in words], np.int64)
    # One and a half steps a word: the walk is then about three quarters through.
    draw = random.random((REPEATS, SAMPLED))
    sampled = np.floor(draw[None] * np.maximum(1.5 * length, 1)[:, None, None]).astype(np.int64)
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    begin = np.cumsum(length) - length
    buckets = np.zeros((len(words), REPEATS), np.uint64)
    for r in range(REPEATS if words else 0):
        buckets[:, r] = _walk(flat, begin, length, begin + length, sampled[:, r], r)
    return Index(ids, words, grams, sampled, buckets)


def _proposals(words: np.ndarray, row: np.ndarray, index: Index) -> np.ndarray:
    """Distinct ``(item, text, window start)`` rows around intact runs."""
    found = []
    for gram in index.grams:
        place, hashes = bt.windows(words, row, gram.size)
        likely = gram.sieve[(hashes >> np.uint64(44)).astype(np.int64)]
        place, hashes = place[likely], hashes[likely]
        at = np.minimum(np.searchsorted(gram.keys, hashes), len(gram.keys) - 1)
        hit = gram.keys[at] == hashes
        place, at = place[hit], at[hit]
        many = gram.first[at + 1] - gram.first[at]
        posting = np.arange(many.sum()) + np.repeat(gram.first[at] - (np.cumsum(many) - many), many)
        place = np.repeat(place, many)
        found.append(np.stack([gram.item[posting], row[place], place - gram.offset[posting]], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def _collides(words, starts, stops, items, pairs, index: Index) -> np.ndarray:
    """Which pairs have a window that shares a bucket with its item in some repeat."""
    length = np.array([len(w) for w in index.words], np.int64)[items]
    found = np.zeros(int(pairs.max(initial=-1)) + 1, bool)
    for r in range(REPEATS):
        left = np.flatnonzero(~found[pairs])
        if len(left) == 0:
            break
        i = items[left]
        got = _walk(words, starts[left], length[left], stops[left], index.sampled[i, r], r)
        found[pairs[left[got == index.buckets[i, r]]]] = True
    return found


def best_passage(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """``(edits, end)`` of the best passage of a region; of equal ones the first end."""
    place = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, word in enumerate(item):
        step = row + 1
        step[1:] = np.minimum(step[1:], row[:-1] + (region != word))
        row = np.minimum.accumulate(step - place) + place
    end = int(row.argmin())
    return int(row[end]), end


def search(texts: pa.Array, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """``(text, item, edits, first word, end word)``: the best passage of each pair found.

    Words are counted from 0, ``end word`` is the one after the passage. Of
    equal passages the first one counts.
    """
    base = 0
    for data, offsets in bt.pieces(texts):
        low = bt.lower_ascii(data)
        start, end, row = bt.spans(low, offsets, bt.NOT_WORD)
        words = bt.span_hashes(low, start, end)
        texts_here = len(offsets) - 1
        count = np.bincount(row, minlength=texts_here)
        begin = np.cumsum(count) - count
        proposed = _proposals(words, row, index)
        if len(proposed):
            yield from _verified(words, begin, begin + count, proposed, index, base)
        base += texts_here


def _verified(words, begin, stop, proposed, index: Index, base: int):
    length = np.array([len(w) for w in index.words], np.int64)
    slack = _edits(length)[proposed[:, 0]]
    # Every start within k words of a proposed one, once.
    many = 2 * slack + 1
    shift = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many + slack, many)
    spread = np.repeat(proposed, many, axis=0)
    spread[:, 2] += shift
    floor = begin[spread[:, 1]]
    spread[:, 2] = np.clip(spread[:, 2], floor, np.maximum(stop[spread[:, 1]] - 1, floor))
    spread = np.unique(spread, axis=0)
    pair = np.zeros(len(spread), np.int64)
    pair[1:] = np.cumsum((spread[1:, :2] != spread[:-1, :2]).any(axis=1))
    near = _collides(words, spread[:, 2], stop[spread[:, 1]], spread[:, 0], pair, index)
    spread = spread[near[pair]]
    if len(spread) == 0:
        return
    item, text, at = spread.T
    # Windows of one pair that overlap make one region.
    new = np.ones(len(at), bool)
    new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (at[1:] - at[:-1] > length[item[1:]])
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(at)) - 1
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for a, b in zip(firsts, lasts):
        i, t = int(item[a]), int(text[a])
        n, k = len(index.words[i]), int(_edits(len(index.words[i])))
        low, high = max(at[a] - k, begin[t]), min(at[b] + n + k, stop[t])
        edits, end = best_passage(index.words[i], words[low:high])
        if edits <= k:
            # The same distance backwards from the end gives the start.
            region = words[low : low + end][::-1]
            back = best_passage(index.words[i][::-1], region[: n + k])[1]
            value = (edits, int(low + end - back - begin[t]), int(low + end - begin[t]))
            best[(t, i)] = min(best.get((t, i), value), value)
    for (t, i), (edits, first, end) in best.items():
        yield base + t, i, edits, first, end


def indexes(benchmark: DataFrame) -> list[Index]:
    """The items in blocks of bounded size; one block unless the benchmark is long."""
    items = benchmark.select("item_id", "text").distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(size // BLOCK_CHARS) + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = []
    for b in range(blocks):
        rows = items.where(block == b).orderBy("item_id", "text").collect()
        out.append(build_index([(r["item_id"], r["text"]) for r in rows]))
    return out


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item found in it, with the best passage.

    Columns ``doc_id, item_id, edits, item_words, similarity, first_word,
    end_word``. Null and empty texts hold nothing; repeated rows of a document
    count once; an empty table gives no rows.
    """
    schema = "doc_id long, item_id long, edits long, item_words long, first_word long, end_word long"

    def found(index: Index):
        def run(batches):
            for batch in batches:
                ids = batch.column("doc_id")
                rows = list(search(batch.column("text"), index))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([r[0] for r in rows], pa.int64())),
                        pa.array([index.ids[r[1]] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([len(index.words[r[1]]) for r in rows], pa.int64()),
                        pa.array([r[3] for r in rows], pa.int64()),
                        pa.array([r[4] for r in rows], pa.int64()),
                    ],
                    ["doc_id", "item_id", "edits", "item_words", "first_word", "end_word"],
                )

        return run

    source = docs.select(F.col("doc_id").cast("long"), "text")
    parts = [source.mapInArrow(found(index), schema) for index in indexes(benchmark)]
    rows = reduce(DataFrame.unionByName, parts)
    best = F.min(F.struct("edits", "first_word", "end_word", "item_words")).alias("b")
    return (
        rows.groupBy("doc_id", "item_id")
        .agg(best)
        .select(
            "doc_id",
            "item_id",
            "b.edits",
            "b.item_words",
            (1 - F.col("b.edits") / F.col("b.item_words")).alias("similarity"),
            "b.first_word",
            "b.end_word",
        )
    )


def is_contaminated(text: Column, found_in: list[Index]) -> Column:
    """Whether a text holds a passage of any item; false for null and empty texts."""

    def holds(index: Index) -> Column:
        @F.arrow_udf("boolean")
        def flagged(texts: pa.Array) -> pa.Array:
            flags = np.zeros(len(texts), bool)
            for row, *_ in search(texts, index):
                flags[row] = True
            return pa.array(flags)

        return flagged(text)

    return reduce(Column.__or__, [holds(index) for index in found_in])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, columns unchanged."""
    return docs.where(~is_contaminated(F.col("text"), indexes(benchmark)))


@query()
def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return contaminations(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
